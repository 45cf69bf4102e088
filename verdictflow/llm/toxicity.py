"""Toxic passages by maximum-scoring segments of token log-odds.

Learning: labelled texts give each token, and each stem of four letters, a log-odds of
toxic against clean documents, shrunk by an informative Dirichlet prior; those whose
log-odds stand out by ``min_z`` standard errors form the lexicon. A token scores its own
log-odds, else that of its stem, and any other the log-odds of not being in the lexicon;
a token that repeats the one before it scores as another, or junk would pass for insult. Scoring: one pass over a text finds all maximal scoring segments. The best score a
clean text of n tokens reaches by chance follows an extreme-value law with parameter 1,
as scores are log-likelihood ratios; its location is fitted on clean texts. Segments
beyond chance are the passages, and what they exceed it by, summed, is turned into a
probability by a logistic fit. Where none is, the best segment's distance from chance
takes its place, so that the fit and not the significance level decides on such texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictflow.llm.common import stored

TOKEN = re.compile(r"\w+")
MAX_TRAINING = 20_000
MAX_LEXICON = 20_000
MAX_SCORE = 8.0
STEM = 4

_ARROW = {"string": pa.string(), "long": pa.int64(), "array<double>": pa.list_(pa.float64())}
PASSAGES = "array<struct<start int, end int, score double>>"


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Model:
    """What learning leaves: a lexicon, the score of other tokens, and the calibration."""

    lexicon: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    other: float = -0.1
    location: float = 0.0
    intercept: float = -5.0
    slope: float = 1.0
    significance: float = 0.05

    def hits(self, tokens: list[str]) -> list[tuple[int, float]]:
        """Place and score of the tokens in the lexicon."""
        get, stem = self.lexicon.get, self.stems.get
        found = [(i, s) for i, t in enumerate(tokens) if (s := get(t) or stem(t[:STEM])) is not None]
        return [x for x in found if not x[0] or tokens[x[0]] != tokens[x[0] - 1]]

    def evidence(self, segments: list[tuple[int, int, float]], tokens: int) -> tuple[float, list[tuple[int, int, float]]]:
        """How far the significant segments exceed chance, summed, and these segments.

        The expected number of segments of score s in n clean tokens is n e^(location - s).
        Without a significant one, it is how far the best exceeds chance, or falls below it;
        a text without segments is no evidence, however short.
        """
        chance = math.log(max(tokens, 1)) + self.location
        found = [s for s in segments if s[2] - chance > -math.log(self.significance)]
        if found:
            return sum(s[2] - chance for s in found), found
        return (max(s[2] for s in segments) - chance if segments else min(0.0, -chance)), found

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.intercept + self.slope * evidence))))


def maximal_segments(hits: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, end, score), in linear time.

    ``hits`` are the tokens of positive score by place; those between score ``other``,
    which is negative. A segment begins and ends at a hit. Each is kept with the sums
    before and after it; a new one is joined with the last that has a smaller sum before
    it if it also has a larger sum after it.
    """
    open_: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum after
    total, place = 0.0, 0
    for at, score in hits:
        total += other * (at - place)
        begin, left, total, place = at, total, total + score, at + 1
        end, right = at + 1, total
        k = len(open_) - 1
        while k >= 0:
            if open_[k][2] >= left:
                k -= 1
            elif open_[k][3] < right:
                begin, left = open_[k][0], open_[k][2]
                del open_[k:]
                k -= 1
            else:
                break
        open_.append((begin, end, left, right))
    return [(b, e, right - left) for b, e, left, right in open_]


def scan(text: str, model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """Evidence of the whole text and its significant passages in code points."""
    low = _lower(text)
    tokens = TOKEN.findall(low)
    evidence, found = model.evidence(maximal_segments(model.hits(tokens), model.other), len(tokens))
    if not found:
        return evidence, []
    places = [m.span() for m in TOKEN.finditer(low)]
    return evidence, [(places[b][0], places[e - 1][1], s) for b, e, s in found]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING) -> DataFrame:
    """(toxic, text) of at most ``max_rows`` labelled documents outside the held-out fifth, equal texts once.

    The rows with the smallest hashes of their ids are taken: a bounded sample that
    does not depend on order or size. Conflicting labels of an id count as toxic.
    """
    usable = labels.filter("toxic in (0, 1)").filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    once = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows pairs of numbers: a proven bound.
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("text").agg(F.max("toxic").alias("toxic"))


def _batches(rows: DataFrame, schema: str, each: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(each(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
            if out:
                columns = [pa.array(c, _ARROW[t]) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, list(names))

    return rows.mapInArrow(run, schema)


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING, min_z: float = 2.0) -> Model:
    """A model from a bounded sample of labelled rows; without both labels it finds nothing toxic."""
    rows = stored(training_rows(documents, labels, max_rows), "toxicity-sample")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return Model()

    def count(pairs: Iterator[tuple]) -> Iterator[tuple]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in pairs:
            tokens = set(TOKEN.findall(_lower(text)))
            counts[toxic].update(tokens)
            counts[toxic].update({"~" + t[:STEM] for t in tokens if len(t) >= STEM})
        for token in counts[0].keys() | counts[1].keys():
            yield token, counts[1][token], counts[0][token]

    tokens = _batches(rows.select("text", "toxic"), "token string, bad long, good long", count)
    tokens = tokens.groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    mass = max(1.0, 0.01 * (bad + good))
    prior = (F.col("bad") + F.col("good")) * (mass / (bad + good))
    odds = lambda y, total: F.log((y + prior) / (total + mass - y - prior))
    tokens = tokens.select(
        "token", (odds(F.col("bad"), bad) - odds(F.col("good"), good)).alias("score"),
        F.sqrt(1 / (F.col("bad") + prior) + 1 / (F.col("good") + prior)).alias("error"),
    )
    # A token must also be much likelier in toxic texts, or frequent ones crowd the lexicon.
    found = tokens.filter(f"score > 2 and score >= {min_z} * error").orderBy((F.col("score") / F.col("error")).desc(), "token").limit(MAX_LEXICON)
    scores = {r["token"]: min(r["score"], MAX_SCORE) for r in found.collect()}
    stems = {t[1:]: s for t, s in scores.items() if t.startswith("~")}
    return _calibrated(Model({t: s for t, s in scores.items() if not t.startswith("~")}, stems), rows)


def _calibrated(model: Model, rows: DataFrame) -> Model:
    def density(pairs: Iterator[tuple]) -> Iterator[tuple]:
        for (text,) in pairs:
            tokens = TOKEN.findall(_lower(text))
            yield len(model.hits(tokens)), len(tokens)

    dense = _batches(rows.filter("toxic = 1").select("text"), "hits long, tokens long", density)
    sums = dense.agg(F.sum("hits").alias("hits"), F.sum("tokens").alias("tokens")).first()
    share = (sums["hits"] or 0) / max(1, sums["tokens"] or 0)
    model.other = math.log1p(-min(0.5, max(0.01, share)))

    def best(pairs: Iterator[tuple]) -> Iterator[tuple]:
        for text, toxic in pairs:
            tokens = TOKEN.findall(_lower(text))
            segments = maximal_segments(model.hits(tokens), model.other)
            yield toxic, len(tokens), [x[2] for x in segments]

    # One short row per text of the sample, so bounded by it.
    scored = _batches(rows.select("text", "toxic"), "toxic long, tokens long, scores array<double>", best).collect()
    clean = [max(r["tokens"], 1) * math.exp(-max(r["scores"], default=0.0)) for r in scored if not r["toxic"]]
    model.location = math.log(len(clean) / sum(clean))
    points = [(model.evidence([(0, 0, s) for s in r["scores"]], r["tokens"])[0], r["toxic"]) for r in scored]
    model.intercept, model.slope = logistic(points)
    return model


def logistic(points: list[tuple[float, int]], ridge: float = 0.01) -> tuple[float, float]:
    """Intercept and slope of P(1 | x) by Newton steps with a small ridge on the slope."""
    ones = sum(y for _, y in points)
    a, b = math.log((ones + 0.5) / (len(points) - ones + 0.5)), 0.0
    for _ in range(50):
        ga = gb = haa = hab = hbb = 0.0
        for x, y in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            w = max(p * (1 - p), 1e-9)
            ga, gb, haa, hab, hbb = ga + y - p, gb + (y - p) * x, haa + w, hab + w * x, hbb + w * x * x
        gb, hbb = gb - ridge * b, hbb + ridge
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (ga * hbb - gb * hab) / det, (gb * haa - ga * hab) / det
        step = min(1.0, 5 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-6:
            break
    return (a, b) if b > 0 else (math.log((ones + 0.5) / (len(points) - ones + 0.5)), 0.0)


def score(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id_column``, the columns ``carry``, ``score`` from 0 to 1 and ``passages`` (start, end, score).

    Starts and ends are code points of the whole text, end exclusive. Null and empty
    texts have no passages and the score of no evidence. Rows are independent, so
    repeated rows give repeated results; null ids stay; columns not named are not read.
    """
    names = list(dict.fromkeys([id_column, *carry]))
    schema = documents.select(*names, F.lit(None).cast("double").alias("score"), F.lit(None).cast(PASSAGES).alias("passages")).schema
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(len(names)):
                evidence, found = scan(text.as_py() or "", model)
                scores.append(model.probability(evidence))
                passages.append([{"start": a, "end": b, "score": s} for a, b, s in found])
            made = [pa.array(scores, pa.float64()), pa.array(passages, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], [*names, "score", "passages"])

    return documents.select(*names, F.col(text_column).alias("scored text")).mapInArrow(run, schema)
