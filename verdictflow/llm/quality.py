"""Quality rules as decision lists learned from labels, in DataFrame functions only.

Statistics are columns of one row per document. Sequential covering grows a rule as a
conjunction of threshold conditions by FOIL gain on two thirds of the labelled rows,
prunes it on the rest, keeps it if it is precise there, and goes on with the rows it
leaves. Each step asks Spark for one histogram per statistic, so only counts per
candidate threshold reach the driver. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictflow.llm.common import let, stored, words

SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50

#: Statistics the rules may test, all shares that don't grow with the text.
STATISTICS = {
    "mean_word": "word_chars / n_words",
    "symbol_share": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / word_chars",
    "mark_share": "n_marks / n_words",
    "words_per_line": "n_words / n_lines",
}


def repeat_words(w: Column) -> Column:
    """Words of array ``w`` inside 3-word windows that occur twice or more in it.

    Windows are compared by two 64-bit hashes of their words.
    """

    def windows(i: Column) -> Column:
        three = [F.get(w, i + k) for k in range(3)]
        return F.struct(F.xxhash64(*three).alias("a"), F.xxhash64(F.lit(7), *three[::-1]).alias("b"), i.alias("i"))

    def places(s: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            x, y = F.get(s, i), F.get(s, j)
            return (x["a"] == y["a"]) & (x["b"] == y["b"])

        n = F.size(s)
        twice = F.filter(s, lambda x, i: ((i > 0) & same(i, i - 1)) | ((i < n - 1) & same(i, i + 1)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.when(i < F.size(p) - 1, F.least(F.get(p, i + 1) - x, F.lit(3))).otherwise(3))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    at = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    return let(F.sort_array(F.transform(at, windows)), lambda s: let(places(s), covered))


def text_statistics(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts over each whole text, all long; null texts are empty."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = documents.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    dup_lines = let(
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        lambda lines: F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup")),
    )
    by_word = let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("repeat")))
    found = rows.select(
        "doc_id",
        by_word.alias("w"),
        dup_lines.alias("lines"),
        F.length(F.regexp_replace("text", SPACES, "")).alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("text", F.lit(r"[!?]")).alias("n_marks"),
    )
    counts = {
        "n_words": F.col("w.n"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"),
        "n_dup_lines": F.col("lines.dup"), "n_repeat_words": F.col("w.repeat"), "n_lines": F.col("lines.n"),
        "n_upper": F.col("n_upper"), "n_marks": F.col("n_marks"),
    }
    return found.select("doc_id", *[c.cast("long").alias(name) for name, c in counts.items()])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


#: Gains of at least this share of the best count as equal to it.
NEARLY = 0.8

Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def rule_number(rules: list[Rule]) -> Column:
    """The place of the first rule that holds, from 0; null if none does."""
    return reduce(lambda case, r: case.when(_all(r[1]), r[0]), list(enumerate(rules)), F.when(F.lit(False), -1))


def _thresholds(rows: DataFrame, bins: int) -> dict[str, list[tuple[float, float]]]:
    """Cuts of each statistic: percentiles, least and largest value of both classes, and the middles between."""
    at = [i / bins for i in range(1, bins)]
    wanted = []
    for s in STATISTICS:
        for bad in (0, 1):
            own = F.when(F.col("bad") == bad, F.col(s))
            wanted += [F.percentile_approx(own, at, 10_000).alias(f"{s}_{bad}"), F.array(F.min(own), F.max(own)).alias(f"{s}_{bad}_ends")]
    row = rows.agg(*wanted).first()
    found = {s: {v for bad in (0, 1) for v in [*(row[f"{s}_{bad}"] or ()), *row[f"{s}_{bad}_ends"]] if v is not None} for s in STATISTICS}
    return {s: _with_middles(cuts) for s, cuts in found.items()}


def _with_middles(cuts: set[float]) -> list[tuple[float, float]]:
    """The cuts of both classes in order, and the middle between each two with the share of the range that lies between."""
    own = sorted(cuts)
    middles = {(a + b) / 2: (b - a) / (own[-1] - own[0]) for a, b in zip(own, own[1:], strict=False) if a < (a + b) / 2 < b}
    return sorted([(v, 0.0) for v in own] + list(middles.items()))


def _gain(p: int, n: int, before: float) -> float:
    return p * (math.log2(p / (p + n)) - before) if p else 0.0


def learn_rules(
    labelled: DataFrame, max_rules: int = 8, max_conditions: int = 3, bins: int = 32, min_rows: int = 20, min_precision: float = 0.95
) -> list[Rule]:
    """Rules that mark bad rows, from rows of the statistics, ``bad`` (0 or 1) and ``prune`` (boolean).

    All labelled rows count; the driver sees thresholds and counts only. A list has at most
    ``max_rules`` rules of at most ``max_conditions`` conditions each, and cuts come from
    ``bins`` percentiles of each class: those bound what is learned, not what is read. A rule
    stays if at least ``min_precision`` of the ``min_rows`` or more pruning rows it covers are
    bad. Of cuts with gains within ``NEARLY`` of the best, the one in the widest gap is taken,
    then that of the larger gain, then the first by the statistic's name.
    """
    cuts = _thresholds(labelled, bins)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = labelled.filter(~reduce(lambda a, b: a | b, map(_all, rules), F.lit(False)))
        rule = _grow(left.filter(~F.col("prune")), cuts, max_conditions, min_rows)
        if not rule:
            break
        rule, bad, all_rows = _prune(left.filter("prune"), rule)
        if all_rows * 2 < min_rows or bad < min_precision * all_rows:
            break
        rules.append(rule)
    return rules


def _bin(statistic: str, cuts: list[tuple[float, float]]) -> Column:
    value = F.col(statistic)
    return F.size(F.filter(F.array(*[F.lit(c) for c, _ in cuts]), lambda cut: value > cut))


def _grow(rows: DataFrame, cuts: dict[str, list[tuple[float, float]]], max_conditions: int, min_rows: int) -> Rule:
    rule: Rule = ()
    while len(rule) < max_conditions:
        # Per statistic, the number of cuts below the value: one partial sum per task and bin.
        held = rows.filter(_all(rule))
        below = [F.struct(F.lit(s).alias("s"), _bin(s, cuts[s]).alias("bin")) for s in STATISTICS if cuts[s]]
        if not below:
            return rule
        counted = held.select("bad", F.explode(F.array(*below)).alias("x")).groupBy("x.s", "x.bin").agg(F.sum("bad").alias("p"), F.count("bad").alias("all"))
        histogram: dict[str, dict[int, tuple[int, int]]] = {}
        for r in counted.collect():
            histogram.setdefault(r["s"], {})[r["bin"]] = (r["p"] or 0, r["all"] - (r["p"] or 0))
        if not histogram:
            return rule
        some = next(iter(histogram.values()))
        p0, n0 = (sum(x[k] for x in some.values()) for k in (0, 1))
        if not p0 or not n0:
            return rule
        before, found = math.log2(p0 / (p0 + n0)), []
        for s, bins in sorted(histogram.items()):
            p = n = 0
            for place, (cut, gap) in enumerate(cuts[s]):
                p, n = p + bins.get(place, (0, 0))[0], n + bins.get(place, (0, 0))[1]
                for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    if a + b >= min_rows and _gain(a, b, before) > 1e-9:
                        found.append((_gain(a, b, before), gap, Condition(s, above, cut)))
        if not found:
            return rule
        # Of nearly equal gains, the cut with most room on either side; of those, the first by name.
        most = max(gain for gain, _, _ in found)
        rule += (max(((gap, gain, c) for gain, gap, c in found if gain >= NEARLY * most), key=lambda x: x[:2])[2],)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The part of the rule with the best (p - n) / (p + n) on the pruning rows; its bad and all rows."""
    parts = [rule[:k] for k in range(1, len(rule) + 1)] + [rule[k:] for k in range(1, len(rule))]
    sums = [f(F.when(_all(part), F.col("bad"))).alias(f"{name}{k}") for k, part in enumerate(parts) for name, f in (("p", F.sum), ("n", F.count))]
    row = rows.agg(*sums).first()
    scored = [(part, row[f"p{k}"] or 0, row[f"n{k}"]) for k, part in enumerate(parts)]
    return max(scored, key=lambda x: ((2 * x[1] - x[2]) / x[2] if x[2] else -1, -len(x[0])))


def quality(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **learning) -> DataFrame:
    """Statistics, ``base_failed``, ``rule`` (place of the first rule that holds, or null) and ``kept``.

    Rules are learned from all rows of ``labels`` (doc_id, quality 0 or 1) whose document
    passes the base rules; the text is read once, for the statistics, which are stored.
    Without labels of both kinds there are no rules. Null and empty texts have no words
    and fail the base rule; null ids and labels don't teach. Repeated rows get repeated
    results; other columns are not read; an empty table gives no rows.
    """
    rows = stored(text_statistics(documents, id_column, text_column), "quality-statistics")
    rows = rows.select("*", base_failed().alias("base_failed"))
    # The shares are null where there is nothing to divide by; no rule holds then.
    rows = rows.select("*", *[F.when(F.col("n_words") > 0, F.expr(e)).alias(s) for s, e in STATISTICS.items()])
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.max(1 - F.col("quality")).cast("int").alias("bad"))
    labelled = rows.filter(~F.col("base_failed")).join(known, "doc_id")
    labelled = stored(labelled.select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"), *STATISTICS), "quality-labelled")
    rules = learn_rules(labelled, **learning)
    return rows.withColumn("rule", rule_number(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
