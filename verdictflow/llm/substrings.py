"""Repeated passages by seed and extend.

Seeds: each window of ``size`` words is represented by its anchor, the 3-word gram with
the smallest hash in it, grams of long words first. Consecutive windows with one anchor
form a run; about one word in six begins one. Documents meet on anchors that occur in
several of them; all other text is out of the game after one narrow shuffle.

Extension: a run reaches as far left and right of its anchor as its windows do. Runs
with the same words throughout are settled at once: all but those of the smallest id are
repeats. Only the runs of the smallest id of anchors that stand in different contexts go
on: their windows are read from the text and compared one by one.

The repeated windows of a document, joined, are its maximal repeats of at least
``size`` words. Windows are compared by two 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictflow.llm.common import stored
from verdictflow.llm.shingles import flat, mixed, starts, two_hashes, word_hashes

SIZE = 13
GRAM = 3
#: Anchors in at least HOT_COUNT of about HOT_SAMPLE documents are hot.
HOT_SAMPLE, HOT_COUNT = 10_000, 10
SALTS = 1024
_PART = 1000

RUNS = "a long, s long, p int, r int, hot boolean"


def winnowed(values: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Of each run: document, first window, number of windows, anchor hash, hash of its words."""
    begin, document = starts(offsets, size)
    if not len(begin):
        return document, begin, begin, begin.astype(np.uint64), begin.astype(np.uint64)
    grams = len(values) - GRAM + 1
    anchors, _ = two_hashes(values)
    at = np.arange(grams)
    gram = anchors(at, at + GRAM)
    short = sum((values[j : grams + j] & np.uint64(1)) for j in range(GRAM))
    order = (short << np.uint64(62)) | (gram >> np.uint64(2))
    least = np.lib.stride_tricks.sliding_window_view(order, size - GRAM + 1).argmin(axis=1)
    anchor = begin + least[begin]
    new = np.ones(len(begin), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (begin[1:] != begin[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(begin)))
    a, b = begin[first], begin[first] + length + size - 1
    _, spans = two_hashes(values)
    return document[first], a, length, mixed(gram[anchor[first]]), spans(a, b)


def runs(documents: DataFrame, size: int, hot: list[int]) -> DataFrame:
    """A row per run: doc_id, anchor ``a``, words ``s``, first window ``p``, windows ``r``, ``hot``."""
    schema = documents.select("doc_id").schema
    for field in documents.sparkSession.createDataFrame([], RUNS).schema:
        schema = schema.add(field)
    known = np.array(sorted(hot), np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, _PART):
                part = batch.slice(begin, _PART)
                values, offsets = flat(part.column(1))
                document, at, length, anchor, span = winnowed(values, offsets, size)
                anchor = anchor.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(document)), pa.array(anchor), pa.array(span.view(np.int64)),
                        pa.array((at - offsets[:-1][document]).astype(np.int32)), pa.array(length.astype(np.int32)),
                        pa.array(np.isin(anchor, known)),
                    ],
                    ["doc_id", "a", "s", "p", "r", "hot"],
                )

    rows = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", word_hashes(F.col("text")).alias("w"))
    return rows.mapInArrow(each, schema)


def hot_anchors(documents: DataFrame, size: int) -> list[int]:
    """Anchors that are in a thousandth of all documents or more, by a bounded sample.

    They only take another way: known to repeat, they need not meet in one task to find
    that out. The list is bounded by the anchors of ``HOT_SAMPLE`` documents / ``HOT_COUNT``.
    """
    every = max(1, documents.count() // HOT_SAMPLE)
    sample = documents.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    counts = runs(sample, size, []).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return [r["a"] for r in counts.filter((F.col("n") >= HOT_COUNT) & (F.col("low") < F.col("high"))).select("a").collect()]


def seeds(documents: DataFrame, size: int) -> DataFrame:
    """The runs whose anchor occurs in several documents, stored.

    Where an anchor's runs meet in one task, they are settled there: ``covered`` says
    whether the run is a repeat; those that are neither that nor to be compared window by
    window are left out. Hot anchors are dealt over many tasks, as one that a third of
    all documents hold would fill any: their runs keep ``a`` and ``s``, to be summed.
    """
    found = runs(documents, size, hot_anchors(documents, size))
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) + 1).otherwise(0)
    found = found.withColumn("salt", spread.cast("int"))
    span, own = Window.partitionBy("a", "salt", "s"), Window.partitionBy("a", "salt")
    found = found.withColumn("low", F.min("doc_id").over(span))
    found = found.select("*", F.min("doc_id").over(own).alias("first"), F.max("doc_id").over(own).alias("last"), (F.min("s").over(own) < F.max("s").over(own)).alias("several"))
    covered = F.col("doc_id") > F.col("low")
    kept = found.filter(F.col("hot") | (F.col("first") < F.col("last")) & (covered | F.col("several")))
    if_hot = lambda c: F.when(F.col("hot"), F.col(c)).alias(c)
    return stored(kept.select("doc_id", "p", "r", if_hot("a"), if_hot("s"), F.when(~F.col("hot"), covered).alias("covered")), "substring-seeds")


def settled(found: DataFrame) -> DataFrame:
    """Per document ``marks`` (p, r, covered): runs that are repeats, and those whose windows are to be compared.

    A run is a repeat if a smaller id has the same words under the same anchor. The runs
    of the smallest id are compared where the anchor also stands among other words.
    """
    hot = found.filter("a is not null")
    spans = stored(hot.groupBy("a", "s").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "substring-spans")
    contexts = spans.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("first"), F.max("high").alias("last"))
    several = stored(contexts.filter("n > 1 and first < last").select("a", F.lit(True).alias("several")), "substring-several")
    told = spans.join(several, "a", "left").filter("low < high or several")
    told = stored(told.select("a", "s", "low", F.coalesce("several", F.lit(False)).alias("several")), "substring-told")
    rows = hot.join(told, ["a", "s"]).select("doc_id", "p", "r", (F.col("doc_id") > F.col("low")).alias("covered"), "several")
    rows = rows.filter("covered or several").drop("several").unionByName(found.filter("a is null").select("doc_id", "p", "r", "covered"))
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct("p", "r", "covered")).alias("marks"))


def _kept(text: str | None, covered: np.ndarray) -> tuple[int, str]:
    """Words removed, and the hash of the others joined by one space."""
    found = (text or "").encode().split()
    drop = covered[: len(found)]
    kept = [w for w, gone in zip(found, drop.tolist(), strict=True) if not gone] if drop.any() else found
    return len(found) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _cover(size: int, n_words: int, begin, windows) -> np.ndarray:
    """Which words are in the windows: ``windows`` of them from each of ``begin`` on."""
    steps = np.zeros(n_words + 1, np.int64)
    begin = np.asarray(begin, np.int64)
    np.add.at(steps, np.minimum(begin, n_words), 1)
    np.add.at(steps, np.minimum(begin + np.asarray(windows, np.int64) + size - 1, n_words), -1)
    return np.cumsum(steps[:-1]) > 0


def _extend(rows: DataFrame, size: int) -> DataFrame:
    """Results of documents without open windows; texts, repeats and open windows of the others."""
    schema = (
        "n_words long, n_removed long, kept_sha256 string, text string, "
        "repeats array<struct<p: int, r: int>>, open array<struct<h: bigint, g: bigint, p: int>>"
    )
    out = rows.select("doc_id").schema
    for field in rows.sparkSession.createDataFrame([], schema).schema:
        out = out.add(field)
    names = out.names
    repeat_type = pa.list_(pa.struct([("p", pa.int32()), ("r", pa.int32())]))
    open_type = pa.list_(pa.struct([("h", pa.int64()), ("g", pa.int64()), ("p", pa.int32())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, _PART):
                part = batch.slice(begin, _PART)
                values, offsets = flat(part.column(3))
                first, second = two_hashes(values)
                columns: list[list] = [[] for _ in range(6)]
                for i, (text, marks) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    n = int(offsets[i + 1] - offsets[i])
                    sure = [(m["p"], m["r"]) for m in marks or () if m["covered"] and m["p"] + m["r"] + size - 1 <= n]
                    unsure = [m["p"] + j for m in marks or () if not m["covered"] for j in range(m["r"]) if m["p"] + j + size <= n]
                    if not unsure:
                        removed, digest = _kept(text, _cover(size, n, [p for p, _ in sure], [r for _, r in sure]))
                        row = (n, removed, digest, None, None, None)
                    else:
                        at = np.unique(np.array(unsure, np.int64))
                        h, g = (f(at + offsets[i], at + offsets[i] + size).view(np.int64).tolist() for f in (first, second))
                        open_ = [{"h": a, "g": b, "p": p} for a, b, p in zip(h, g, at.tolist(), strict=True)]
                        row = (n, None, None, text, [{"p": p, "r": r} for p, r in sure], open_)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), repeat_type, open_type]
                made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names)

    return rows.select("doc_id", "text", "marks", word_hashes(F.col("text")).alias("w")).mapInArrow(each, out)


def _finish(rows: DataFrame, size: int) -> DataFrame:
    out = rows.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_sha256")).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests = [], []
            for n, text, repeats, more in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                begin = [x["p"] for x in repeats or ()] + (more or [])
                windows = [x["r"] for x in repeats or ()] + [1] * len(more or [])
                gone, digest = _kept(text, _cover(size, n, begin, windows))
                removed.append(gone), digests.append(digest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return rows.select("doc_id", "n_words", "text", "repeats", "more").mapInArrow(each, out)


def remove_repeats(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per input row of doc_id, text: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``size`` words that covers it also starts in a document
    with a smaller id; repeats within one document stay. Windows are those of the input.
    Null and empty texts have no words. Rows without an id neither lose words nor make
    others lose any. Rows that repeat an id count as one document; should their texts
    differ, the places found in any apply to all. Other columns are not read; an empty
    table gives no rows.
    """
    marks = settled(seeds(documents, size))
    extended = stored(_extend(documents.select("doc_id", "text").join(marks, "doc_id", "left"), size), "substring-extended")
    pending = extended.filter("open is not null")
    windows = pending.select("doc_id", F.explode("open").alias("x")).select("doc_id", "x.*")
    first = stored(windows.groupBy("h", "g").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").drop("high"), "substring-windows")
    later = windows.join(first, ["h", "g"]).filter("doc_id > low").groupBy("doc_id").agg(F.collect_list("p").alias("more"))
    finished = _finish(pending.join(later, "doc_id", "left"), size)
    done = extended.filter("open is null").select("doc_id", "n_words", "n_removed", "kept_sha256")
    return done.unionByName(finished)
