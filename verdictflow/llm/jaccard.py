"""Jaccard join of 5-word shingle sets by chosen paths.

A path is a sequence of sampled shingles; a document is in the bucket of a path if it
has, and chose, each of them. Each shingle is chosen with probability ``branching`` /
set size by a hash of the path and the shingle, so similar documents choose the same.
Buckets of up to ``limit`` documents are compared pair by pair; larger ones are split
by the next sampled shingle, unless most of what their documents sample is common to
half of them, or the last level is reached: those are compared in tiles of two blocks,
so that no task sees more than a tile. Independent runs are repeated until a pair at the
threshold is missed with probability ``1 - recall`` at most.

Equal sets are one class representative from the start. Verified links are counted where
their pair first meets, by the smallest bucket both are in, and each tile hands on a
spanning forest of its links: no list of pairs is ever made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictflow.llm.common import freed, sorted_side, stored
from verdictflow.llm.components import components
from verdictflow.llm.shingles import Windows, flat, mixed, starts, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
BRANCHING = 2.5
LIMIT = 32
LEVELS = 4
#: A block has at most about so many documents and shingles.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
_PART = 1000


def n_runs(threshold: float, recall: float, branching: float, levels: int) -> int:
    """Runs until a pair at the threshold meets with probability ``recall``.

    Of the larger set, at least the share ``threshold`` is common; so a run chooses
    common shingles like a branching process with ``threshold * branching`` offspring,
    and the pair is missed if it dies out before the last level.
    """
    dies = 0.0
    for _ in range(levels):
        dies = math.exp(-threshold * branching * (1 - dies))
    return max(1, math.ceil(math.log(1 - recall) / math.log(dies)))


def sets_of(column: pa.ListArray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and their document."""
    values, offsets = flat(column)
    begin, document = starts(offsets, shingle)
    if not len(begin):
        return np.zeros(0, np.uint64), document
    found = Windows(values)(begin, begin + shingle)
    order = np.lexsort((found, document))
    found, document = found[order], document[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (document[1:] != document[:-1])
    return found[new], document[new]


def _limits(sizes: np.ndarray, branching: float) -> np.ndarray:
    """A shingle is chosen if its draw is at most this: probability branching / size."""
    share = np.minimum(branching / np.maximum(sizes, 1), 1.0)
    return np.minimum(share * 2.0**64, 2.0**64 - 2048).astype(np.uint64)


def _child(path: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    return mixed(shingle ^ mixed(path + np.uint64(0x9E3779B97F4A7C15)))


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """Values, sorted by owner, as one list for each of ``n`` owners."""
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def signatures(documents: DataFrame, shingle: int, runs: int, branching: float) -> DataFrame:
    """Per row: doc_id, ``t`` (hash of the text), size ``n`` and two hashes of the set, and its paths of one shingle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mixed(np.arange(1, runs + 1, dtype=np.uint64))
        for batch in batches:
            for begin in range(0, batch.num_rows, _PART):
                part = batch.slice(begin, _PART)
                found, owner = sets_of(part.column(2), shingle)
                sizes = np.bincount(owner, minlength=part.num_rows)
                h, g = np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.uint64)
                np.add.at(h, owner, mixed(found))
                np.bitwise_xor.at(g, owner, mixed(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                limit = _limits(sizes, branching)[owner]
                paths, owners = [], []
                for seed in seeds.reshape(-1, 1):  # arrays of one: they wrap around without warnings
                    child = _child(seed, found)
                    chosen = child <= limit
                    paths.append(mixed(child[chosen] + seed)), owners.append(owner[chosen])
                path, own = np.concatenate(paths), np.concatenate(owners)
                order = np.argsort(own, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(sizes.astype(np.int64)),
                        pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), _lists(path[order], own[order], part.num_rows),
                    ],
                    ["doc_id", "t", "n", "h", "g", "paths"],
                )

    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("t"), word_hashes(text).alias("w"))
    return rows.mapInArrow(each, "doc_id long, t long, n long, h long, g long, paths array<long>")


def _candidates(rows: DataFrame, shingle: int, branching: float, levels: int) -> DataFrame:
    """Rows of node, copies, overfull, words -> node, copies, ``found`` (its set) and the paths below the overfull ones."""
    deep_type = pa.list_(pa.struct([("level", pa.int32()), ("parent", pa.int64()), ("m_parent", pa.int64()), ("path", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, _PART):
                part = batch.slice(begin, _PART)
                found, owner = sets_of(part.column(3), shingle)
                ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
                below = []
                for i, overfull in enumerate(part.column(2).to_pylist()):
                    own = found[ends[i] : ends[i + 1]]
                    limit = _limits(np.array([len(own)]), branching)[0]
                    members, rows_ = {x["path"]: x["m"] for x in overfull or []}, []
                    parents = np.array(list(members), np.int64).view(np.uint64)
                    for level in range(2, levels + 1):
                        children = []
                        for parent in parents.reshape(-1, 1):
                            child = _child(parent, own)
                            child = mixed(child[child <= limit] + parent)
                            children.append(child)
                            p = int(parent.view(np.int64)[0])
                            # Known from the start for the buckets of one shingle alone.
                            m = members[p] if level == 2 else None
                            rows_ += [{"level": level, "parent": p, "m_parent": m, "path": c} for c in child.view(np.int64).tolist()]
                        parents = np.concatenate(children) if children else parents
                    below.append(rows_)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), _lists(found, owner, part.num_rows), pa.array(below, deep_type)],
                    ["node", "copies", "found", "below"],
                )

    schema = "node long, copies long, found array<long>, below array<struct<level: int, parent: bigint, m_parent: bigint, path: bigint>>"
    return rows.select("node", "copies", "overfull", "w").mapInArrow(each, schema)


def _leaves(candidates: DataFrame, level1: DataFrame, limit: int, levels: int) -> DataFrame:
    """(node, path): the buckets to compare. Each level is stored, so that the next starts from it."""
    leaves = level1.filter(F.col("m") <= limit)
    members = level1.filter(F.col("m") > limit).select("node", "path", "m")
    for level in range(2, levels + 1):
        below = candidates.select("node", F.explode(F.expr(f"filter(below, x -> x.level = {level})")).alias("x"))
        rows = below.select("node", "x.parent", "x.m_parent", "x.path")
        if level > 2:
            larger = full.select(F.col("path").alias("parent"), F.col("m").alias("m_parent"))
            rows = rows.drop("m_parent").join(sorted_side(larger), "parent")
        counts = rows.groupBy("parent", "m_parent", "path").agg(F.count(F.lit(1)).alias("m"))
        counts = stored(counts, "jaccard-level")
        # Where documents sample mostly what half of them sample, splitting would not part them.
        common = F.sum(F.when(F.col("m") * 2 >= F.col("m_parent"), F.col("m")).otherwise(0))
        dense = counts.groupBy("parent").agg((common * 2 >= F.sum("m")).alias("dense")).filter("dense")
        dense = stored(dense.select(F.col("parent").alias("path")), "jaccard-dense")
        leaves = leaves.unionByName(members.join(sorted_side(dense), "path", "left_semi").select("node", "path", "m"))
        split = counts.filter("m > 1").join(sorted_side(dense.withColumnRenamed("path", "parent")), "parent", "left_anti")
        split = stored(split.select("path", "m"), "jaccard-split")
        rows = rows.select("node", "path").join(sorted_side(split), "path").select("node", "path", "m")
        last = level == levels
        leaves = leaves.unionByName(rows if last else rows.filter(F.col("m") <= limit))
        members = rows.filter(F.col("m") > limit)
        full = None if last else stored(split.filter(F.col("m") > limit), "jaccard-full")
    return leaves.select("node", "path")


def _tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        path, low, high, block, node, copies = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:6])
        (found, fo), (buckets, bo) = flat(batch.column(6)), flat(batch.column(7))
        buckets = buckets.view(np.int64)
        for i in range(batch.num_rows):
            key = (int(path[i]), int(low[i]), int(high[i]))
            yield key, int(block[i]), int(node[i]), int(copies[i]), found[fo[i] : fo[i + 1]].copy(), buckets[bo[i] : bo[i + 1]].copy()


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``left`` with those at ``right``."""
    if len(left) == 1 and len(right) == 1:
        return np.array([[len(np.intersect1d(sets[left[0]], sets[right[0]], assume_unique=True))]])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[place] > 1  # a value of one set only is in no intersection
    owner, place = owner[shared], np.unique(place[shared], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.int64)
    width = int(place.max()) + 1 if len(place) else 0
    for begin in range(0, width, 4096):
        here = (place >= begin) & (place < begin + 4096)
        has = np.zeros((len(sets), 4096), np.float32)
        has[owner[here], place[here] - begin] = 1
        out += (has[left] @ has[right].T).astype(np.int64)
    return out


def compare_tile(rows: list[tuple], threshold: float) -> list[tuple[int, int, int]]:
    """(node, smallest node linked with it here, links) of the nodes with links that are counted in this tile.

    A link counts for as many documents as there are copies of its other end.
    """
    (path, low, high), sets = rows[0][0], [r[4] for r in rows]
    blocks, nodes, copies = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    left, right = (np.arange(len(rows)),) * 2 if low == high else (np.flatnonzero(blocks == low), np.flatnonzero(blocks == high))
    if not len(left) or not len(right) or len(rows) < 2:
        return []
    if low == high and len(rows) == 2:
        left, right = np.array([0]), np.array([1])
    sizes = np.array([len(s) for s in sets])
    both = _common(sets, left, right)
    union = sizes[left][:, None] + sizes[right][None, :] - both
    linked = both >= threshold * union - 1e-9
    if low == high and len(left) > 1:
        linked &= left[:, None] < right[None, :]
    if not linked.any():
        return []
    # The pair counts here if this is the smallest bucket that both are in.
    earlier = [r[5][r[5] < path] for r in rows]
    if any(map(len, earlier)):
        linked &= _common(earlier, left, right) == 0
    one, two = np.nonzero(linked)
    one, two = left[one], right[two]
    links = np.bincount(one, copies[two], len(rows)) + np.bincount(two, copies[one], len(rows))
    root = list(range(len(rows)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(one.tolist(), two.tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            a, b = (a, b) if nodes[a] < nodes[b] else (b, a)
            root[b] = a
    return [(int(nodes[i]), int(nodes[top(i)]), int(n)) for i, n in enumerate(links.tolist()) if n]


def _compare(buckets: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """(node, root, links) of each tile of each bucket."""
    held = buckets.groupBy("node").agg(F.collect_list("path").alias("buckets"))
    sets = candidates.select("node", "copies", "found").join(sorted_side(held), "node")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rows = buckets.select("node", "path", blocks.alias("blocks"), F.pmod(F.xxhash64("node", "path"), blocks).cast("int").alias("block"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = rows.join(sorted_side(sets), "node").select(
        "path", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "found", "buckets",
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["node", "root", "links"])

        for _, tile in groupby(_tile_rows(batches), key=lambda r: r[0]):
            out += compare_tile(list(tile), threshold)
            if len(out) > 5000:
                yield made()
                out = []
        if out:
            yield made()

    keys = ["path", "low", "high"]
    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, "node long, root long, links long")


def near_duplicates(
    documents: DataFrame,
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    recall: float = RECALL,
    branching: float = BRANCHING,
    limit: int = LIMIT,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per input row of doc_id (an integer), text: doc_id, class_id, n_links.

    Linked are documents whose sets of ``shingle``-word windows have a Jaccard similarity
    of ``threshold`` or more; ``n_links`` is their number, copies included; a class is
    what links connect, named by its smallest id. Texts of fewer than ``shingle`` words
    (null and empty ones too) have no windows and no links. Rows without an id have class
    null and no links. Rows that repeat an id and its text are copies of each other.
    Other columns are not read; an empty table gives no rows.
    """
    runs = n_runs(threshold, recall, branching, levels)
    rows = stored(signatures(documents, shingle, runs, branching), "jaccard-signatures")
    classes, candidates, level1 = _classes(rows, documents, shingle, branching, levels, limit)
    leaves = stored(_leaves(candidates, level1, limit, levels), "jaccard-leaves")
    freed(level1)
    # Buckets of the same documents are compared once: same number and same hashes of the
    # members. Two whose sizes alone keep them under the threshold are not compared.
    mark = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    sizes = [F.sum("n").alias("shingles"), F.min("n").alias("least"), F.max("n").alias("most")]
    members = leaves.join(sorted_side(classes.select("node", "n")), "node").groupBy("path").agg(F.count(F.lit(1)).alias("m"), *sizes, *mark)
    members = members.filter((F.col("m") > 2) | (F.col("least") >= threshold * F.col("most") - 1e-9))
    once = members.groupBy("m", "x1", "x2").agg(F.min("path").alias("path"), F.first("shingles").alias("shingles"))
    once = stored(once.select("path", "m", "shingles"), "jaccard-once")
    buckets = stored(leaves.join(sorted_side(once), "path"), "jaccard-buckets")
    freed(leaves, once)
    links = stored(_compare(buckets, candidates, threshold), "jaccard-links")
    freed(buckets, candidates)

    labels = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    labelled = classes.select("node", "doc_id").join(sorted_side(labels), "node").groupBy("label").agg(F.min("doc_id").alias("class"))
    labels = labels.join(sorted_side(labelled), "label").select("node", "class")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    told = classes.select("n", "h", "g", "node", "doc_id", "copies")
    told = told.join(sorted_side(counted), "node", "left").join(sorted_side(labels), "node", "left")
    told = told.select("n", "h", "g", F.coalesce("class", "doc_id").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    told = stored(told.filter("n_links > 0"), "jaccard-told")
    freed(classes, links)
    return rows.select("doc_id", "n", "h", "g").join(sorted_side(told), ["n", "h", "g"], "left").select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def _classes(
    rows: DataFrame, documents: DataFrame, shingle: int, branching: float, levels: int, limit: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal sets, a ``node`` each; the candidates among them with their sets; and their buckets of one shingle.

    A node is the class's smallest id, or a number above 2^62 made from it and the set where
    that id is the smallest of several classes, as texts that share an id may be.
    """
    known = rows.filter("n > 0 and doc_id is not null")
    classes = known.groupBy("n", "h", "g").agg(
        F.min(F.struct("doc_id", "t")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("paths").alias("paths")
    )
    classes = stored(classes.select("n", "h", "g", "first.doc_id", "first.t", "copies", "paths"), "jaccard-sets")
    several = classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select(F.col("doc_id").alias("several"))
    made = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", "n", "h", "g"), 2)
    unnamed, several = classes, stored(several, "jaccard-several")
    classes = classes.join(several, classes["doc_id"] == several["several"], "left")
    node = F.when(F.col("several").isNull(), F.col("doc_id")).otherwise(made)
    classes = stored(classes.select("n", "h", "g", "doc_id", "t", "copies", "paths", node.alias("node")), "jaccard-classes")
    freed(unnamed, several)

    paths = classes.select("node", F.explode("paths").alias("path"))
    shared = stored(paths.groupBy("path").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "jaccard-shared")
    level1 = stored(paths.join(sorted_side(shared), "path").select("node", "path", "m"), "jaccard-level")
    freed(shared)
    overfull = F.collect_list(F.when(F.col("m") > limit, F.struct("path", "m"))).alias("overfull")
    wanted = level1.groupBy("node").agg(overfull).join(sorted_side(classes.select("node", "doc_id", "t", "copies")), "node")
    wanted = stored(wanted, "jaccard-wanted")
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = text.select("doc_id", F.xxhash64("text").alias("t"), "text")
    # Rows that repeat an id and its text have one text; any of them will do.
    texts = text.join(sorted_side(wanted), ["doc_id", "t"]).groupBy("node", "copies", "overfull").agg(F.first("text").alias("text"))
    candidates = _candidates(texts.withColumn("w", word_hashes(F.col("text"))), shingle, branching, levels)
    candidates = stored(candidates, "jaccard-candidates")
    freed(wanted)
    return classes, candidates, level1
