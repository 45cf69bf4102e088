"""Exact duplicates by grouping, placed in an extendible-hash index in shared files.

The first pass logs a 64-bit key and a digest per document. Texts are grouped by key and
their bytes over Spark's hash partitions, with partial sums before the shuffle: that is the
comparison of bytes, and it alone gives the decisions. A directory over the leading bits of
the keys doubles until no bucket holds more distinct keys than a task should own; keys are
counted after copies have been merged, so a text that a third of all rows share is one key.
Owner tasks then number the different texts under one key as a chain and write the entries
of groups of several rows to the index; the log is joined with them by key and digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictflow.llm.common import stored

BUCKET_KEYS = 4096
MAX_DEPTH = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower-cased in A-Z only; null is empty. Pure ASCII texts take the JVM's fast way."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def prefix(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def split_directory(counts: dict[int, int], depth: int, bucket_keys: int) -> dict[int, tuple[int, int]]:
    """Bucket (local depth, its prefix) of each slot of the directory at ``depth`` bits.

    ``counts`` has the distinct keys under each prefix of ``depth`` bits. Starting from
    one bucket, the directory is doubled while a bucket is overfull, up to ``depth``.
    """
    slots = {0: (0, 0)}
    for level in range(depth + 1):
        sums: dict[int, int] = {}
        for slot, n in counts.items():
            key = slot >> (depth - level)
            sums[key] = sums.get(key, 0) + n
        overfull = {s for s, (local, _) in slots.items() if local == level and sums.get(s, 0) > bucket_keys}
        if not overfull or level == depth:
            return {s << (depth - level) | low: b for s, b in slots.items() for low in range(1 << (depth - level))}
        doubled = {}
        for s, bucket in slots.items():
            for bit in (0, 1):
                child = s << 1 | bit
                doubled[child] = (level + 1, child) if s in overfull else bucket
        slots = doubled
    raise AssertionError("unreachable")


def directory(log: DataFrame, bucket_keys: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH) -> tuple[int, DataFrame]:
    """Depth, and the bucket of each slot. Both sides are bounded: at most 2 ** ``max_depth`` slots.

    Only the number of distinct keys per slot comes to the driver, no key. At the largest
    depth buckets may stay overfull; they are then only larger.
    """
    keys = log.groupBy("key").agg(F.lit(1).alias("one"))
    at_most = keys.groupBy(prefix(F.col("key"), max_depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["slot"]: r["n"] for r in at_most.collect()}
    buckets = split_directory(counts, max_depth, bucket_keys)
    depth = max((local for local, _ in buckets.values()), default=0)
    slots = sorted({s >> (max_depth - depth): b for s, b in buckets.items()}.items())
    rows = [(s, local, p << (max_depth - local)) for s, (local, p) in slots]
    return depth, log.sparkSession.createDataFrame(rows, "slot int, local_depth int, bucket int")


def exact_groups(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bucket_keys: int = BUCKET_KEYS,
    key=lambda text: F.xxhash64(text),
) -> DataFrame:
    """A row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Equal are texts identical after lower-casing A-Z; null counts as empty. The row with
    the largest id stays, nulls last. ``group_size`` counts rows. Rows that repeat an id
    and its text all carry the same decision. ``bucket`` and ``chain`` place a group of
    several rows in the index (null for a text that occurs once). Other columns are not
    read; an empty table gives no rows.
    """
    text = normalised(F.col(text_column))
    rows = documents.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", key(F.col("text")).alias("key"))
    log = stored(rows.select("doc_id", "key", F.unhex(F.sha2("text", 256)).alias("sha")), "exact-log")
    depth, slots = directory(log, bucket_keys)
    groups = (
        rows.groupBy("key", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(
            "key", prefix(F.col("key"), depth).alias("slot"), F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size",
        )
    )
    entries = groups.join(F.broadcast(slots), "slot")
    # Chains of different texts under one key, within the owner of the bucket's key range.
    chained = entries.repartition("bucket").groupBy("bucket", "key").agg(
        F.sort_array(F.collect_list(F.struct("sha", "keep_id", "group_size"))).alias("chain")
    )
    index = stored(
        chained.select("bucket", "key", F.posexplode("chain").alias("chain", "entry"))
        .select("bucket", "key", "chain", "entry.*")
        .filter("group_size > 1"),
        "exact-index",
    )
    joined = log.join(index, ["key", "sha"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "bucket",
        "chain",
    )
