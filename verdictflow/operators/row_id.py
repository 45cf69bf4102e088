"""Dense row numbers in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictflow.session import scratch_path

#: The split table is always broadcast: 20 bytes a split, a million splits at 128 TB.
MAX_SPLITS = 8_000_000
_SPLITS = "spark.sql.files.minPartitionNum"


def number_rows(scan: DataFrame, id_column: str = "row_id", file_column: str | None = None) -> DataFrame:
    """Number the rows of a file scan from 0, by file path, then place in the file.

    A first pass counts the rows of each input split. The counts, one row per
    split, give every split its first number; the second pass adds the place
    within the split. The rows are neither shuffled nor sorted. Both passes must see
    the same splits, so the session's smallest number of splits, which Spark would
    take from the cores it has at the moment, is fixed unless it is set. Should the
    second pass see other splits all the same, the job fails instead of misnumbering.
    """
    spark = scan.sparkSession
    if spark.conf.get(_SPLITS, None) is None:
        spark.conf.set(_SPLITS, spark.sparkContext.defaultParallelism)
    place = [F.col(f"_metadata.{name}") for name in ("file_path", "file_block_start", "file_block_length")]
    placed = scan.select(
        place[0].alias("file"),
        place[1].alias("start"),
        F.spark_partition_id().alias("task"),
        F.xxhash64(*place).alias("split"),
        F.monotonically_increasing_id().alias("place"),
        *scan.columns,
    )
    counts = placed.groupBy("task", "split", "file", "start").agg(F.count("*").alias("rows"), F.min("place").alias("first_place"))
    # One task orders the splits, not the rows.
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first_place")
    path = scratch_path(spark, "splits")
    counts.select("task", "split", shift.alias("shift")).write.parquet(path)
    splits = spark.read.parquet(path)
    n, distinct = splits.agg(F.count("*"), F.count_distinct("task", "split")).first()
    if n > MAX_SPLITS or n > distinct:
        raise ValueError(f"{n} splits, {distinct} of them distinct: more than {MAX_SPLITS}, or two that look alike")
    moved = F.raise_error(F.lit("the file splits changed between the two passes")).cast("bigint")
    row_id = F.coalesce(F.col("place") + F.col("shift"), moved)
    named = [F.col("file").alias(file_column)] if file_column else []
    return placed.join(F.broadcast(splits), ["task", "split"], "left").select(row_id.alias(id_column), *named, *scan.columns)


def unique_row_ids(scan: DataFrame, id_column: str = "row_id") -> DataFrame:
    """Unique but not dense numbers, in one pass."""
    return scan.select(F.monotonically_increasing_id().alias(id_column), *scan.columns)
