"""Column functions over coded attributes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictflow.session import scratch_path

#: Codes of up to about 100 bytes with their labels: some 20 MB in every executor.
MAX_BROADCAST_CODES = 100_000


def decode(code: Column, labels: dict[str, str]) -> Column:
    """Label of a code; a code without a label passes through unchanged.

    The labels fold into one literal map, so this stays inside the scan stage.
    """
    lookup = F.create_map(*map(F.lit, chain.from_iterable(labels.items())))
    return F.coalesce(lookup[code], code)


def decode_by_table(rows: DataFrame, column: str, codes: DataFrame, *, max_broadcast_rows: int = MAX_BROADCAST_CODES) -> DataFrame:
    """``decode`` with labels from a table of ``code`` and ``label``; unknown and null codes pass through.

    The table is stored and counted. Up to ``max_broadcast_rows`` rows, it goes to every
    task and no row moves; beyond, both sides are shuffled by the code, and Spark splits a
    code that many rows share. Either way a row comes out once: a code that the table has
    twice has its least label.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "codes")
    codes.where("code IS NOT NULL").groupBy("code").agg(F.min("label").alias("label")).write.parquet(path)
    known = spark.read.parquet(path).withColumnsRenamed({"code": "known_code", "label": "known_label"})
    few = known.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows
    known = F.broadcast(known) if few else known.hint("merge")
    joined = rows.join(known, rows[column] == known["known_code"], "left")
    decoded = F.coalesce("known_label", rows[column]).alias(column)
    return joined.select(*[decoded if c == column else rows[c] for c in rows.columns])


def whole_number(value: Column, what: str) -> Column:
    """Integer part of a number; a missing or bad value fails the job."""
    return F.coalesce(value.try_cast("int"), F.raise_error(F.lit(f"no whole number in {what}")).cast("int"))
