"""Delimited application files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictflow.operators.row_id import number_rows
from verdictflow.schemas import APPLICATION_FILE_SCHEMA

LINE = "line"


def scan_applications(
    spark: SparkSession, path: str, schema: T.StructType = APPLICATION_FILE_SCHEMA
) -> DataFrame:
    """Rows of a headerless file with one space between fields.

    The schema is given, so nothing is read to infer it and only the columns used
    later are parsed. A value that does not fit its column fails the job.
    """
    return spark.read.schema(schema).options(sep=" ", mode="FAILFAST").csv(path)


def scan_or_reject(
    spark: SparkSession, path: str, schema: T.StructType = APPLICATION_FILE_SCHEMA
) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the lines that do not: both sides of one parse.

    A row has ``row_id`` (its place in the files, as ``number_rows`` counts lines, good and
    bad ones alike) and the fields; a rejected line has row_id, ``file``, ``line`` (its text)
    and ``reason``: another number of fields than the schema has, or the first field that
    does not fit its type. An empty field is a null, as in ``scan_applications``; empty lines
    are no rows. Nothing fails and nothing is dropped.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField(LINE, T.StringType())])
    # Pruned, a parser that reads three fields would not see that a line ends after ten.
    options = {"sep": " ", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": LINE, "columnPruning": False}
    lines = spark.read.schema(as_text).options(**options).csv(path)
    lines = number_rows(lines, "row_id", file_column="file")
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema}
    whole = F.col(LINE).isNull()
    unfit = [
        F.when(F.col(f.name).isNotNull() & typed[f.name].isNull(), F.concat(F.lit(f"no {f.dataType.simpleString()} in {f.name}: "), f.name))
        for f in schema
        if not isinstance(f.dataType, T.StringType)
    ]
    reason = F.when(~whole, F.lit(f"not {len(schema)} fields")).otherwise(F.coalesce(*unfit) if unfit else F.lit(None))
    judged = lines.withColumn("reason", reason)
    text = F.coalesce(F.col(LINE), F.concat_ws(" ", *[F.coalesce(f.name, F.lit("")) for f in schema]))
    good = judged.where("reason IS NULL").select("row_id", *[c.alias(name) for name, c in typed.items()])
    return good, judged.where("reason IS NOT NULL").select("row_id", "file", text.alias(LINE), "reason")
