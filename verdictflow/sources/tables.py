"""Catalogs, databases and the scored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.operators.snapshots import create_snapshot_table, read_latest
from verdictflow.schemas import SCORED_TABLE_SCHEMA


def register_catalog(spark: SparkSession, name: str, implementation: str, **options: str) -> None:
    """Declare a catalog of a connector that is on the classpath, unless it is.

    Credentials belong in the session's own configuration, not here.
    """
    key = f"spark.sql.catalog.{name}"
    if spark.conf.get(key, None) is None:
        for option, value in options.items():
            spark.conf.set(f"{key}.{option}", value)
        spark.conf.set(key, implementation)


def use_catalog(spark: SparkSession, name: str) -> None:
    spark.catalog.setCurrentCatalog(name)


def create_database(spark: SparkSession, name: str, warehouse: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{warehouse}'")


def create_stream_view(stream: DataFrame, name: str) -> None:
    """Name a stream for SQL, unless the name is taken."""
    if not stream.sparkSession.catalog.tableExists(name):
        stream.createTempView(name)


def create_scored_table(spark: SparkSession, table: str) -> None:
    """The four columns, no key."""
    create_snapshot_table(spark, table, SCORED_TABLE_SCHEMA)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """The latest state of a scored table."""
    return read_latest(spark, table).select(*SCORED_TABLE_SCHEMA.fieldNames())


def head_rows(df: DataFrame, *order: str, rows: int = 10) -> DataFrame:
    """First rows in a fixed order; each task keeps its own top rows only."""
    return df.orderBy(*map(F.col, order)).limit(rows)
