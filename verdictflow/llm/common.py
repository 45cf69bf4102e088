"""Text columns and shared storage that several operators use."""

from __future__ import annotations

import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.session import delete_folder, scratch_path

#: A word is a run without the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Deletes the shuffle files of a query when it ends; nothing reads those of a stored table again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows written to shared storage and read back: cuts lineage, survives lost executors.

    The files stay until the application ends, or until ``freed``; the shuffle files of the
    write go with it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    _folders[found] = path
    return found


def freed(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read any more; what was made of them has to be stored."""
    for df in tables:
        delete_folder(df.sparkSession, _folders.pop(df))


def sorted_side(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the data: joined by sorting at any size, never broadcast."""
    return df.hint("merge")


def words(text: Column) -> Column:
    """Array of words, empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, also where ``then`` loops over an array."""
    return F.transform(F.array(value), then)[0]
