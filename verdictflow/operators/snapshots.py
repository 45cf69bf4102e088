"""Snapshots: each commit is one partition of the table, numbered upwards.

A commit counts from the moment its folder has Spark's completion mark to the moment
the mark is gone. What was committed can be read off the folders alone, so a table
survives the session and the catalog it was made in, and a crash at any point leaves
either the commit or nothing of it.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictflow.session import delete_folder, file_exists, list_paths, move_folder

_KEYS = ("snapshot_id", "commit_name")
_STATEMENT_PARTITIONS = 500

Commit = tuple[int, str]


def create_snapshot_table(spark: SparkSession, table: str, schema: T.StructType) -> None:
    """A table without a key, in the folder of its database, unless it is there.

    A catalog that does not know the table yet finds its commits in the folder.
    """
    database, _, name = table.rpartition(".")
    folder = f"{spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri}/{name}"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}, snapshot_id BIGINT, commit_name STRING) "
        f"USING parquet PARTITIONED BY (snapshot_id, commit_name) LOCATION '{folder}'"
    )
    finish_compactions(spark, table)
    register_commits(spark, table)


def _folder(spark: SparkSession, table: str) -> str:
    return spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Location'").first().data_type


def _place(folder: str, commit: Commit) -> str:
    return f"{folder}/snapshot_id={commit[0]}/commit_name={commit[1]}"


def _known(spark: SparkSession, table: str) -> set[Commit]:
    return {(r.snapshot_id, r.commit_name) for r in list_snapshots(spark, table).collect()}


def _alter(spark: SparkSession, table: str, action: str, commits: list[Commit]) -> None:
    for begin in range(0, len(commits), _STATEMENT_PARTITIONS):
        some = commits[begin : begin + _STATEMENT_PARTITIONS]
        parts = [f"PARTITION (snapshot_id = {n}, commit_name = '{name}')" for n, name in some]
        spark.sql(f"ALTER TABLE {table} {action} {(' ' if action.startswith('ADD') else ', ').join(parts)}")


def register_commits(spark: SparkSession, table: str) -> None:
    """Make the catalog list the finished commits, and no others."""
    marks = list_paths(spark, f"{_folder(spark, table)}/snapshot_id=*/commit_name=*/_SUCCESS")
    places = [re.search(r"/snapshot_id=(\d+)/commit_name=([^/]+)/_SUCCESS$", mark) for mark in marks]
    finished, known = {(int(p[1]), p[2]) for p in places if p}, _known(spark, table)
    _alter(spark, table, "ADD IF NOT EXISTS", sorted(finished - known))
    _alter(spark, table, "DROP IF EXISTS", sorted(known - finished))
    spark.catalog.refreshTable(table)


def append_snapshot(rows: DataFrame, table: str, snapshot_id: int, commit_name: str = "batch") -> None:
    """Commit rows as one snapshot. Making the same commit again replaces it.

    Only that folder is touched, so a commit that is run again after a failure leaves
    no second copy. Columns go by their names and take the table's types.
    """
    spark, commit = rows.sparkSession, (snapshot_id, commit_name)
    fields = [f for f in spark.table(table).schema if f.name not in _KEYS]
    rows = rows.select([F.col(f.name).cast(f.dataType) for f in fields])
    rows.write.mode("overwrite").parquet(_place(_folder(spark, table), commit))
    _alter(spark, table, "ADD IF NOT EXISTS", [commit])


def read_latest(spark: SparkSession, table: str) -> DataFrame:
    """The rows of all commits, in the columns of the rows alone."""
    return _fresh(spark, table).drop(*_KEYS)


def read_as_of(spark: SparkSession, table: str, snapshot_id: int) -> DataFrame:
    """The table as it was after that commit; later partitions are not read."""
    return _fresh(spark, table).where(f"snapshot_id <= {snapshot_id}").drop("commit_name")


def _fresh(spark: SparkSession, table: str) -> DataFrame:
    """The table without the file list that an earlier read of the session left."""
    spark.catalog.refreshTable(table)
    return spark.table(table)


def list_snapshots(spark: SparkSession, table: str) -> DataFrame:
    """Numbers and names of the commits, from the catalog, without reading the table."""
    return spark.sql(f"SHOW PARTITIONS {table}").select(
        F.regexp_extract("partition", "snapshot_id=(\\d+)", 1).cast("bigint").alias("snapshot_id"),
        F.regexp_extract("partition", "commit_name=(.*)", 1).alias("commit_name"),
    )


def snapshot_counts(spark: SparkSession, table: str) -> DataFrame:
    """Rows of each commit; no column of the table is read."""
    return _fresh(spark, table).groupBy("snapshot_id").agg(F.count("*").alias("rows"))


class CommitNumbers:
    """Numbers for the commits of one run of a stream: listed once, then counted up.

    Every checkpoint counts its batches from 0, so the batch number alone would let one
    stream replace what another committed. Streams may take turns, but should not commit
    at the same time: their commits would stay apart, but could share a number.
    """

    def __init__(self, table: str):
        self.table, self.next = table, None

    def of(self, spark: SparkSession, commit_name: str) -> int:
        """The commit's own number if it was made before this run, else the next."""
        if self.next is not None:
            self.next += 1
            return self.next - 1
        number, self.next = number_of(spark, self.table, commit_name)
        return number


def number_of(spark: SparkSession, table: str, commit_name: str) -> tuple[int, int]:
    """The number of a commit, its own or the next; and the one after all others."""
    own = F.max(F.when(F.col("commit_name") == commit_name, F.col("snapshot_id")))
    own, last = list_snapshots(spark, table).agg(own, F.max("snapshot_id")).first()
    following = 0 if last is None else last + 1
    return (following, following + 1) if own is None else (own, following)


def rollback_to(spark: SparkSession, table: str, snapshot_id: int) -> None:
    """Drop every later commit, and its files.

    The marks go first, the last commit's before all: however far this gets, no commit
    comes back, and those that remain are an earlier state.
    """
    folder = _folder(spark, table)
    later = sorted((c for c in _known(spark, table) if c[0] > snapshot_id), reverse=True)
    for commit in later:
        delete_folder(spark, f"{_place(folder, commit)}/_SUCCESS")
    _alter(spark, table, "DROP IF EXISTS", later)
    for commit in later:
        delete_folder(spark, _place(folder, commit))
    spark.catalog.refreshTable(table)


def compact(spark: SparkSession, table: str, keep: int = 10) -> int:
    """Make one commit of all but the last ``keep``; the number of commits joined.

    The state as of the joined commit and later ones stays; that of the commits it joins
    goes. A stream's last commit must be among those kept, or would be made twice if the
    stream failed just after it; nothing should read or write the table meanwhile.
    """
    known = sorted(_known(spark, table))
    old = known[: max(0, len(known) - keep)]
    if len(old) < 2:
        return 0
    last = old[-1][0]
    old = [c for c in known if c[0] <= last]  # commits may share a number
    staged = f"{_folder(spark, table)}/_compact-{uuid.uuid4().hex}"
    rows = _fresh(spark, table).where(f"snapshot_id <= {last}").drop(*_KEYS)
    rows.write.parquet(f"{staged}/rows")
    # From here on the old commits count as joined: what is left to do can be done again.
    spark.createDataFrame(old, "snapshot_id bigint, commit_name string").coalesce(1).write.json(f"{staged}/joined")
    finish_compactions(spark, table)
    register_commits(spark, table)
    return len(old)


def finish_compactions(spark: SparkSession, table: str) -> None:
    """Do the rest of compactions that were cut off; forget those that had not got to joining."""
    folder = _folder(spark, table)
    for staged in list_paths(spark, f"{folder}/_compact-*"):
        if file_exists(spark, f"{staged}/joined/_SUCCESS"):
            old = spark.read.schema("snapshot_id bigint, commit_name string").json(f"{staged}/joined").collect()
            for commit in old:
                delete_folder(spark, _place(folder, tuple(commit)))
            if file_exists(spark, f"{staged}/rows"):
                name = staged.rpartition("/_")[2]
                move_folder(spark, f"{staged}/rows", _place(folder, (max(c.snapshot_id for c in old), name)))
        delete_folder(spark, staged)
