import os

import pytest

from verdictflow.operators import snapshots
from verdictflow.operators.snapshots import (
    CommitNumbers,
    append_snapshot,
    compact,
    create_snapshot_table,
    list_snapshots,
    number_of,
    read_as_of,
    read_latest,
    rollback_to,
    snapshot_counts,
)
from verdictflow.session import scratch_path
from verdictflow.sources import tables


@pytest.fixture
def table(spark):
    warehouse = scratch_path(spark, "warehouse")
    database = "db_" + warehouse[-32:]
    tables.create_database(spark, database, warehouse)
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(3)], "id int, text string")
    create_snapshot_table(spark, f"{database}.t", rows.schema)
    for snapshot in range(4):
        append_snapshot(rows.selectExpr(f"id + {10 * snapshot} AS id", "text"), f"{database}.t", snapshot)
    return f"{database}.t"


def ids(df):
    return sorted(r.id for r in df.collect())


def test_as_of(spark, table):
    assert [read_as_of(spark, table, n).count() for n in (-1, 0, 1, 3, 99)] == [0, 3, 6, 12, 12]
    assert ids(read_as_of(spark, table, 1)) == [0, 1, 2, 10, 11, 12]


def test_as_of_reads_no_later_files(spark, table):
    assert len(read_as_of(spark, table, 1).inputFiles()) < len(spark.table(table).inputFiles())
    plan = read_as_of(spark, table, 1)._jdf.queryExecution().executedPlan().toString()
    assert "snapshot_id" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_same_commit_again_replaces_itself_only(spark, table):
    append_snapshot(spark.createDataFrame([(99, "x")], "id int, text string"), table, 2)
    assert ids(spark.table(table)) == [0, 1, 2, 10, 11, 12, 30, 31, 32, 99]


def test_overwrite_mode_of_the_session_does_not_matter(spark, table):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    append_snapshot(spark.createDataFrame([], "id int, text string"), table, 2)
    spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert ids(spark.table(table)) == [0, 1, 2, 10, 11, 12, 30, 31, 32]


def test_counts_per_commit(spark, table):
    append_snapshot(spark.createDataFrame([(99, "x")], "id int, text string"), table, 2)
    assert {tuple(r) for r in snapshot_counts(spark, table).collect()} == {(0, 3), (1, 3), (2, 1), (3, 3)}


def test_rollback(spark, table):
    rollback_to(spark, table, 1)
    assert ids(spark.table(table)) == [0, 1, 2, 10, 11, 12]
    assert sorted(r.snapshot_id for r in list_snapshots(spark, table).collect()) == [0, 1]
    rollback_to(spark, table, 1)
    append_snapshot(spark.createDataFrame([(7, "x")], "id int, text string"), table, 2)
    assert ids(spark.table(table)) == [0, 1, 2, 7, 10, 11, 12]


def test_rollback_deletes_the_files(spark, table):
    before = len(spark.table(table).inputFiles())
    rollback_to(spark, table, 0)
    assert 0 < len(spark.table(table).inputFiles()) < before


def test_table_outlives_its_catalog(spark, table):
    append_snapshot(spark.createDataFrame([(99, "x")], "id int, text string"), table, 4, "s-7")
    rollback_to(spark, table, 4)
    schema, before = read_latest(spark, table).schema, ids(spark.table(table))
    rollback_to(spark, table, 5)
    spark.sql(f"DROP TABLE {table}")
    create_snapshot_table(spark, table, schema)
    assert ids(spark.table(table)) == before and len(before) == 13
    assert number_of(spark, table, "s-7") == (4, 5) and number_of(spark, table, "s-8") == (5, 6)
    rollback_to(spark, table, 0)
    spark.sql(f"DROP TABLE {table}")
    create_snapshot_table(spark, table, schema)
    assert ids(spark.table(table)) == [0, 1, 2]


def folder_of(spark, table):
    return spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Location'").first().data_type.removeprefix("file:")


def reopened(spark, table):
    """The ids a session with a catalog of its own finds."""
    schema = read_latest(spark, table).schema
    spark.sql(f"DROP TABLE {table}")
    create_snapshot_table(spark, table, schema)
    return ids(read_latest(spark, table))


def test_unfinished_commits_are_not_read(spark, table):
    os.remove(f"{folder_of(spark, table)}/snapshot_id=3/commit_name=batch/_SUCCESS")
    assert reopened(spark, table) == [0, 1, 2, 10, 11, 12, 20, 21, 22]
    append_snapshot(spark.createDataFrame([(99, "x")], "id int, text string"), table, 3)
    assert reopened(spark, table) == [0, 1, 2, 10, 11, 12, 20, 21, 22, 99]


@pytest.mark.parametrize("crash", ["_alter", "_place"])
def test_rollback_that_was_cut_off_does_not_bring_commits_back(spark, table, monkeypatch, crash):
    calls = []

    def fails(*given):
        calls.append(given)
        if crash == "_alter" or len(calls) > 2:  # after the marks of both commits
            raise KeyboardInterrupt
        return place(*given)

    place = snapshots._place
    monkeypatch.setattr(snapshots, crash, fails)
    with pytest.raises(KeyboardInterrupt):
        rollback_to(spark, table, 1)
    monkeypatch.undo()
    assert reopened(spark, table) == [0, 1, 2, 10, 11, 12]


def test_reads_after_a_commit_was_made_again(spark, table):
    assert read_latest(spark, table).count() == 12
    append_snapshot(spark.createDataFrame([(99, "x")], "id int, text string"), table, 3)
    assert read_latest(spark, table).count() == 10 and read_as_of(spark, table, 3).count() == 10


def test_compaction(spark, table):
    assert compact(spark, table, keep=2) == 2
    assert sorted(r.snapshot_id for r in list_snapshots(spark, table).collect()) == [1, 2, 3]
    assert [read_as_of(spark, table, n).count() for n in (0, 1, 2, 3)] == [0, 6, 9, 12]
    assert compact(spark, table, keep=2) == 0 and compact(spark, table, keep=9) == 0
    assert reopened(spark, table) == sorted(10 * s + i for s in range(4) for i in range(3))


@pytest.mark.parametrize("crash", ["finish_compactions", "delete_folder", "move_folder", "register_commits"])
def test_compaction_that_was_cut_off_is_finished(spark, table, monkeypatch, crash):
    def fails(*given):
        raise KeyboardInterrupt

    monkeypatch.setattr(snapshots, crash, fails)
    with pytest.raises(KeyboardInterrupt):
        compact(spark, table, keep=1)
    monkeypatch.undo()
    assert reopened(spark, table) == sorted(10 * s + i for s in range(4) for i in range(3))
    assert sorted(r.snapshot_id for r in list_snapshots(spark, table).collect()) == [2, 3]


def test_compaction_that_had_not_got_to_joining_is_forgotten(spark, table):
    os.makedirs(f"{folder_of(spark, table)}/_compact-1/rows")
    assert reopened(spark, table) == sorted(10 * s + i for s in range(4) for i in range(3))
    assert not os.path.exists(f"{folder_of(spark, table)}/_compact-1")


def test_numbers_are_listed_once_per_run(spark, table, monkeypatch):
    numbers = CommitNumbers(table)
    assert numbers.of(spark, "s-0") == 4
    monkeypatch.setattr(snapshots, "number_of", None)
    assert [numbers.of(spark, "s-1"), numbers.of(spark, "s-2")] == [5, 6]


def test_catalog_statements(spark):
    tables.register_catalog(spark, "lake", "org.example.Catalog", warehouse="/shared/lake")
    tables.register_catalog(spark, "lake", "org.example.Other", warehouse="/other")
    assert spark.conf.get("spark.sql.catalog.lake") == "org.example.Catalog"
    assert spark.conf.get("spark.sql.catalog.lake.warehouse") == "/shared/lake"
    tables.use_catalog(spark, "spark_catalog")
    assert spark.catalog.currentCatalog() == "spark_catalog"


def test_head_is_the_same_however_rows_are_spread(spark):
    rows = spark.range(1000).repartition(7)
    head = tables.head_rows(rows, "id")
    assert [r.id for r in head.collect()] == list(range(10))
    assert "TakeOrderedAndProject" in head._jdf.queryExecution().executedPlan().toString()
