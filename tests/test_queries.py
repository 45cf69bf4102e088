import pytest
from compare import differences, oracle

import __spark_entry__ as contract
from verdictflow.plans.oracle import ORACLE_SQL as SQL
from verdictflow.plans.queries import QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle(sf_dir)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == SQL.keys()
    assert QUERIES.items() <= contract.queries().items()
    assert SQL.items() <= contract.oracle_sql().items()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, connection, name):
    assert differences(QUERIES[name](spark, sf_dir), connection, SQL[name]) == ""


def test_entry(spark, sf_dir):
    scored = contract.entry(spark)
    assert scored.dtypes == [("id_cliente", "bigint"), ("predicao", "int"), ("value", "string")]
    assert scored.count() == 1500


def plan_of(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["decode_passthrough", "application_payload", "prompt_render", "request_payload", "json_defaults", "label_holdout"]
)
def test_column_queries_neither_shuffle_nor_leave_the_jvm(spark, sf_dir, name):
    plan = plan_of(spark, sf_dir, name)
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["decode_passthrough", "application_payload", "prompt_render", "request_payload"])
def test_column_queries_are_one_generated_stage(spark, sf_dir, name):
    operators = [line.lstrip(" +-:") for line in plan_of(spark, sf_dir, name).splitlines() if "Project" in line]
    assert operators and all(o.startswith("*(1)") for o in operators if not o.startswith("FileScan"))


def test_scan_reads_used_columns_only(spark, sf_dir):
    schema = plan_of(spark, sf_dir, "decode_passthrough").split("ReadSchema: ")[1]
    assert "o_orderdate" not in schema


def test_scoring_calls_the_model_once_per_row(spark, sf_dir):
    for name in ("score_applications", "confusion_matrix", "prediction_profile"):
        assert plan_of(spark, sf_dir, name).count("MapInArrow") == 1


def test_prompt_does_not_cross_to_python(spark, sf_dir):
    assert "analista" not in plan_of(spark, sf_dir, "score_applications")


def test_backlog_reads_ids_only(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "topic_backlog")
    assert "array_join" not in plan and "from_json" not in plan and plan.count("Exchange") == 1


def test_snapshots_prune(spark, sf_dir):
    assert "PartitionFilters: [isnotnull(snapshot_id" in plan_of(spark, sf_dir, "snapshot_as_of")
