import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from verdictflow.fixed_values import ACCOUNT_STATUS, CREDIT_HISTORY, LOAN_PURPOSE, PROMPT
from verdictflow.functions.decode import decode, decode_by_table, whole_number
from verdictflow.functions.jsontext import lower_hex, record_of
from verdictflow.functions.prompt import prompt, request
from verdictflow.schemas import SCORED_SCHEMA


@pytest.mark.parametrize("labels", [ACCOUNT_STATUS, CREDIT_HISTORY, LOAN_PURPOSE])
def test_decode_labels_known_codes_and_passes_others(texts, labels):
    rows = texts(*labels, "A48", "", None).select("value", decode(F.col("value"), labels).alias("label"))
    assert {r.value: r.label for r in rows.collect()} == {**labels, "A48": "A48", "": "", None: None}


def test_number_of_labels():
    assert [len(m) for m in (ACCOUNT_STATUS, CREDIT_HISTORY, LOAN_PURPOSE)] == [4, 5, 9]


def test_whole_number_truncates(spark):
    rows = spark.createDataFrame([(12.9,), (-3.7,), (5.0,)], "n double")
    assert [r[0] for r in rows.select(whole_number(F.col("n"), "n")).collect()] == [12, -3, 5]


@pytest.mark.parametrize("ansi", [True, False])
@pytest.mark.parametrize(("value", "kind"), [(None, "double"), (float("nan"), "double"), (3e10, "double"), ("x", "string")])
def test_whole_number_fails_on_what_is_none(spark, value, kind, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(PySparkException, match="no whole number in n"):
            spark.createDataFrame([(value,)], f"n {kind}").select(whole_number(F.col("n"), "n")).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


ANY_TEXT = st.none() | st.text(st.characters(blacklist_categories=["Cs"]))
CONTROL_TEXT = st.text(st.sampled_from([*map(chr, range(32)), "\\", '"', "u", "0", "1", "F", "\x7f", "é"]))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-(2**31), 2**31 - 1), ANY_TEXT, CONTROL_TEXT), min_size=1))
def test_record_text_is_what_json_writes(spark, rows):
    data = [(i, n, n, n, a, b) for i, (n, a, b) in enumerate(rows)]
    names = SCORED_SCHEMA.fieldNames()
    table = spark.createDataFrame(data, "i int, id_cliente int, target_real int, predicao int, justificativa string, modelo string")
    written = {r.i: r.text for r in table.select("i", lower_hex(record_of(SCORED_SCHEMA)).alias("text")).collect()}
    for i, *values in data:
        assert written[i] == json.dumps(dict(zip(names, values)), ensure_ascii=False)


def test_prompt_ends_with_the_profile(texts):
    profile = '{"id_cliente": 0, "proposito_emprestimo": "a \\"b\\" \\u001f"}'
    row = texts(profile).select(prompt(F.col("value")).alias("p"), request(F.col("value"), "m").alias("r")).first()
    assert row.p == PROMPT + profile
    assert row.p.startswith("Você é um analista") and row.p.endswith("\nPerfil: " + profile)
    assert PROMPT.count("Perfil: ") == 3 and PROMPT.count("Resposta: ") == 2
    expected = {"model": "m", "prompt": PROMPT + profile, "format": "json", "stream": False}
    assert row.r == json.dumps(expected, ensure_ascii=False)


def test_request_without_a_model_name(texts):
    assert json.loads(texts("{}").select(request(F.col("value"), None)).first()[0])["model"] is None


def test_worked_examples_of_the_prompt_are_json():
    lines = PROMPT.splitlines()
    examples = [json.loads(line.partition(": ")[2]) for line in lines if line.startswith(("Perfil: {", "Resposta: {"))]
    assert [e["predicao"] for e in examples[1::2]] == [1, 2]


def test_codes_of_a_table_decode_on_either_side_of_the_size(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "zz"), (5, "a"), (6, "n")], "i int, code string")
    codes = spark.createDataFrame([("a", "first"), ("b", "y"), ("b", "x"), (None, "none"), ("n", None)], "code string, label string")
    expected = [(1, "first"), (2, "x"), (3, None), (4, "zz"), (5, "first"), (6, "n")]
    for most, join in ((3, "BroadcastHashJoin"), (2, "SortMergeJoin")):
        decoded = decode_by_table(rows, "code", codes, max_broadcast_rows=most)
        assert decoded.columns == rows.columns and sorted(map(tuple, decoded.collect())) == expected
        assert join in decoded._jdf.queryExecution().executedPlan().toString()
