import json

import pytest
from pyspark.sql import functions as F

from verdictflow.operators.verdict import verdict, verdict_of


def envelope(response):
    return json.dumps({"response": response})


INVALID = "predicao_invalida_recebida="
CASES = [
    ('{"predicao":1,"justificativa":"ok"}', 1, "ok"),
    ('{"predicao":2}', 2, ""),
    ('{"predicao":2,"justificativa":null}', 2, "None"),
    ('{"predicao":2,"justificativa":{"a":[1]}}', 2, "{'a': [1]}"),
    ('{"predicao":1,"justificativa":3.5}', 1, "3.5"),
    ('{"predicao":3}', 0, INVALID + "3"),
    ('{"predicao":0,"justificativa":"x"}', 0, INVALID + "0"),
    ('{"predicao":-1}', 0, INVALID + "-1"),
    ('{"predicao":1.5}', 0, INVALID + "1.5"),
    ('{"predicao":"1"}', 0, INVALID + "1"),
    ('{"predicao":null}', 0, INVALID + "None"),
    ('{"predicao":false}', 0, INVALID + "False"),
    ("{}", 0, INVALID + "None"),
    ('{"predicao":true}', 1, ""),
    ('{"predicao":1.0}', 1, ""),
    ('{"predicao":2e0}', 2, ""),
    ("[1]", 0, "erro: AttributeError - 'list' object has no attribute 'get'"),
    ("5", 0, "erro: AttributeError - 'int' object has no attribute 'get'"),
    ("null", 0, "erro: AttributeError - 'NoneType' object has no attribute 'get'"),
    ("nope", 0, "erro: JSONDecodeError - Expecting value: line 1 column 1 (char 0)"),
    ("", 0, "erro: JSONDecodeError - Expecting value: line 1 column 1 (char 0)"),
    ('{"predicao":1} x', 0, "erro: JSONDecodeError - Extra data: line 1 column 16 (char 15)"),
]


@pytest.mark.parametrize(("response", "choice", "reason"), CASES)
def test_reply(response, choice, reason):
    assert verdict_of(envelope(response)) == (choice, reason)


def test_verdict_is_a_whole_number():
    assert [type(verdict_of(envelope(r))[0]) for r in ('{"predicao":true}', '{"predicao":1.0}')] == [int, int]


@pytest.mark.parametrize("response", ['{"predicao":[1]}', '{"predicao":{"a":1}}'])
def test_unhashable_verdict(response):
    choice, reason = verdict_of(envelope(response))
    assert choice == 0 and reason.startswith("erro: TypeError - ")


@pytest.mark.parametrize("text", ['{"error": "busy"}', "{}"])
def test_envelope_without_response(text):
    assert verdict_of(text) == (0, "erro: KeyError - 'response'")


def test_envelope_that_is_no_object():
    assert verdict_of("null")[1].startswith("erro: TypeError - ")
    assert verdict_of("<html>")[1].startswith("erro: JSONDecodeError - ")


@pytest.mark.parametrize(
    ("error", "reason"),
    [
        (TimeoutError(), "erro: TimeoutError - "),
        (ConnectionRefusedError(111, "refused"), "erro: ConnectionRefusedError - [Errno 111] refused"),
        (ValueError("x"), "erro: ValueError - x"),
    ],
)
def test_errors_become_rows(error, reason):
    assert verdict_of(error) == (0, reason)


def test_half_a_surrogate_pair_can_be_stored():
    assert verdict_of(envelope('{"predicao":1,"justificativa":"a\\ud83d"}')) == (1, "a?")


def test_column_form_agrees_and_runs_once(spark):
    rows = spark.createDataFrame([(i, envelope(c[0])) for i, c in enumerate(CASES)] + [(99, None)], "i int, reply string")
    judged = rows.select("i", verdict(F.col("reply")).alias("v")).select("i", "v.*").where("i >= 0")
    found = {r.i: (r.predicao, r.justificativa) for r in judged.collect()}
    assert found.pop(99)[0] == 0
    assert found == {i: (choice, reason) for i, (_, choice, reason) in enumerate(CASES)}
    assert judged._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


PARTS = ["1", "2", "3", "true", "false", "null", "1.0", '"1"', '"x"', "[1]", "{}", "1e0", "12345678901234567890", '"a\\ud83d"', '"\\u0041"', "NaN", "01"]
REPLIES = [
    *(envelope(f'{{"predicao": {a}, "justificativa": {b}}}') for a in PARTS for b in PARTS),
    *(envelope(text) for text in ('{"predicao":1}]', '{"predicao":1},{}', '{"predicao":1}] }', '{"predicao":1,"predicao":2}', " {} ", "\ufeff{}", "{'a':1}")),
    *('{"response": %s}' % x for x in ("null", "1", "{}", "[]", "true", '"{}"')),
    *(envelope("{}") + tail for tail in ("x", "}", "]", ",{}", " ", "\n", "\x00", ', "x"]')),
    '{"response": "{}", "response": "[]"}', "[]", '{"a": NaN}', '{"RESPONSE": "{}"}', "",
]


def test_columns_judge_as_python_does(spark):
    rows = spark.createDataFrame(list(enumerate(REPLIES)), "i int, reply string").repartition(4)
    found = {r.i: (r.v.predicao, r.v.justificativa) for r in rows.select("i", verdict(F.col("reply")).alias("v")).collect()}
    assert {i: f for i, f in found.items() if f != verdict_of(REPLIES[i])} == {}


def test_plain_replies_do_not_cross_to_python(spark, monkeypatch):
    def refused(reply):
        raise AssertionError(reply)

    monkeypatch.setattr("verdictflow.operators.verdict.verdict_of", refused)
    plain = [envelope(c[0]) for c in CASES[:3] + CASES[5:8] + CASES[9:14]] + ["{}"]
    rows = spark.createDataFrame([(r,) for r in plain], "reply string")
    assert rows.select(verdict(F.col("reply")).alias("v")).where("v.predicao is null").isEmpty()


def test_a_reply_is_parsed_twice_at_most(spark):
    rows = spark.createDataFrame([(envelope("{}"),)], "reply string")
    plan = rows.select(verdict(F.col("reply")).alias("v")).select("v.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 2
