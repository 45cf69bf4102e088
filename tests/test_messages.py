import json
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdictflow.operators.messages import message_ids, parse_messages, read_scored, split_malformed

KNOWN = {
    "id_cliente": 7,
    "status_conta_corrente": "< 0 DM (Saldo Negativo)",
    "duracao_credito_meses": 6,
    "historico_credito": 'é "quoted" \\ \x1f\n',
    "proposito_emprestimo": "A48",
    "valor_credito_solicitado": 1169,
    "target_real": 2,
}


def text_of(value):
    return None if value is None else json.dumps(value)


def without(fields, *names):
    return {k: v for k, v in fields.items() if k not in names}


@pytest.mark.parametrize(
    "fields",
    [
        KNOWN,
        {**KNOWN, "historico_credito": "plain"},
        {**KNOWN, "historico_credito": None, "valor_credito_solicitado": None},
        {**KNOWN, "target_real": None},
        {**KNOWN, "id_cliente": None},
        without(KNOWN, "target_real"),
        without(KNOWN, "id_cliente"),
        {**KNOWN, "extra": 1.0, "flag": True, "big": 12345678901234567890123, "none": None, "text": "5"},
        {"target_real": 1, **KNOWN},
        {"zz": 1, "a": "x", "target_real": 1, "k\"ey": "v"},
        {"target_real": 1},
        {},
    ],
)
@pytest.mark.parametrize("separators", [(", ", ": "), (",", ":"), (" ,  ", " :\t")])
def test_profile_is_the_message_without_its_label(texts, fields, separators):
    text = json.dumps(fields, ensure_ascii=False, separators=separators)
    row = parse_messages(texts(text)).first()
    assert row.perfil == json.dumps(without(fields, "target_real"), ensure_ascii=False)
    assert row.id_cliente == text_of(fields.get("id_cliente", -1))
    assert row.target_real == text_of(fields.get("target_real", -1))


FLAT = st.dictionaries(
    st.text(st.characters(blacklist_categories=["Cs"]), max_size=5),
    st.none() | st.booleans() | st.integers(-(2**70), 2**70) | st.text(st.characters(blacklist_categories=["Cs"]), max_size=8),
    max_size=5,
)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(FLAT, st.none() | st.integers(0, 9), st.booleans()), min_size=1, max_size=30))
def test_any_flat_message(spark, messages):
    rows, expected = [], {}
    for i, (fields, label, first) in enumerate(messages):
        fields = {"id_cliente": i, **{k: v for k, v in fields.items() if k not in ("id_cliente", "target_real")}}
        expected[str(i)] = (text_of(label), json.dumps(fields, ensure_ascii=False))
        labelled = {"target_real": label, **fields} if first else {**fields, "target_real": label}
        rows.append((json.dumps(labelled, ensure_ascii=i % 2 == 0),))
    parsed = parse_messages(spark.createDataFrame(rows, "value string")).collect()
    assert {r.id_cliente: (r.target_real, r.perfil) for r in parsed} == expected


def test_repeated_names_keep_the_last_value(texts):
    text = '{"id_cliente": 1, "a": "x", "b": null, "id_cliente": 5, "target_real": 1, "a": 7, "target_real": 2}'
    row = parse_messages(texts(text)).first()
    assert tuple(row) == ("5", "2", '{"id_cliente": 5, "a": 7, "b": null}')


def test_nested_fields_keep_their_order(texts):
    row = parse_messages(texts('{"n": {"b": 1, "a": [1, "x, y"]}, "target_real": 1}')).first()
    assert row.perfil == '{"n": {"b":1,"a":[1,"x, y"]}}'


def test_mixed_messages_in_one_task(texts):
    rows = parse_messages(texts(json.dumps(KNOWN, ensure_ascii=False), '{"x": 1}', json.dumps(KNOWN)).coalesce(1)).collect()
    assert [r.id_cliente for r in rows] == ["7", "-1", "7"]
    assert rows[0].perfil == rows[2].perfil


def test_large_ids(texts):
    assert parse_messages(texts(json.dumps({**KNOWN, "id_cliente": 2**40}))).first().id_cliente == str(2**40)


@pytest.mark.parametrize("value", ["abc-1", 1.5, True, None, [1, "x"], {"a": None}, "5", 10**30])
def test_ids_and_labels_of_any_type(texts, value):
    compact = json.dumps({"id_cliente": value, "target_real": value, "x": 1}, separators=(",", ":"))
    row = parse_messages(texts(compact)).first()
    for text in (row.id_cliente, row.target_real):
        assert value is None if text is None else json.loads(text) == value
    (found,) = message_ids(texts(compact)).first()
    assert found == (value if isinstance(value, str) else None if value is None else json.dumps(value, separators=(",", ":")))


def test_ids_alone(texts):
    found = message_ids(texts('{"x": "id_cliente"}', '{"id_cliente": null}', '{"id_cliente": 3}')).collect()
    assert [r.id_cliente for r in found] == ["-1", None, "3"]
    with pytest.raises(Exception, match="message is not a JSON object: nope"):
        message_ids(texts("nope")).collect()


def test_compact_messages_need_one_parse_only(texts, spark):
    spaced, compact = (json.dumps(KNOWN, ensure_ascii=False, separators=s) for s in ((", ", ": "), (",", ":")))
    rows = parse_messages(texts(spaced, compact)).collect()
    assert rows[0] == rows[1]


NO_OBJECTS = [
    *("nope", "[1]", "5", "null", '"{}"', "", " ", None, '{"a": 1', '{"a": 1} x', '{"a": 1} }', '{"a": 1}]', '{"a": 1},'),
    *('{"a": 1}{"b": 2}', '{"a": 1}, {"b": 2}', '[{"a": 1}]', '{"a": nope}', "{'a': 1}", "{a: 1}", ",", "]", "["),
]


@pytest.mark.parametrize("text", NO_OBJECTS)
def test_anything_else_fails_the_job(texts, text):
    with pytest.raises(Exception, match="message is not a JSON object: "):
        parse_messages(texts('{"id_cliente": 1}', text)).collect()


def test_malformed_messages_can_be_set_aside(texts):
    objects = ['{"a": 1}', " {} ", '{"a": [{}]}\t', json.dumps(KNOWN)]
    good, bad = split_malformed(texts(*objects, *NO_OBJECTS))
    assert [r.value for r in good.collect()] == objects
    assert Counter(r.value for r in bad.collect()) == Counter(NO_OBJECTS)
    assert parse_messages(good).count() == 4


def test_scored_messages_lose_undeclared_fields(texts):
    text = '{"id_cliente": 42, "target_real": 2, "predicao": 2, "justificativa": "é", "modelo": "m", "more": [1]}'
    rows = read_scored(texts(text, '{"id_cliente": 1}'))
    assert rows.columns == ["id_cliente", "target_real", "predicao", "justificativa"]
    assert [tuple(r) for r in rows.collect()] == [(42, 2, 2, "é"), (1, None, None, None)]


def test_malformed_scored_message_fails(texts):
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_scored(texts("nope")).collect()
