import glob
import json
import os
import shutil
import sys
import time
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from verdictflow.operators.messages import parse_messages, read_scored, scored_message
from verdictflow.operators.scorers import FunctionScorer
from verdictflow.operators.scoring import score
from verdictflow.operators.snapshots import append_snapshot, list_snapshots, number_of
from verdictflow.plans.steps import echo, pending, score_batch, scored_rows
from verdictflow.session import scratch_path
from verdictflow.sources.tables import create_database, create_scored_table, create_stream_view, read_table
from verdictflow.sources.topics import FileTopic, KafkaTopic
from verdictflow.streaming.metrics import CommitCounts, files_behind, offsets_behind
from verdictflow.streaming.steps import counted, insert_stream, land_stream, paced_replay, score_stream

register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests


def answer(profile):
    number = json.loads(profile)["id_cliente"]
    if number % 5 == 0:
        raise ConnectionError("down")
    return json.dumps({"response": json.dumps({"predicao": 1 + number % 2, "justificativa": "é"})})


SCORER = FunctionScorer(answer)


def message(number):
    return json.dumps({"id_cliente": number, "valor_credito_solicitado": 10 * number, "target_real": 1}, ensure_ascii=False)


@pytest.fixture
def path(tmp_path):
    return lambda name: str(tmp_path / name)


@pytest.fixture
def raw(texts, path):
    """Forty messages in four files."""
    topic = FileTopic(path("raw"))
    topic.append(texts(*map(message, range(40))).repartition(4))
    return topic


@pytest.fixture
def table(spark):
    warehouse = scratch_path(spark, "warehouse")
    database = "db_" + warehouse[-32:]
    create_database(spark, database, warehouse)
    create_scored_table(spark, f"{database}.credit_scored")
    create_scored_table(spark, f"{database}.credit_scored")
    return f"{database}.credit_scored"


def run(query):
    query.awaitTermination()
    return query


def test_stream_scores_like_batch(spark, raw, path):
    stream, batch = FileTopic(path("stream")), FileTopic(path("batch"))
    limits = {"model_name": "m", "max_in_flight": 3}
    run(score_stream(spark, raw, stream, SCORER, path("progress"), per_trigger=1, interval=None, partitions=2, **limits))
    score_batch(spark, raw, batch, SCORER, **limits)
    rows = [Counter(r.value for r in topic.read(spark).collect()) for topic in (stream, batch)]
    assert rows[0] == rows[1] and rows[0].total() == 40
    assert '{"id_cliente": 1, "target_real": 1, "predicao": 2, "justificativa": "é", "modelo": "m"}' in rows[0]
    assert '{"id_cliente": 5, "target_real": 1, "predicao": 0, "justificativa": "erro: ConnectionError - down", "modelo": "m"}' in rows[0]


def test_model_is_asked_once_per_row(spark, raw, path, table):
    def noted(profile):
        with open(path("asked"), "a") as log:
            log.write("x")
        return answer(profile)

    scored = FileTopic(path("scored"))
    run(score_stream(spark, raw, scored, FunctionScorer(noted), path("p1"), per_trigger=2, interval=None))
    run(land_stream(spark, scored, table, path("p2"), interval=None))
    assert read_table(spark, table).count() == 40
    assert os.path.getsize(path("asked")) == 40


def test_stream_that_failed_goes_on_where_it_stopped(spark, raw, path, table):
    def stuck(profile):
        if os.path.exists(path("stuck")) and json.loads(profile)["id_cliente"] == 17:
            time.sleep(1)
        return answer(profile)

    scored, limits = FileTopic(path("scored")), {"operator_timeout_s": 0.3, "per_trigger": 1, "interval": None}
    open(path("stuck"), "w").close()
    with pytest.raises(Exception, match="took longer than 0.3 s"):
        run(score_stream(spark, raw, scored, FunctionScorer(stuck), path("progress"), **limits))
    assert not os.path.exists(scored.path) or scored_rows(spark, scored).count() < 40
    os.remove(path("stuck"))
    run(score_stream(spark, raw, scored, FunctionScorer(stuck), path("progress"), **limits))
    assert sorted(r.id_cliente for r in scored_rows(spark, scored).collect()) == list(range(40))


def test_restart_adds_nothing_and_new_input_is_scored_once(spark, raw, texts, path):
    scored = FileTopic(path("scored"))
    for _ in range(2):
        run(score_stream(spark, raw, scored, SCORER, path("progress"), interval=None))
        assert scored_rows(spark, scored).count() == 40
    raw.append(texts(message(40)))
    run(score_stream(spark, raw, scored, SCORER, path("progress"), interval=None))
    assert scored_rows(spark, scored).count() == 41


def test_consumers_have_their_own_progress(spark, raw, path):
    for name in ("one", "two"):
        copy = FileTopic(path(name))
        run(paced_replay(spark, raw, copy, path(f"progress-{name}"), per_trigger=4, interval=None))
        assert copy.read(spark).count() == 40


def test_fresh_checkpoint_scores_into_the_same_topic_again(spark, raw, path):
    scored = FileTopic(path("scored"))
    for name in ("one", "two", "two"):
        run(score_stream(spark, raw, scored, SCORER, path(f"progress-{name}"), per_trigger=1, interval=None))
    assert Counter(r.id_cliente for r in scored_rows(spark, scored).collect()) == Counter({i: 2 for i in range(40)})


def test_batches_and_streams_share_a_topic(spark, raw, texts, path):
    copy = FileTopic(path("copy"))
    copy.append(texts("first"))
    run(paced_replay(spark, raw, copy, path("progress"), per_trigger=4, interval=None))
    copy.append(texts("last"))
    assert copy.read(spark).count() == 42


def test_commit_that_is_there_is_not_made_again(spark, texts, path):
    topic = FileTopic(path("topic"))
    topic.append(texts("a", "b"), commit="s-0")
    topic.append(texts("c", "d"), commit="s-0")
    topic.append(texts("e"), commit="s-1")
    assert sorted(r.value for r in topic.read(spark).collect()) == ["a", "b", "e"]
    os.remove(path("topic/s-0/_SUCCESS"))
    topic.append(texts("f"), commit="s-0")
    assert sorted(r.value for r in topic.read(spark).collect()) == ["e", "f"]


def test_fresh_checkpoint_reads_everything_again(spark, raw, path, table):
    rows = score(parse_messages(raw.read_stream(spark, per_trigger=1)), SCORER).drop("modelo")
    run(insert_stream(rows, table, path("first"), interval=None))
    assert list_snapshots(spark, table).count() == 4
    run(insert_stream(rows, table, path("second"), interval=None))
    copies = read_table(spark, table).groupBy("id_cliente").count()
    assert copies.groupBy("count").count().collect() == [(2, 40)]
    assert sorted(r[0] for r in list_snapshots(spark, table).collect()) == list(range(8))


@pytest.mark.parametrize("again", ["progress", "progress/"])
def test_lost_checkpoint_at_the_same_path_loses_nothing(spark, raw, texts, path, table, again):
    scored = FileTopic(path("scored"))
    run(score_stream(spark, raw, scored, SCORER, path("progress"), interval=None))
    run(land_stream(spark, scored, table, path("landed"), per_trigger=1, interval=None))
    shutil.rmtree(path("progress")), shutil.rmtree(path("landed"))
    raw.append(texts(*map(message, range(100, 103))))
    run(score_stream(spark, raw, scored, SCORER, path(again), per_trigger=2, interval=None))
    expected = Counter({i: 2 for i in range(40)} | {i: 1 for i in range(100, 103)})
    assert Counter(r.id_cliente for r in scored_rows(spark, scored).collect()) == expected
    run(land_stream(spark, scored, table, path("landed"), per_trigger=2, interval=None))
    landed = Counter(r.id_cliente for r in read_table(spark, table).collect())
    assert landed == Counter({i: 3 for i in range(40)} | {i: 1 for i in range(100, 103)})


def test_trailing_slash_is_the_same_stream(spark, raw, path, table):
    rows = score(parse_messages(raw.read_stream(spark, per_trigger=1)), SCORER).drop("modelo")
    for checkpoint in (path("progress"), path("progress/")):
        run(insert_stream(rows, table, checkpoint, interval=None))
    assert read_table(spark, table).count() == 40


def test_batch_run_again_after_a_crash_replaces_itself(spark, raw, path, table):
    rows = score(parse_messages(raw.read_stream(spark, per_trigger=1)), SCORER).drop("modelo")
    for _ in range(2):
        run(insert_stream(rows, table, path("progress"), interval=None))
        copy = FileTopic(path("copy"))
        run(paced_replay(spark, raw, copy, path("paced"), per_trigger=1, interval=None))
        for checkpoint in ("progress", "paced"):  # as if the last batch had not been noted
            last = max(os.listdir(path(f"{checkpoint}/commits")), key=lambda name: int(name.strip(".crc") or -1) if name.isdigit() else -1)
            for name in (last, f".{last}.crc"):
                if os.path.exists(path(f"{checkpoint}/commits/{name}")):
                    os.remove(path(f"{checkpoint}/commits/{name}"))
    run(insert_stream(rows, table, path("progress"), interval=None))
    run(paced_replay(spark, raw, copy, path("paced"), per_trigger=1, interval=None))
    assert read_table(spark, table).count() == 40 and copy.read(spark).count() == 40
    assert sorted(r[0] for r in list_snapshots(spark, table).collect()) == [0, 1, 2, 3]


def test_old_files_that_arrive_late_are_read(spark, raw, texts, path):
    copy = FileTopic(path("copy"))
    run(paced_replay(spark, raw, copy, path("progress"), per_trigger=9, interval=None))
    raw.append(texts("late"))
    newest = max(glob.glob(path("raw/*/*.txt")), key=os.path.getmtime)
    month_ago = time.time() - 30 * 86400
    os.utime(newest, (month_ago, month_ago))
    run(paced_replay(spark, raw, copy, path("progress"), per_trigger=9, interval=None))
    assert copy.read(spark).count() == 41


@pytest.mark.parametrize("text", ['{\n"a": 1}', "a\rb"])
def test_messages_with_line_breaks_are_refused(texts, path, text):
    with pytest.raises(Exception, match="message has a line break"):
        FileTopic(path("topic")).append(texts("a", text))


def test_ids_of_any_type_reach_the_scored_topic(spark, texts, path):
    ids = ['"abc-1"', "1.5", "true", "null", "7", '{"a":1}']
    raw, scored = FileTopic(path("raw")), FileTopic(path("scored"))
    raw.append(texts(*(f'{{"id_cliente": {i}, "target_real": "bom"}}' for i in ids), '{"x": 1}'))
    scorer = FunctionScorer(lambda _: json.dumps({"response": json.dumps({"predicao": 1})}))
    run(score_stream(spark, raw, scored, scorer, path("progress"), interval=None))
    found = [json.loads(r.value) for r in scored.read(spark).collect()]
    assert sorted(json.dumps(m["id_cliente"]) for m in found) == sorted(json.dumps(json.loads(i)) for i in [*ids, "-1"])
    assert Counter(str(m["target_real"]) for m in found) == {"bom": 6, "-1": 1}
    assert pending(spark, raw, scored).isEmpty()


def test_streams_that_take_turns_keep_each_others_commits(spark, raw, texts, path, table):
    rows = score(parse_messages(raw.read_stream(spark)), SCORER).drop("modelo")
    run(insert_stream(rows, table, path("first"), interval=None))
    run(insert_stream(rows, table, path("second"), interval=None))
    raw.append(texts(message(40)))
    run(insert_stream(rows, table, path("first"), interval=None))
    run(insert_stream(rows, table, path("second"), interval=None))
    assert read_table(spark, table).count() == 82
    assert sorted(r[0] for r in list_snapshots(spark, table).collect()) == [0, 1, 2, 3]


def test_batch_that_is_run_again_replaces_itself(spark, raw, path, table):
    rows = score(parse_messages(raw.read(spark)), SCORER).drop("modelo")
    for name, number in [("a-0", 0), ("a-0", 0), ("b-0", 1), ("a-1", 2), ("b-0", 1)]:
        assert number_of(spark, table, name)[0] == number
        append_snapshot(rows, table, number, name)
    assert read_table(spark, table).count() == 120


def test_landed_rows_have_the_declared_columns(spark, raw, path, table):
    scored = FileTopic(path("scored"))
    score_batch(spark, raw, scored, SCORER, model_name="m")
    run(land_stream(spark, scored, table, path("progress"), interval=None))
    landed = read_table(spark, table)
    assert landed.columns == ["id_cliente", "target_real", "predicao", "justificativa"]
    assert Counter(landed.collect()) == Counter(scored_rows(spark, scored).collect())


def test_insert_from_a_named_stream(spark, raw, path, table):
    scored = FileTopic(path("scored"))
    score_batch(spark, raw, scored, SCORER)
    view = table.replace(".", "_")
    for _ in range(2):
        create_stream_view(read_scored(scored.read_stream(spark)), view)
    run(insert_stream(spark.sql(f"SELECT * FROM {view}"), table, path("progress"), interval=None))
    assert read_table(spark, table).count() == 40


def test_paced_replay(spark, texts, path):
    staged, raw = FileTopic(path("staged")), FileTopic(path("raw"))
    staged.append(texts(*map(message, range(6))).coalesce(1), rows_per_file=1)
    query = run(paced_replay(spark, staged, raw, path("progress"), interval=None))
    assert [p.numInputRows for p in query.recentProgress if p.numInputRows] == [1] * 6
    assert raw.read(spark).count() == 6


def test_commits_are_counted_as_they_pass(spark, raw, path, table):
    rows = score(parse_messages(raw.read_stream(spark, per_trigger=1)), SCORER)
    watched = counted(rows, "scored", fallbacks=F.count_if(F.col("predicao") == 0))
    with CommitCounts(spark, "scored") as counts:
        totals = counts.wait_for(insert_stream(watched.drop("modelo"), table, path("progress"), interval=None))
    assert totals == {"commits": 4, "rows": 40, "fallbacks": 8}


def test_counts_of_two_runs_with_one_name_stay_apart(spark, raw, path):
    told = []
    with CommitCounts(spark, "same", lambda batch, c: told.append((batch, c["rows"]))) as counts:
        for name, files in (("one", 1), ("two", 2)):
            query = score_stream(spark, raw, FileTopic(path(name)), SCORER, path(f"p-{name}"), per_trigger=files, interval=None, count_as="same")
            assert counts.wait_for(query) == {"commits": 4 // files, "rows": 40, "fallbacks": 8}
    assert sorted(batch for batch, _ in told) == [0, 0, 1, 1, 2, 3] and sum(rows for _, rows in told) == 80


def test_lag_by_progress(spark, raw, texts, path):
    run(paced_replay(spark, raw, FileTopic(path("copy")), path("progress"), per_trigger=4, interval=None))
    assert files_behind(spark, raw, path("progress")).first() == (0, 0)
    raw.append(texts("x", "yy").coalesce(1))
    assert files_behind(spark, raw, path("progress/")).first() == (1, 5)


def test_bad_message_fails_the_stream(spark, raw, texts, path):
    raw.append(texts("nope"))
    with pytest.raises(Exception, match="message is not a JSON object: nope"):
        run(score_stream(spark, raw, FileTopic(path("scored")), SCORER, path("progress"), interval=None))


def test_scored_text_survives_a_round_trip(spark, texts):
    rows = score(parse_messages(texts(message(1))), FunctionScorer(lambda _: json.dumps({"response": json.dumps({"predicao": 1, "justificativa": 'a "b"\n\\ \x1f'})})))
    assert read_scored(rows.select(scored_message().alias("value"))).first().justificativa == 'a "b"\n\\ \x1f'


def test_commits_at_an_interval_until_stopped(spark, raw, texts, path, table):
    scored = FileTopic(path("scored"))
    scoring = score_stream(spark, raw, scored, SCORER, path("p1"), interval="1 second")
    scoring.processAllAvailable()
    landing = land_stream(spark, scored, table, path("p2"), interval="1 second")
    raw.append(texts(message(40)))
    scoring.processAllAvailable()
    landing.processAllAvailable()
    assert read_table(spark, table).count() == 41
    for query in (scoring, landing):
        query.stop()
        assert not query.isActive and query.exception() is None


def test_steps_may_start_before_there_is_input(spark, texts, path, table):
    raw, scored = FileTopic(path("raw")), FileTopic(path("scored"))
    queries = [
        score_stream(spark, raw, scored, SCORER, path("p1"), interval="1 second"),
        land_stream(spark, scored, table, path("p2"), interval="1 second"),
    ]
    raw.append(texts(message(1)))
    for query in queries:
        query.processAllAvailable()
        query.stop()
    assert read_table(spark, table).count() == 1


def test_echo(spark, raw, path):
    query = run(echo(raw.read_stream(spark), path("progress"), interval=None))
    assert sum(p.numInputRows for p in query.recentProgress) == 40


def test_no_event_time(spark, raw):
    rows = score(parse_messages(raw.read_stream(spark)), SCORER)
    assert "EventTimeWatermark" not in rows._jdf.queryExecution().logical().toString()


def test_kafka_lag():
    source = SimpleNamespace(metrics={"avgOffsetsBehindLatest": "7.0", "maxOffsetsBehindLatest": "9"})
    assert offsets_behind(SimpleNamespace(lastProgress=SimpleNamespace(sources=[source, source]))) == 14
    assert offsets_behind(SimpleNamespace(lastProgress=None)) is None
    assert offsets_behind(SimpleNamespace(lastProgress=SimpleNamespace(sources=[SimpleNamespace(metrics={})]))) is None


def test_kafka_options():
    topic = KafkaTopic("b1:9092,b2:9092", "credit_applications_raw", group="scoring")
    assert topic._source() == {
        "kafka.bootstrap.servers": "b1:9092,b2:9092",
        "kafka.group.id": "scoring",
        "subscribe": "credit_applications_raw",
        "startingOffsets": "earliest",
    }
