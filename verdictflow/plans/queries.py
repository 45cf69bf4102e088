"""Every operator as a query over the whole driver tables."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.fixed_values import ACCOUNT_STATUS, CREDIT_HISTORY, LOAN_PURPOSE
from verdictflow.functions.decode import decode, decode_by_table
from verdictflow.functions.prompt import prompt, request
from verdictflow.operators import evaluate
from verdictflow.operators.messages import parse_messages, read_quarantine, read_scored, scored_message
from verdictflow.operators.payload import decode_applications, profile, raw_message
from verdictflow.operators.row_id import number_rows
from verdictflow.operators.scorers import RubricScorer, Scorer
from verdictflow.operators.scoring import score
from verdictflow.operators.snapshots import (
    append_snapshot,
    compact,
    create_snapshot_table,
    read_as_of,
    read_latest,
    rollback_to,
    snapshot_counts,
)
from verdictflow.operators.verdict import verdict
from verdictflow.plans.applications import coded_applications, table
from verdictflow.plans.steps import file_applications, pending, score_batch
from verdictflow.session import delete_folder, scratch_path
from verdictflow.sources.files import scan_applications, scan_or_reject
from verdictflow.sources.tables import (
    create_database,
    create_scored_table,
    create_stream_view,
    head_rows,
    read_table,
)
from verdictflow.sources.topics import FileTopic
from verdictflow.streaming.backlog import backlog_now, create_backlog_table, watch_backlog
from verdictflow.streaming.calls import CallLog, call_report
from verdictflow.streaming.metrics import CommitCounts
from verdictflow.streaming.replay import finish, numbered_messages, replay_rows
from verdictflow.streaming.steps import insert_stream, land_stream, score_stream

MODEL = "rubric"


def _decoded(spark: SparkSession, sf_dir: str, tasks: int = 0) -> DataFrame:
    return decode_applications(coded_applications(spark, sf_dir, tasks), "o_orderkey")


def _tasks(spark: SparkSession) -> int:
    """Tasks that the queries with a model or file stage ask for: the test tables are one row group each."""
    return spark.sparkContext.defaultParallelism


# --- Columns ------------------------------------------------------------------


def decode_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes to labels; codes without one stay as they are."""
    coded = coded_applications(spark, sf_dir)
    return coded.select(
        "o_orderkey",
        decode(F.col("_c0"), ACCOUNT_STATUS).alias("status"),
        decode(F.col("_c2"), CREDIT_HISTORY).alias("history"),
        decode(F.col("_c3"), LOAN_PURPOSE).alias("purpose"),
    )


def application_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded rows to message text."""
    return _decoded(spark, sf_dir).select("id_cliente", raw_message().alias("value"))


def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event messages whose label is absent, null or given, and ids of every type, by event type."""
    events = table(spark, sf_dir, "events")
    number = F.col("event_id").cast("string")
    own_id = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit('"abc-'), number, F.lit('"')))
        .when(F.col("event_type") == "error", F.concat(number, F.lit(".5")))
        .when(F.col("user_id") < 10, F.lit("null"))
        .when(F.col("user_id") < 20, F.lit("true"))
        .otherwise(number)
    )
    label = (
        F.when(F.col("event_type") == "view", F.lit(', "target_real": null'))
        .when(F.col("event_type") == "purchase", F.format_string(', "target_real": %d', "user_id"))
        .otherwise(F.lit(""))
    )
    text = F.concat(F.lit('{"id_cliente": '), own_id, F.lit(', "props": '), F.col("props"), label, F.lit("}"))
    parsed = parse_messages(events.select("event_type", text.alias("value")), carry=("event_type",))
    return parsed.select("event_type", "id_cliente", "target_real")


def label_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label messages as the model would see them."""
    labels = table(spark, sf_dir, "labels")
    text = F.to_json(
        F.struct(F.col("toxic"), F.col("quality").alias("target_real"), F.col("doc_id").alias("id_cliente"))
    )
    return parse_messages(labels.select(text.alias("value")))


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).select("id_cliente", prompt(profile()).alias("prompt"))


def request_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).select("id_cliente", request(profile(), MODEL).alias("request"))


def validate_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good, invalid and broken replies, made from every event."""
    events = table(spark, sf_dir, "events")
    kind, user, number = F.col("event_type"), F.col("user_id"), F.col("event_id").cast("string")
    answer = (
        F.when(kind == "click", F.concat(F.lit('{"predicao":1,"justificativa":"evento '), number, F.lit('"}')))
        .when(kind == "error", F.concat(F.lit("falha "), number))
        .when(kind == "purchase", F.concat(F.lit('{"predicao":'), user, F.lit(',"justificativa":null}')))
        .when(kind == "signup", F.concat(F.lit('{"predicao":"'), user, F.lit('"}')))
        .when(user < 20, F.concat(F.lit("["), number, F.lit("]")))
        .when(user < 40, F.lit("{}"))
        .when(user < 60, F.lit('{"predicao":true,"justificativa":"sim"}'))
        .otherwise(F.lit('{"predicao":2}'))
    )
    field = F.when(F.col("value") < 5, F.lit("error")).otherwise(F.lit("response"))
    envelope = F.to_json(F.create_map(field, answer))
    judged = verdict(envelope).alias("verdict")
    return events.repartition(_tasks(spark)).select("event_id", judged).select("event_id", "verdict.*")


def decode_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers of all line items to names, by a table that lacks every seventh part."""
    parts = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0")
    codes = parts.select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("label"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"))
    return decode_by_table(items, "part", codes)


# --- Files --------------------------------------------------------------------


def row_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items numbered in file order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return number_rows(items)


def scan_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the applications as space-separated files, scan, number, decode."""
    path = scratch_path(spark, "file")
    coded = coded_applications(spark, sf_dir).withColumn("_c4", F.col("_c4").cast("int"))
    coded.drop("o_orderkey").write.csv(path, sep=" ")
    return file_applications(spark, path)


def scan_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 21 fields of written application files under the declared types."""
    path = scratch_path(spark, "file")
    coded = coded_applications(spark, sf_dir, _tasks(spark)).withColumn("_c4", F.col("_c4").cast("int"))
    coded.drop("o_orderkey").write.csv(path, sep=" ")
    return scan_applications(spark, path)


def scan_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application files with short lines, long lines and letters in numbers: what fits, and what does not and why."""
    path = scratch_path(spark, "file")
    coded = coded_applications(spark, sf_dir).withColumn("_c4", F.col("_c4").cast("int").cast("string"))
    key = F.col("o_orderkey")
    amount = F.when(key % 5 == 1, F.concat(F.lit("x"), "_c4")).otherwise(F.col("_c4"))
    fields = [amount if c == "_c4" else F.col(c).cast("string") for c in coded.columns if c != "o_orderkey"]
    line = F.concat_ws(" ", *fields)
    line = F.when(key % 7 == 2, F.substring_index(line, " ", 12)).when(key % 7 == 3, F.concat(line, F.lit(" A1"))).otherwise(line)
    coded.select(line.alias("value")).write.text(path)
    good, rejected = scan_or_reject(spark, path)
    good = good.select("row_id", F.col("_c4").alias("amount"), F.col("_c20").alias("outcome"))
    nothing = F.lit(None)
    return good.select("*", nothing.cast("string").alias("line"), nothing.cast("string").alias("reason")).unionByName(
        rejected.select("row_id", nothing.cast("int").alias("amount"), nothing.cast("int").alias("outcome"), "line", "reason")
    )


# --- Scoring ------------------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str, *carry: str) -> DataFrame:
    decoded = _decoded(spark, sf_dir, _tasks(spark))
    requests = decoded.select("id_cliente", "target_real", *carry, profile().alias("perfil"))
    return score(requests, RubricScorer(), model_name=MODEL)


def score_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode, render, ask, judge, and write the scored message."""
    return _scored(spark, sf_dir).select("id_cliente", "predicao", scored_message().alias("value"))


def scored_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-field messages read under the four-column schema."""
    return read_scored(_scored(spark, sf_dir).select(scored_message().alias("value")))


class ScriptedScorer(Scorer):
    """Answers, breaks and stalls by what the profile says."""

    def answer(self, profile: str, timeout_s: float) -> str:
        event = json.loads(profile)
        if event["event_type"] == "error":
            raise ConnectionError(f"down {event['event_id']}")
        if event["event_type"] == "signup":
            time.sleep(timeout_s)
            raise TimeoutError
        answers = {"purchase": {"predicao": [1]}, "view": {"predicao": 2.0, "justificativa": {"a": 1}}, "click": {"predicao": {}}}
        return json.dumps({"response": json.dumps(answers[event["event_type"]])})


def score_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, timeouts and verdicts of the wrong type, with several calls in flight."""
    events = table(spark, sf_dir, "events")
    requests = events.select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("perfil"))
    judged = score(requests, ScriptedScorer(), max_in_flight=4, partitions=_tasks(spark), request_timeout_s=0.001)
    return judged.select("event_id", "predicao", "justificativa")


class StuckScorer(Scorer):
    """Answers, but now and then never comes back, whatever time it is given."""

    def answer(self, profile: str, timeout_s: float) -> str:
        number = json.loads(profile)["event_id"]
        if number % 1000 == 0:
            threading.Event().wait()
        return json.dumps({"response": json.dumps({"predicao": 1 + number % 2, "justificativa": ""})})


def calls_cut_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event judged by a scorer of which some calls never end."""
    events = table(spark, sf_dir, "events")
    requests = events.select("event_id", F.to_json(F.struct("event_id")).alias("perfil"))
    judged = score(requests, StuckScorer(), max_in_flight=4, partitions=_tasks(spark), request_timeout_s=0.1)
    return judged.select("event_id", "predicao", "justificativa")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_matrix(_scored(spark, sf_dir))


def agreement_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.agreement_rate(_scored(spark, sf_dir))


def prediction_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir, "status_conta_corrente", "proposito_emprestimo")
    return evaluate.prediction_profile(scored, "status_conta_corrente", "proposito_emprestimo")


def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, or with fewer labels than copies."""
    return evaluate.backlog(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def topic_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages sent twice and judged once: one of each id is pending."""
    raw, scored = _raw_topic(spark, sf_dir), FileTopic(scratch_path(spark, "scored"))
    score_batch(spark, raw, scored, RubricScorer(), model_name=MODEL)
    raw.append(_decoded(spark, sf_dir, _tasks(spark)).select(raw_message().alias("value")))
    return pending(spark, raw, scored).withColumn("id_cliente", F.col("id_cliente").cast("bigint"))


# --- Streams ------------------------------------------------------------------


def _event_topic(spark: SparkSession, sf_dir: str) -> FileTopic:
    """Events as messages, in more files than one commit takes in."""
    topic = FileTopic(scratch_path(spark, "events"))
    events = table(spark, sf_dir, "events").repartition(2 * _tasks(spark))
    topic.append(events.select(F.to_json(F.struct("*"), _EVENT_TIME).alias("value")))
    return topic


_EVENT_TIME = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _event_stream(spark: SparkSession, topic: FileTopic, per_trigger: int | None = None) -> DataFrame:
    row = F.from_json("value", _EVENT_SCHEMA, {"mode": "FAILFAST", **_EVENT_TIME})
    return topic.read_stream(spark, per_trigger).select(row.alias("row")).select("row.*")


def _event_table(spark: SparkSession, rows: DataFrame) -> str:
    name = f"{_database(spark)}.events"
    create_snapshot_table(spark, name, rows.schema)
    return name


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event messages appended to a table in bounded commits, then a rerun that adds none."""
    topic = _event_topic(spark, sf_dir)
    rows = _event_stream(spark, topic, per_trigger=_tasks(spark))
    name, checkpoint = _event_table(spark, rows), scratch_path(spark, "progress")
    for _ in range(2):
        insert_stream(rows, name, checkpoint, interval=None).awaitTermination()
    return read_latest(spark, name)


def replay_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same topic read twice from its start into one table: copies stay."""
    topic = _event_topic(spark, sf_dir)
    rows = _event_stream(spark, topic, per_trigger=_tasks(spark))
    name = _event_table(spark, rows)
    for _ in range(2):
        insert_stream(rows, name, scratch_path(spark, "progress"), interval=None).awaitTermination()
    return read_latest(spark, name).groupBy("event_id", "event_type").agg(F.count("*").alias("copies"))


def replay_same_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose checkpoint was lost starts over at the same path, with other bounds: nothing is lost."""
    topic, progress = _event_topic(spark, sf_dir), scratch_path(spark, "progress")
    name = _event_table(spark, _event_stream(spark, topic))
    for files in (_tasks(spark), 2 * _tasks(spark)):
        delete_folder(spark, progress)
        insert_stream(_event_stream(spark, topic, per_trigger=files), name, progress, interval=None).awaitTermination()
    return read_latest(spark, name).groupBy("event_id", "event_type").agg(F.count("*").alias("copies"))


def _database(spark: SparkSession) -> str:
    warehouse = scratch_path(spark, "warehouse")
    name = "scored_" + warehouse[-32:]
    create_database(spark, name, warehouse)
    return name


def _raw_topic(spark: SparkSession, sf_dir: str) -> FileTopic:
    raw = FileTopic(scratch_path(spark, "raw"))
    raw.append(_decoded(spark, sf_dir, _tasks(spark)).select(raw_message().alias("value")))
    return raw


def score_and_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw topic, scored topic, table: two streams, each with its own progress."""
    raw, scored = _raw_topic(spark, sf_dir), FileTopic(scratch_path(spark, "scored"))
    name = f"{_database(spark)}.credit_scored"
    create_scored_table(spark, name)
    bounds = {"per_trigger": 4 * _tasks(spark), "interval": None}
    score_stream(
        spark, raw, scored, RubricScorer(), scratch_path(spark, "progress"), model_name=MODEL, **bounds
    ).awaitTermination()
    land_stream(spark, scored, name, scratch_path(spark, "progress"), **bounds).awaitTermination()
    return read_table(spark, name)


def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declare the stream and the table in SQL and insert one into the other."""
    scored = FileTopic(scratch_path(spark, "scored"))
    scored.append(_scored(spark, sf_dir).select(scored_message().alias("value")))
    database = _database(spark)
    stream = scored.read_stream(spark, per_trigger=4 * _tasks(spark))
    create_stream_view(read_scored(stream), f"{database}_stream")
    create_scored_table(spark, f"{database}.credit_scored")
    rows = spark.sql(f"SELECT * FROM {database}_stream")
    insert_stream(rows, f"{database}.credit_scored", scratch_path(spark, "progress"), None).awaitTermination()
    return read_table(spark, f"{database}.credit_scored")


def head_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows of the landed table."""
    path = scratch_path(spark, "table")
    _scored(spark, sf_dir).drop("modelo").write.parquet(path)
    return head_rows(spark.read.parquet(path), "id_cliente")


def replay_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications replayed from a file a fifth at a time, stopped after two commits and gone on with: what each commit sent."""
    path, folder, progress = (scratch_path(spark, name) for name in ("file", "numbered", "progress"))
    coded = coded_applications(spark, sf_dir).withColumn("_c4", F.col("_c4").cast("int"))
    coded.drop("o_orderkey").write.csv(path, sep=" ")
    raw, messages = FileTopic(scratch_path(spark, "raw")), numbered_messages(spark, path, folder)
    rows = -(-messages.count() // 5)
    for part, interval in ((messages.limit(2 * rows), "1 second"), (messages, "100 milliseconds")):
        finish(replay_rows(spark, messages, raw, progress, rows_per_commit=rows, interval=interval), part, rows)
    sent = raw.read(spark).select(F.regexp_extract("_metadata.file_path", r"-(\d+)/[^/]+$", 1).cast("bigint").alias("commit"), "value")
    number = F.get_json_object("value", "$.id_cliente").cast("bigint")
    found = sent.select("commit", number.alias("number")).groupBy("commit")
    return found.agg(F.count("*").alias("rows"), F.min("number").alias("first"), F.max("number").alias("last"))


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts and fallbacks of a scoring stream, counted as they pass and summed over its commits."""
    raw, scored = _raw_topic(spark, sf_dir), FileTopic(scratch_path(spark, "scored"))
    name = "ingest " + raw.path[-32:]
    with CommitCounts(spark, name) as counts:
        query = score_stream(
            spark, raw, scored, RubricScorer(), scratch_path(spark, "progress"), per_trigger=2, interval=None, count_as=name
        )
        seen = counts.wait_for(query)
    return spark.createDataFrame([(seen["rows"], seen["fallbacks"])], "rows bigint, failed bigint")


class EventScorer(Scorer):
    """Says which event it was asked about."""

    def answer(self, profile: str, timeout_s: float) -> str:
        event = json.loads(profile)
        return json.dumps({"response": json.dumps({"predicao": 1, "justificativa": f"{event['tipo']} {event['id_cliente']}"})})


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event messages of which some are cut off and some are lists: verdicts of the others, and these with the reason."""
    events = table(spark, sf_dir, "events").repartition(_tasks(spark))
    kind = F.col("event_type")
    text = F.when(kind == "error", F.expr("left(value, length(value) - 1)")).when(kind == "signup", F.expr("'[' || value || ']'")).otherwise(F.col("value"))
    plain = F.format_string('{"id_cliente": %d, "target_real": %d, "tipo": "%s"}', "event_id", "user_id", "event_type")
    raw, scored, aside = (FileTopic(scratch_path(spark, name)) for name in ("raw", "scored", "quarantine"))
    raw.append(events.withColumn("value", plain).select(text.alias("value")))
    bounds = {"per_trigger": 4, "interval": None, "model_name": MODEL}
    score_stream(spark, raw, scored, EventScorer(), scratch_path(spark, "progress"), quarantine=aside, **bounds).awaitTermination()
    judged = read_scored(scored.read(spark)).select("id_cliente", "target_real", "predicao", "justificativa", F.lit(None).cast("string").alias("message"))
    bad = read_quarantine(aside.read(spark))
    return judged.unionByName(bad.select("message", F.col("reason").alias("justificativa")), allowMissingColumns=True)


def call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a scoring stream by commit: each takes in the quarter of the applications that was sent with it."""
    raw, scored = FileTopic(scratch_path(spark, "raw")), FileTopic(scratch_path(spark, "scored"))
    for part in range(4):
        quarter = _decoded(spark, sf_dir).where(F.col("id_cliente") % 4 == part)
        raw.append(quarter.select(raw_message().alias("value")).coalesce(1))
    with CallLog(spark, name := "calls " + raw.path[-32:]) as log:
        query = score_stream(
            spark, raw, scored, RubricScorer(), scratch_path(spark, "progress"), per_trigger=1, interval=None, calls_as=name, partitions=_tasks(spark)
        )
        told = call_report(log.wait_for(query), "batch")
    ordered = (F.col("median_ms") >= 0) & (F.col("median_ms") <= F.col("p99_ms"))
    return told.select("batch", "asked", "answered", "waiting", "fallbacks", "timed", ordered.alias("ordered"))


def live_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, as a stream of documents and labels knows it after each of its commits."""
    raw, scored = (FileTopic(scratch_path(spark, name)) for name in ("raw", "scored"))
    name, progress = f"{_database(spark)}.backlog", scratch_path(spark, "progress")
    create_backlog_table(spark, name)
    ids = lambda t: table(spark, sf_dir, t).select(F.format_string('{"id_cliente": %d}', "doc_id").alias("value"))
    for topic, t in ((raw, "documents"), (scored, "labels"), (raw, "documents")):
        topic.append(ids(t))
        watch_backlog(spark, raw, scored, name, progress, interval=None).awaitTermination()
    states = [backlog_now(spark, name, n).select(F.lit(n).alias("commit"), F.col("id_cliente").cast("bigint").alias("doc_id"), "pending") for n in range(3)]
    return states[0].unionByName(states[1]).unionByName(states[2])


# --- Snapshots ----------------------------------------------------------------


def _event_snapshots(spark: SparkSession, sf_dir: str) -> str:
    """Three commits in time order; each reads only the row groups of its time."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    name = _event_table(spark, events)
    second, third = "TIMESTAMP_NTZ '2024-01-11 00:00:00'", "TIMESTAMP_NTZ '2024-01-21 00:00:00'"
    times = [f"ts < {second}", f"ts >= {second} AND ts < {third}", f"ts >= {third} OR ts IS NULL"]
    for snapshot, time in enumerate(times):
        append_snapshot(events.where(time), name, snapshot)
    return name


def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as it was after the second commit."""
    return read_as_of(spark, _event_snapshots(spark, sf_dir), 1)


def snapshot_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each commit added."""
    return snapshot_counts(spark, _event_snapshots(spark, sf_dir))


def snapshot_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after going back to the first commit."""
    name = _event_snapshots(spark, sf_dir)
    rollback_to(spark, name, 0)
    return read_as_of(spark, name, 99)


def snapshot_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after its first two commits have been joined."""
    name = _event_snapshots(spark, sf_dir)
    compact(spark, name, keep=1)
    return read_as_of(spark, name, 99)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        decode_passthrough,
        application_payload,
        json_defaults,
        label_holdout,
        prompt_render,
        request_payload,
        validate_reply,
        decode_parts,
        row_id,
        scan_file,
        scan_types,
        scan_lenient,
        score_applications,
        scored_projection,
        score_failures,
        calls_cut_off,
        confusion_matrix,
        agreement_rate,
        prediction_profile,
        backlog,
        topic_backlog,
        stream_append,
        replay_append,
        replay_same_path,
        replay_pace,
        score_and_land,
        insert_select,
        ingest_counts,
        dead_letters,
        call_counts,
        live_backlog,
        snapshot_as_of,
        snapshot_audit,
        snapshot_rollback,
        snapshot_compact,
    )
} | {"head_rows": head_of_table}
