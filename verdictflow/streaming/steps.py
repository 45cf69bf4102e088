"""The streaming steps. Each has its own checkpoint and so its own progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from verdictflow.fixed_values import COMMIT_INTERVAL
from verdictflow.operators.answers import forget, score_once
from verdictflow.operators.evaluate import is_fallback
from verdictflow.operators.messages import parse_messages, read_messages, read_scored, scored_message
from verdictflow.operators.scorers import Scorer
from verdictflow.operators.scoring import score
from verdictflow.operators.snapshots import CommitNumbers, append_snapshot
from verdictflow.session import CommitNames, delete_folder, scratch_path
from verdictflow.sources.topics import Topic
from verdictflow.streaming.calls import CALL_MS, answered, asked


def score_stream(
    spark: SparkSession,
    raw: Topic,
    scored: Topic,
    scorer: Scorer,
    checkpoint: str,
    *,
    per_trigger: int | None = None,
    interval: str | None = COMMIT_INTERVAL,
    count_as: str | None = None,
    calls_as: str | None = None,
    quarantine: Topic | None = None,
    answers: str | None = None,
    **limits,
) -> StreamingQuery:
    """Raw topic to scored topic; rows and fallbacks are counted under ``count_as``, calls under ``calls_as``.

    Storing the verdicts before anything else uses them keeps it at one model
    call per row; a lost micro-batch is the most that is asked again, so
    ``per_trigger`` bounds it.

    A text that is no message stops the stream, unless there is a ``quarantine`` for it:
    then each commit is parsed once and stored, its messages are judged, and the other
    texts go there with the reason, under the same name. Nothing is counted in this case.
    With a folder for ``answers`` besides, a commit that is lost halfway and made again asks
    for what it has no answer to (``score_once``).
    """
    messages = raw.read_stream(spark, per_trigger)
    if quarantine is not None:
        if count_as or calls_as:
            raise ValueError("a step with a quarantine counts nothing: its commits are written by two batch jobs")
        return _score_or_set_aside(messages, scored, quarantine, scorer, checkpoint, interval, answers, limits)
    if answers:
        raise ValueError("answers are kept by the steps that have a quarantine")
    requests = parse_messages(messages)
    if calls_as:
        requests, limits = asked(requests, calls_as), {**limits, "call_ms": CALL_MS}
    judged = score(requests, scorer, **limits)
    if calls_as:
        judged = answered(judged, calls_as)
    if count_as:
        judged = counted(judged, count_as, fallbacks=F.count_if(is_fallback()))
    messages = judged.select(scored_message().alias("value"))
    return start(scored.writer(messages, checkpoint), checkpoint, interval)


def _score_or_set_aside(
    messages: DataFrame, scored: Topic, quarantine: Topic, scorer: Scorer, checkpoint: str, interval: str | None, answers: str | None, limits: dict
) -> StreamingQuery:
    names = CommitNames(checkpoint)

    def commit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name, path = names.of(spark, batch_id), scratch_path(spark, "messages")
        read_messages(batch.select("value", F.col("value").alias("message")), carry=("message",)).write.parquet(path)
        read = spark.read.parquet(path)
        good = read.where("reason IS NULL").drop("message", "reason")
        if answers:
            judged = score_once(spark, good, scorer, f"{answers}/{name}", **limits)
        else:
            judged = score(good, scorer, **limits)
        record = F.to_json(F.struct("message", "reason"), {"ignoreNullFields": "false"})
        scored.append(judged.select(scored_message().alias("value")), commit=name)
        quarantine.append(read.where("reason IS NOT NULL").select(record.alias("value")), commit=name)
        delete_folder(spark, path)
        if answers:
            forget(spark, f"{answers}/{name}")

    return start(messages.writeStream.foreachBatch(commit), checkpoint, interval)


def land_stream(
    spark: SparkSession,
    scored: Topic,
    table: str,
    checkpoint: str,
    *,
    per_trigger: int | None = None,
    interval: str | None = COMMIT_INTERVAL,
    count_as: str | None = None,
) -> StreamingQuery:
    """Scored topic to table, one snapshot per micro-batch."""
    rows = read_scored(scored.read_stream(spark, per_trigger))
    if count_as:
        rows = counted(rows, count_as, fallbacks=F.count_if(is_fallback()))
    return insert_stream(rows, table, checkpoint, interval)


def insert_stream(
    rows: DataFrame, table: str, checkpoint: str, interval: str | None = COMMIT_INTERVAL
) -> StreamingQuery:
    """``INSERT INTO table SELECT ...`` for a streaming select, a snapshot per commit."""

    names, numbers = CommitNames(checkpoint), CommitNumbers(table)

    def commit(batch: DataFrame, batch_id: int) -> None:
        name = names.of(batch.sparkSession, batch_id)
        append_snapshot(batch, table, numbers.of(batch.sparkSession, name), name)

    return start(rows.writeStream.foreachBatch(commit), checkpoint, interval)


def paced_replay(
    spark: SparkSession,
    staged: Topic,
    raw: Topic,
    checkpoint: str,
    *,
    per_trigger: int = 1,
    interval: str | None = "1 second",
) -> StreamingQuery:
    """Pass messages on at a bounded rate: so many files or offsets per interval.

    With one message per staged file, the defaults send one message a second.
    """
    return start(raw.writer(staged.read_stream(spark, per_trigger), checkpoint), checkpoint, interval)


def start(writer: DataStreamWriter, checkpoint: str, interval: str | None) -> StreamingQuery:
    """Commit at the interval; without one, take in what is there and stop."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def counted(rows: DataFrame, name: str, **metrics) -> DataFrame:
    """Count rows per micro-batch while they pass; no second read is needed."""
    return rows.observe(name, F.count("*").alias("rows"), *[m.alias(n) for n, m in metrics.items()])
