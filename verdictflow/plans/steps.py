"""The four steps, end to end: replay, score, land, inspect."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from verdictflow.fixed_values import COMMIT_INTERVAL, ID_FIELD
from verdictflow.operators.evaluate import agreement_rate, backlog, confusion_matrix
from verdictflow.operators.messages import message_ids, parse_messages, read_scored, scored_message
from verdictflow.operators.payload import decode_applications, raw_message
from verdictflow.operators.row_id import number_rows
from verdictflow.operators.scorers import Scorer
from verdictflow.operators.scoring import score
from verdictflow.operators.snapshots import read_as_of
from verdictflow.sources.files import scan_applications
from verdictflow.sources.tables import head_rows, read_table
from verdictflow.sources.topics import Topic
from verdictflow.streaming.steps import start

log = logging.getLogger(__name__)


def file_applications(spark: SparkSession, path: str) -> DataFrame:
    """A file as decoded applications, numbered in file order."""
    return decode_applications(number_rows(scan_applications(spark, path)), "row_id")


def replay(spark: SparkSession, path: str, raw: Topic) -> int | None:
    """Send a file to the raw topic and count what was sent; None if there is no file.

    A message that cannot be sent fails the job. Sending the file again repeats
    its ids, and later steps keep the repeats.
    """
    try:
        applications = file_applications(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("no application file at %s", path)
        return None
    sent = Observation("replay")
    messages = applications.select(raw_message().alias("value"))
    raw.append(messages.observe(sent, F.count("*").alias("messages")))
    log.info("sent %d messages", sent.get["messages"])
    return sent.get["messages"]


def score_batch(spark: SparkSession, raw: Topic, scored: Topic, scorer: Scorer, **limits) -> None:
    """Raw topic to scored topic, everything there is, once."""
    judged = score(parse_messages(raw.read(spark)), scorer, **limits)
    scored.append(judged.select(scored_message().alias("value")))


def scored_rows(spark: SparkSession, scored: Topic) -> DataFrame:
    return read_scored(scored.read(spark))


def pending(spark: SparkSession, raw: Topic, scored: Topic) -> DataFrame:
    """Ids with messages that have no verdict yet, and how many; reads the ids of both topics."""
    return backlog(message_ids(raw.read(spark)), message_ids(scored.read(spark)), ID_FIELD)


def report(spark: SparkSession, table: str) -> None:
    """Verdicts against known outcomes, on the console."""
    rows = read_table(spark, table)
    confusion_matrix(rows).orderBy("target_real", "predicao").show()
    agreement_rate(rows).show()


def inspect(spark: SparkSession, table: str, rows: int = 10):
    """The first rows, as pandas; the limit is applied before they are collected."""
    return head_rows(read_table(spark, table), "id_cliente", "predicao", "justificativa", rows=rows).toPandas()


def inspect_arrow(spark: SparkSession, table: str, rows: int = 10):
    return head_rows(read_table(spark, table), "id_cliente", "predicao", "justificativa", rows=rows).toArrow()


def show(spark: SparkSession, table: str, rows: int = 10, as_of: int | None = None) -> None:
    """The first rows on the console, texts in full; of an earlier state, if given."""
    state = read_table(spark, table) if as_of is None else read_as_of(spark, table, as_of)
    head_rows(state, "id_cliente", rows=rows).show(rows, truncate=False)


def echo(messages: DataFrame, checkpoint: str, interval: str | None = COMMIT_INTERVAL) -> StreamingQuery:
    """Print the messages of a stream as they pass; for looking only."""
    writer = messages.select("value").writeStream.format("console").option("truncate", False)
    return start(writer, checkpoint, interval)
