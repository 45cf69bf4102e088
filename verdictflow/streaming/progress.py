"""Progress of running steps, kept in a folder, and what it says about their lag."""

from __future__ import annotations

import re
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from verdictflow.session import file_exists
from verdictflow.sources.topics import FileTopic, Topic

RECORD = (
    "query_id string, run_id string, batch bigint, at string, source int, description string, "
    "end_offset string, latest_offset string, rows bigint"
)


def progress_folder(checkpoint: str) -> str:
    """Where the commands keep the progress of the step with this checkpoint."""
    return f"{checkpoint.rstrip('/')}-progress"


class ProgressLog(StreamingQueryListener):
    """Notes where each source stood at each commit, and adds the notes to a folder.

    Offsets are those that the source itself reports: where the commit ended, and the latest
    there was, if it knows. Notes wait in memory for the next ``write``, which is a small
    file of as many rows as there were commits since. As a context, it writes every few
    seconds and at its end; the queries that run meanwhile are those that are noted.
    """

    def __init__(self, spark: SparkSession, folder: str, every: float = 10.0):
        self.spark, self.folder, self.every = spark, folder, every
        self.notes: list[tuple] = []
        self.ended: set[str] = set()
        self.news = threading.Condition()
        self.over = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self.news:
            self.notes += notes_of(event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()

    def write(self) -> int:
        """Add the waiting notes to the folder; how many there were."""
        with self.news:
            notes, self.notes = self.notes, []
        if notes:
            self.spark.createDataFrame(notes, RECORD).coalesce(1).write.mode("append").json(self.folder)
        return len(notes)

    def follow(self, query: StreamingQuery, seconds: float = 120.0) -> None:
        """Wait for a query's end and for the report of it; its error, if any, is raised after that."""
        try:
            query.awaitTermination()
        finally:
            with self.news:
                self.news.wait_for(lambda: str(query.runId) in self.ended, seconds)

    def _write_now_and_then(self) -> None:
        while not self.over.wait(self.every):
            self.write()

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        self.writer = threading.Thread(target=self._write_now_and_then, daemon=True)
        self.writer.start()
        return self

    def __exit__(self, *failure) -> None:
        self.spark.streams.removeListener(self)
        self.over.set()
        self.writer.join()
        self.write()


def notes_of(progress) -> list[tuple]:
    """One note per source of a progress report."""
    return [
        (str(progress.id), str(progress.runId), progress.batchId, progress.timestamp, i, s.description, s.endOffset, s.latestOffset, s.numInputRows)
        for i, s in enumerate(progress.sources)
    ]


def _messages(offsets: str) -> Column:
    """Sum of the offsets of all partitions, of the text ``{"topic": {"0": 12, ...}}``."""
    by_topic = F.from_json(offsets, "map<string, map<string, bigint>>")
    add = lambda total, n: total + n
    of_topic = F.transform(F.map_values(by_topic), lambda parts: F.aggregate(F.map_values(parts), F.lit(0).cast("bigint"), add))
    return F.aggregate(of_topic, F.lit(0).cast("bigint"), add)


def progress_of(spark: SparkSession, folder: str) -> DataFrame:
    """Each source of each step at its last commit: what it has taken in, and what was there.

    ``taken`` is the rows of all commits, each counted once though it may have been run
    again; ``later`` is the offsets between the commit's end and the latest at that time,
    null for a source that has no such offsets.
    """
    notes = spark.read.schema(RECORD).json(folder)
    once = notes.groupBy("query_id", "source", "batch").agg(
        F.max("rows").alias("rows"), F.max_by(F.struct("description", "end_offset", "latest_offset"), "at").alias("last")
    )
    sources = once.groupBy("query_id", "source").agg(
        F.max("batch").alias("batch"), F.sum("rows").alias("taken"), F.max_by("last", "batch").alias("last")
    )
    between = _messages("last.latest_offset") - _messages("last.end_offset")
    later = F.when(between.isNotNull(), F.greatest(between, F.lit(0)))
    return sources.select("query_id", "source", "last.description", "taken", "batch", later.alias("later"))


def lag(spark: SparkSession, topic: Topic, folder: str) -> DataFrame:
    """(taken, batch, later): messages that a step has taken in of a topic, its last commit, and messages it has yet to take in.

    A Kafka source says itself what it has not taken, as of its last commit. A file source
    does not: what its step took in is subtracted from the messages the topic has now, which
    are counted. A step that has committed nothing has taken nothing. Commits made without a
    log are not known, so the log has to be kept from a step's first commit on.
    """
    files = isinstance(topic, FileTopic)
    there = topic.read(spark).count() if files and file_exists(spark, topic.path) else 0
    if not file_exists(spark, folder):
        return spark.createDataFrame([(0, None, there if files else None)], "taken bigint, batch bigint, later bigint")
    if files:
        end = re.sub("^[a-z0-9]+:/+|/+$", "", topic.path).strip("/")
        return progress_of(spark, folder).where(F.col("description").endswith(f"/{end}]")).select("taken", "batch", (F.lit(there) - F.col("taken")).alias("later"))
    return progress_of(spark, folder).where(F.regexp_like("description", F.lit(rf"\bSubscribe\[{re.escape(topic.name)}\]"))).select("taken", "batch", "later")
