"""Counts and lag of running streams."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from verdictflow.sources.topics import FileTopic


class CommitCounts(StreamingQueryListener):
    """Sums what ``counted`` observed under a name, apart for each run of a query.

    A query's own progress list forgets all but the latest entries. Sums take the
    same space however long a stream runs; ``tell`` is called with each commit's counts.
    """

    def __init__(self, spark: SparkSession, name: str, tell: Callable[[int, dict[str, int]], None] | None = None):
        self.spark, self.name, self.tell = spark, name, tell
        self.totals: dict[str, Counter] = {}
        self.ended_runs: set[str] = set()
        self.news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        counts = event.progress.observedMetrics.get(self.name)
        if counts is not None and counts.rows:
            self.totals.setdefault(str(event.progress.runId), Counter()).update({"commits": 1, **counts.asDict()})
            if self.tell:
                self.tell(event.progress.batchId, counts.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.ended_runs.add(str(event.runId))
            self.news.notify_all()

    def wait_for(self, query: StreamingQuery, seconds: float = 120) -> Counter:
        """The sums of a query that ends; its end is reported after them."""
        query.awaitTermination()
        with self.news:
            if not self.news.wait_for(lambda: str(query.runId) in self.ended_runs, seconds):
                raise TimeoutError("the end of the stream was not reported")
        return self.totals.get(str(query.runId), Counter())

    def __enter__(self) -> CommitCounts:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *failure) -> None:
        self.spark.streams.removeListener(self)


def offsets_behind(query: StreamingQuery) -> int | None:
    """Messages that a Kafka stream has yet to take in, by its last progress; None if it does not say."""
    sources = query.lastProgress.sources if query.lastProgress else []
    behind = [s.metrics["avgOffsetsBehindLatest"] for s in sources if "avgOffsetsBehindLatest" in (s.metrics or {})]
    return round(sum(map(float, behind))) if behind else None


def files_behind(spark: SparkSession, topic: FileTopic, checkpoint: str) -> DataFrame:
    """Files and bytes of a topic that the stream of a checkpoint has yet to take in.

    Compares names only: those in the topic with those in the stream's own progress.
    """
    plain = lambda path: F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(topic.path)
    there = files.select(plain(F.col("path")).alias("path"), "length")
    log = spark.read.text(f"{checkpoint.rstrip('/')}/sources/0").where("startswith(value, '{')")
    taken = log.select(plain(F.get_json_object("value", "$.path")).alias("path"))
    left = there.where("length > 0").join(taken, "path", "left_anti")
    return left.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
