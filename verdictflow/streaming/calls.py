"""Model calls of a scoring stream: asked, answered, fallbacks and how long they took, per commit."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from verdictflow.operators.evaluate import is_fallback

CALL_MS = "call_ms"
_RECORD = "run_id string, batch bigint, asked bigint, answered bigint, fallbacks bigint, latencies binary"


def asked(requests: DataFrame, name: str) -> DataFrame:
    """Requests, counted as they go into the stage."""
    return requests.observe(f"{name} asked", F.count("*").alias("asked"))


def answered(judged: DataFrame, name: str) -> DataFrame:
    """Verdicts, counted as they leave the stage, with a sketch of the times their calls took; the times go no further.

    A KLL sketch has a bounded size however many calls it stands for, and sketches of tasks
    and of commits add up: quantiles are right to about 1.3 % of the ranks.
    """
    sketch = F.kll_sketch_agg_double(F.col(CALL_MS)).alias("latencies")
    return judged.observe(f"{name} answered", F.count("*").alias("answered"), F.count_if(is_fallback()).alias("fallbacks"), sketch).drop(CALL_MS)


class CallLog(StreamingQueryListener):
    """What ``asked`` and ``answered`` observed under a name, one record per commit.

    Records wait in memory, a few KB each, until ``take`` hands them on.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.records: list[tuple] = []
        self.ended: set[str] = set()
        self.news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics
        before, after = seen.get(f"{self.name} asked"), seen.get(f"{self.name} answered")
        if before is not None and after is not None and before.asked:
            record = (str(event.progress.runId), event.progress.batchId, before.asked, after.answered, after.fallbacks, after.latencies)
            with self.news:
                self.records.append(record)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()

    def take(self) -> DataFrame:
        """The records so far as a table, to be stored or reported; they are forgotten here."""
        with self.news:
            records, self.records = self.records, []
        return self.spark.createDataFrame(records, _RECORD)

    def wait_for(self, query: StreamingQuery, seconds: float = 120) -> DataFrame:
        """The records of a query that ends; its end is reported after them."""
        query.awaitTermination()
        with self.news:
            if not self.news.wait_for(lambda: str(query.runId) in self.ended, seconds):
                raise TimeoutError("the end of the stream was not reported")
        return self.take()

    def __enter__(self) -> CallLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *failure) -> None:
        self.spark.streams.removeListener(self)


def call_report(records: DataFrame, *by: str) -> DataFrame:
    """asked, answered, waiting, fallbacks, median_ms and p99_ms of records, by columns of theirs or of all.

    ``waiting`` were asked and have no answer yet; none are in a commit that ended.
    """
    sketch = F.kll_merge_agg_double("latencies")
    sums = [F.sum(c).alias(c) for c in ("asked", "answered", "fallbacks")]
    summed = records.groupBy(*by).agg(*sums, sketch.alias("latencies"))
    # A sketch of nothing has no quantiles.
    quantile = lambda share: F.when(F.col("answered") > 0, F.kll_sketch_get_quantile_double("latencies", F.lit(share)))
    return summed.select(
        *by, "asked", "answered", (F.col("asked") - F.col("answered")).alias("waiting"), "fallbacks",
        F.when(F.col("answered") > 0, F.kll_sketch_get_n_double("latencies")).alias("timed"), quantile(0.5).alias("median_ms"), quantile(0.99).alias("p99_ms"),
    )
