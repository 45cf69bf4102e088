"""A file replayed as a stream of so many rows per commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from verdictflow.operators.payload import decode_applications, raw_message
from verdictflow.operators.row_id import number_rows
from verdictflow.session import CommitNames, file_exists
from verdictflow.sources.files import scan_applications
from verdictflow.sources.topics import Topic
from verdictflow.streaming.steps import start


def numbered_messages(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """The messages of a file and their numbers in file order, written to ``folder`` once.

    A replay that goes on later finds them there, though the file may have grown or gone.
    """
    if not file_exists(spark, f"{folder}/_SUCCESS"):
        rows = decode_applications(number_rows(scan_applications(spark, path)), "row_id")
        rows.select(F.col("id_cliente").alias("number"), raw_message().alias("value")).write.mode("overwrite").parquet(folder)
    return spark.read.schema("number bigint, value string").parquet(folder)


def replay_rows(
    spark: SparkSession, messages: DataFrame, raw: Topic, checkpoint: str, *, rows_per_commit: int = 1, interval: str = "1 second"
) -> StreamingQuery:
    """Send ``rows_per_commit`` numbered messages per interval, in order; the last commit may have fewer.

    The stream is Spark's own counter of rows: its offset says where the next commit begins,
    and a replay that is started again goes on from there. Each commit reads its range of
    numbers alone, by the statistics of the stored row groups, and carries the stream's name
    in the topic, so a commit that is made again adds nothing. After the last message the
    stream has nothing to send, until ``finish`` or its owner ends it.
    """
    if rows_per_commit < 1:
        raise ValueError("a commit needs at least one row")
    names, total = CommitNames(checkpoint), messages.count()
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_commit).option("numPartitions", 1).load()

    def commit(batch: DataFrame, batch_id: int) -> None:
        begin = batch_id * rows_per_commit
        if begin >= total:
            return
        own = messages.where((F.col("number") >= begin) & (F.col("number") < begin + rows_per_commit))
        raw.append(own.select("value"), commit=names.of(batch.sparkSession, batch_id))

    return start(ticks.writeStream.foreachBatch(commit), checkpoint, interval)


def finish(query: StreamingQuery, messages: DataFrame, rows_per_commit: int, every: float = 0.2) -> int:
    """Stop a replay when all messages have been sent; how many there were."""
    total = messages.count()
    commits = -(-total // rows_per_commit)
    while not query.awaitTermination(every):
        last = query.lastProgress
        if not commits or (last is not None and last.batchId >= commits - 1):
            query.stop()
    return total
