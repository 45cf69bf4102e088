"""Topics: append-only streams of one text value per message, without keys."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from verdictflow.session import CommitNames, file_exists, make_folder


@dataclass(frozen=True)
class FileTopic:
    """A folder of text files, one message per line, one subfolder per commit."""

    path: str
    #: Streams pass over files that much older than the newest they have seen. The
    #: default passes over none; Spark's own of a week would lose backfills.
    max_file_age: str = "36500d"

    def append(self, messages: DataFrame, rows_per_file: int = 0, commit: str | None = None) -> None:
        """Add messages. A named commit that is there in full is not made again.

        A message with a line break, which would come back as several, fails the job.
        """
        folder = f"{self.path}/{commit or uuid.uuid4().hex}"
        if commit and file_exists(messages.sparkSession, f"{folder}/_SUCCESS"):
            return
        broken = F.raise_error(F.concat(F.lit("message has a line break: "), "value")).cast("string")
        lines = F.when(F.col("value").rlike("[\\r\\n]"), broken).otherwise(F.col("value"))
        writer = messages.select(lines.alias("value")).write.mode("overwrite")
        writer.option("maxRecordsPerFile", rows_per_file).text(folder)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("recursiveFileLookup", True).text(self.path)

    def read_stream(self, spark: SparkSession, per_trigger: int | None = None) -> DataFrame:
        """From the oldest file on; ``per_trigger`` bounds the files of one commit.

        The topic may still be empty.
        """
        make_folder(spark, self.path)
        reader = spark.readStream.option("recursiveFileLookup", True).option("maxFileAge", self.max_file_age)
        if per_trigger:
            reader = reader.option("maxFilesPerTrigger", per_trigger)
        return reader.text(self.path)

    def writer(self, messages: DataFrame, checkpoint: str) -> DataStreamWriter:
        """Commits carry the stream's id, so streams can write one topic in turn.

        Spark's own file sink would take the batches of a second checkpoint for
        ones it has already written, and drop them.
        """

        names = CommitNames(checkpoint)

        def commit(batch: DataFrame, batch_id: int) -> None:
            self.append(batch, commit=names.of(batch.sparkSession, batch_id))

        return messages.select("value").writeStream.foreachBatch(commit)


@dataclass(frozen=True)
class KafkaTopic:
    """A Kafka topic. Needs the connector package; not exercised by the tests."""

    servers: str
    name: str
    group: str | None = None

    def _options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.servers}

    def _source(self) -> dict[str, str]:
        group = {"kafka.group.id": self.group} if self.group else {}
        return {**self._options(), **group, "subscribe": self.name, "startingOffsets": "earliest"}

    def append(self, messages: DataFrame, commit: str | None = None) -> None:
        """Add messages. Kafka keeps no names of commits: one that is made again is there twice."""
        messages.select("value").write.format("kafka").options(**self._options(), topic=self.name).save()

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.format("kafka").options(**self._source()).load().selectExpr("CAST(value AS STRING) value")

    def read_stream(self, spark: SparkSession, per_trigger: int | None = None) -> DataFrame:
        """From the earliest offset on; ``per_trigger`` bounds the messages of one commit."""
        reader = spark.readStream.format("kafka").options(**self._source())
        if per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", per_trigger)
        return reader.load().selectExpr("CAST(value AS STRING) value")

    def writer(self, messages: DataFrame, checkpoint: str) -> DataStreamWriter:
        return messages.select("value").writeStream.format("kafka").options(**self._options(), topic=self.name)


Topic = FileTopic | KafkaTopic
