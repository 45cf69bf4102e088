"""Answers kept as they come, so that a task or a job that is run again asks for the rest only."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.operators.scorers import Scorer
from verdictflow.operators.scoring import score
from verdictflow.session import delete_folder, file_exists

ROW = "asked_row"


@dataclass(frozen=True)
class AnswerLog:
    """A shared folder to which tasks add files of answered rows while they run.

    A file has a whole part of a task's answers or is not there: it is written under a name
    that readers pass over, and moved. Names tell the run and the partition, so a task that is
    run again finds what its earlier attempts kept. The folder has to be one that executors
    reach without Spark: a mounted path, or a store that Arrow has a driver for.
    """

    folder: str
    flush_rows: int = 100
    run: str = field(default_factory=lambda: uuid.uuid4().hex)

    def _files(self) -> tuple[FileSystem, str]:
        local = re.match(r"^(?:file:/*(?=/))?(/.*)$", self.folder)
        return (LocalFileSystem(), local[1]) if local else FileSystem.from_uri(self.folder)

    def left(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a task that none of its earlier attempts has an answer to."""
        task = TaskContext.get()
        kept = self.kept_by(task.partitionId()) if task.attemptNumber() else pa.array([], pa.int64())
        for batch in batches:
            yield batch.filter(pc.invert(pc.is_in(batch.column(ROW), kept))) if len(kept) else batch

    def kept_by(self, partition: int) -> pa.Array:
        files, path = self._files()
        found = files.get_file_info(FileSelector(path, allow_not_found=True))
        mine = [f.path for f in found if re.search(rf"/answers-{self.run}-{partition}-[0-9a-f]+\.parquet$", f.path)]
        rows = [pq.read_table(p, columns=[ROW], filesystem=files, partitioning=None).column(ROW) for p in mine]
        return pa.concat_arrays([c for r in rows for c in r.chunks]) if rows else pa.array([], pa.int64())

    def keep(self, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same rows, kept before they are handed on."""
        partition, held, rows = TaskContext.get().partitionId(), [], 0
        for part in parts:
            held.append(part)
            rows += part.num_rows
            if rows >= self.flush_rows:
                yield self._add(pa.concat_batches(held), partition)
                held, rows = [], 0
        if rows:
            yield self._add(pa.concat_batches(held), partition)

    def _add(self, rows: pa.RecordBatch, partition: int) -> pa.RecordBatch:
        files, path = self._files()
        files.create_dir(path, recursive=True)
        name = f"answers-{self.run}-{partition}-{uuid.uuid4().hex}.parquet"
        pq.write_table(pa.Table.from_batches([rows]), f"{path}/_{name}", filesystem=files)
        files.move(f"{path}/_{name}", f"{path}/{name}")
        return rows


def score_once(spark: SparkSession, requests: DataFrame, scorer: Scorer, folder: str, *, flush_rows: int = 100, **limits) -> DataFrame:
    """What ``score`` gives for all ``requests``, asking for each row that has no answer in ``folder`` yet.

    The first call stores the requests there, with a number for each row, so rows that are
    equal are rows of their own and a later call for the same work, under the same folder,
    goes on where the earlier one broke off, whatever ``requests`` would give now. Asked
    again are calls under way when a task or the job was lost, and up to ``flush_rows``
    answers per task that had not been kept. The folder is the caller's to delete
    (``forget``), once the result is stored.
    """
    asked, answers = f"{folder}/requests", f"{folder}/answers"
    if not file_exists(spark, f"{asked}/_SUCCESS"):
        requests.withColumn(ROW, F.monotonically_increasing_id()).write.mode("overwrite").parquet(asked)
    rows = spark.read.parquet(asked)
    log = AnswerLog(answers, flush_rows)
    judged = score(rows, scorer, answer_log=log, **limits)
    schema = judged.drop("modelo").schema
    if file_exists(spark, answers):
        known = spark.read.schema(schema).parquet(answers).select(ROW)
        judged = score(rows.join(known, ROW, "left_anti"), scorer, answer_log=log, **limits)
    judged.write.format("noop").mode("overwrite").save()
    if not file_exists(spark, answers):
        return judged.drop(ROW)  # nothing was asked, nothing is there
    # A task that was given up for lost may have kept rows that its second attempt kept too.
    kept = spark.read.schema(schema).parquet(answers).dropDuplicates([ROW])
    return kept.withColumn("modelo", F.lit(limits.get("model_name")).cast("string")).drop(ROW)


def forget(spark: SparkSession, folder: str) -> None:
    """Delete the requests and answers of work that is done."""
    delete_folder(spark, folder)
