"""The backlog as a stream: per id, messages that have no verdict yet, kept as keyed state."""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection, Iterator
from contextlib import contextmanager
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from verdictflow.fixed_values import COMMIT_INTERVAL, ID_FIELD
from verdictflow.operators.messages import message_ids
from verdictflow.operators.snapshots import create_snapshot_table, read_as_of
from verdictflow.sources.topics import Topic
from verdictflow.streaming.steps import insert_stream

_STATE = f"{ID_FIELD} string, pending bigint"
#: Part of a stream's state, as ids are found again by their bucket: a checkpoint ends with a change of it.
BUCKETS = 2048
#: So many ids of a bucket, and its state is read in pages of some hundred rows.
MANY_IDS = 100


class BacklogCounter(StatefulProcessor):
    """What is pending per id, as a row of state for each id that is behind; ids come by buckets.

    Python is called once per bucket, and state is asked for an id at a time only where a
    commit touches few ids of a bucket: a call of its own, or a question, costs more than the sum.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getMapState("pending", f"{ID_FIELD} string", "pending bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        changes: Counter[str | None] = Counter()
        for part in rows:
            for name, change in zip(part[ID_FIELD].tolist(), part["change"].tolist(), strict=True):
                changes[name] += change
        changed = {name: change for name, change in changes.items() if change}
        before = self._before(changed)
        now = {name: before.get(name, 0) + change for name, change in changed.items()}
        for name, pending in now.items():
            if pending:
                self.pending.updateValue((name,), (pending,))
            else:
                self.pending.removeKey((name,))
        if now:
            yield pd.DataFrame({ID_FIELD: list(now), "pending": list(now.values())})

    def _before(self, names: Collection[str | None]) -> dict[str | None, int]:
        """What was pending, of these ids at least: all of the bucket, unless that is more than they are."""
        found, more = {}, True
        if len(names) >= MANY_IDS:
            stored = self.pending.iterator()
            found = {name: pending for (name,), (pending,) in islice(stored, len(names))}
            more = next(stored, None) is not None
        if more:
            for name in names:
                if name not in found and (state := self.pending.getValue((name,))):
                    found[name] = state[0]
        return found


def backlog_changes(raw: DataFrame, scored: DataFrame) -> DataFrame:
    """Ids whose backlog changed in a commit and what it is now, of a stream of messages on either side.

    A raw message adds one to its id, a scored one takes one away, in whichever order they
    come; an id at zero is reported once, as zero, and its state is dropped, so the state
    holds the ids that are behind and no others. Messages are summed per batch of their
    task before they are shuffled: an id that a third of them share is a few rows. Ids are
    text, as ``message_ids`` gives them; those that are null are one id.
    """
    arrived = message_ids(raw).select(ID_FIELD, F.lit(1).cast("bigint").alias("change"))
    done = message_ids(scored).select(ID_FIELD, F.lit(-1).cast("bigint").alias("change"))
    schema = f"{ID_FIELD} string, change bigint"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by(ID_FIELD).aggregate([("change", "sum")])
            sums = sums.select([ID_FIELD, "change_sum"]).rename_columns([ID_FIELD, "change"])
            yield from sums.filter(pc.not_equal(sums["change"], 0)).to_batches()

    changes = arrived.unionAll(done).mapInArrow(summed, schema)
    by_bucket = changes.withColumn("bucket", F.pmod(F.xxhash64(ID_FIELD), F.lit(BUCKETS))).groupBy("bucket")
    return by_bucket.transformWithStateInPandas(BacklogCounter(), _STATE, "append", "none")


def create_backlog_table(spark: SparkSession, table: str) -> None:
    create_snapshot_table(spark, table, spark.createDataFrame([], _STATE).schema)


def watch_backlog(
    spark: SparkSession,
    raw: Topic,
    scored: Topic,
    table: str,
    checkpoint: str,
    *,
    per_trigger: int | None = None,
    interval: str | None = COMMIT_INTERVAL,
) -> StreamingQuery:
    """The changes of each commit into a table; both topics are read once, whatever their length."""
    changes = backlog_changes(raw.read_stream(spark, per_trigger), scored.read_stream(spark, per_trigger))
    # One commit and the end: its stores need not stay, each with some MB of files, for a next one.
    single = interval is None and per_trigger is None
    with _state_of_many_rows(spark, unload=single):
        return insert_stream(changes, table, checkpoint, interval)


@contextmanager
def _state_of_many_rows(spark: SparkSession, unload: bool) -> Iterator[None]:
    """Streams that start meanwhile keep state with several rows per key, which Spark has one store for."""
    settings = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if unload:
        settings["unloadOnCommit"] = "true"
    settings = {f"spark.sql.streaming.stateStore.{name}": value for name, value in settings.items()}
    own = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in own.items():
            spark.conf.set(name, value)


def backlog_now(spark: SparkSession, table: str, snapshot_id: int | None = None) -> DataFrame:
    """Ids that are behind after a commit, the last one if left out, and by how much.

    Less than zero where more verdicts than messages were seen. The last change of each id
    is its backlog; changes are as many as the commits touched ids, and summed per task.
    """
    changes = read_as_of(spark, table, (1 << 62) if snapshot_id is None else snapshot_id)
    return changes.groupBy(ID_FIELD).agg(F.max_by("pending", "snapshot_id").alias("pending")).where("pending <> 0")
