"""The scoring stage: one model call per profile, a bounded number in flight."""

from __future__ import annotations

import contextlib
import math
import threading
import time
import warnings
from collections.abc import Callable, Iterator
from queue import Empty, SimpleQueue
from typing import TYPE_CHECKING, NamedTuple

import pyarrow as pa
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictflow.fixed_values import MAX_IN_FLIGHT, OPERATOR_TIMEOUT_S, REQUEST_TIMEOUT_S
from verdictflow.operators.scorers import Scorer
from verdictflow.operators.verdict import verdict_columns

if TYPE_CHECKING:
    from verdictflow.operators.answers import AnswerLog

_FLUSH_ROWS = 1000
#: Rows of calls that wait for a thread.
_AHEAD_ROWS = 256
#: Time for a scorer to notice its own timeout before its call is cut off.
GRACE_S = 0.5
#: Calls under way are looked at so often, and a look counts for twice as long at most.
_LOOK_S = 0.05


def score(
    requests: DataFrame,
    scorer: Scorer,
    *,
    model_name: str | None = None,
    max_in_flight: int = MAX_IN_FLIGHT,
    partitions: int | None = None,
    request_timeout_s: float = REQUEST_TIMEOUT_S,
    operator_timeout_s: float = OPERATOR_TIMEOUT_S,
    call_ms: str | None = None,
    profile: ResourceProfile | None = None,
    answer_log: AnswerLog | None = None,
) -> DataFrame:
    """Judge the ``perfil`` of every row; the other columns are carried along.

    Rows leave in the order the calls end. Calls in flight are at most
    ``max_in_flight`` times the tasks running at once, so with ``partitions``
    given, at most ``max_in_flight * partitions``. Left out, rows stay in the
    partitions they are in and nothing is shuffled. Only the profile and the
    carried columns cross to Python: the scorer adds the prompt there.

    Tasks running at once are bounded for the whole job by ``profile``: one of
    ``call_slots`` gives each task of the stage, and of no other, so many cores.
    ``call_ms`` names a column for the time a row's call took. With an ``answer_log``, tasks
    keep their answers in it while they run, and ask for none that an earlier attempt kept.

    A call has ``request_timeout_s`` for each of its rows. Scorers give up by themselves;
    one that has not, ``GRACE_S`` later, is left alone and its rows count as timed out.
    A call that outlives ``operator_timeout_s`` fails the task. A task that is
    run again calls the model again, so keep speculation off and store the result
    before using it twice.
    """
    if requests.sparkSession.conf.get("spark.speculation", "false") == "true":
        warnings.warn("spark.speculation is on: slow model calls will be made twice", stacklevel=2)
    if partitions:
        requests = requests.repartition(partitions)
    carried = [f for f in requests.schema if f.name != "perfil"]
    timed = [T.StructField(call_ms, T.DoubleType())] if call_ms else []
    out = T.StructType(
        [*carried, T.StructField("predicao", T.IntegerType()), T.StructField("justificativa", T.StringType()), *timed]
    )

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ask(asked: _Call) -> tuple[list[str | Exception], float]:
            begin = time.perf_counter()
            try:
                replies = scorer.ask(asked.profiles, request_timeout_s)
            except Exception as error:
                replies = [error] * len(asked.profiles)
            return replies, 1000 * (time.perf_counter() - begin)

        def no_answer(asked: _Call) -> tuple[float, tuple[list[str | Exception], float]]:
            limit = request_timeout_s * len(asked.profiles) + GRACE_S
            return limit, ([TimeoutError()] * len(asked.profiles), 1000 * limit)

        calls = _calls(answer_log.left(batches) if answer_log else batches, scorer.batch_size)
        scorer.open()
        try:
            # Answers that are to be kept are kept before the next call begins.
            ahead = 0 if answer_log else _AHEAD_ROWS // scorer.batch_size
            done = as_they_end(calls, ask, max_in_flight, operator_timeout_s, no_answer, ahead)
            judged = _judged(done, answer_log.flush_rows if answer_log else _FLUSH_ROWS, call_ms)
            yield from _in_batches(answer_log.keep(judged)) if answer_log else judged
        finally:
            scorer.close()

    scored = requests.select(*[f.name for f in carried], "perfil").mapInArrow(stage, out, profile=profile)
    return scored.withColumn("modelo", F.lit(model_name).cast("string"))


def as_they_end[A, B](
    items: Iterator[A],
    call: Callable[[A], B],
    limit: int,
    timeout_s: float,
    cut_off: Callable[[A], tuple[float, B]] | None = None,
    ahead: int = 0,
) -> Iterator[tuple[A, B]]:
    """Call with each item, at most ``limit`` at once, and yield as calls end.

    A call that outlives ``timeout_s`` ends everything. Before that, ``cut_off`` may give
    the seconds an item's call has and the result it gets when they are over: the call is
    then left to itself, another thread takes its place, and what it returns is not used.
    ``ahead`` more items are taken before there is a thread for them, so that short calls
    need not wait for the caller between them; their time begins with their call.

    A call's time is that in which the caller looks for its end. A machine that stands
    still, or has no core left for the process, may keep the call from ending just as long:
    of such a gap, ``2 * _LOOK_S`` count. So does no more of a long stay with the consumer.
    """
    todo, ended = SimpleQueue(), SimpleQueue()
    taken: dict[int, tuple[A, float, B | None]] = {}
    # When each call under way began. Who takes a call out of it, decides its result.
    begun: dict[int, float] = {}
    threads = submitted = 0
    shortest, look = timeout_s, 0.0
    lost, seen = 0.0, time.monotonic()

    def clock() -> float:
        nonlocal lost, seen
        now = time.monotonic()
        lost += max(0.0, now - seen - 2 * _LOOK_S)
        seen = now
        return now - lost

    def work() -> None:
        while (task := todo.get()) is not None:
            n, item = task
            begun[n] = -lost + time.monotonic()  # in this order, as more may be lost in between
            try:
                result, error = call(item), None
            except BaseException as e:
                result, error = None, e
            if begun.pop(n, None) is None:
                return
            ended.put((n, result, error))

    def start() -> None:
        # Threads that the interpreter does not wait for, as a call may never end.
        threading.Thread(target=work, daemon=True).start()

    def late(now: float) -> Iterator[tuple[A, B]]:
        for n, began in begun.copy().items():
            seconds = taken[n][1]
            if began + min(seconds, timeout_s) <= now and begun.pop(n, None) is not None:
                if seconds >= timeout_s:
                    raise TimeoutError(f"a model call took longer than {timeout_s} s")
                item, _, instead = taken.pop(n)
                start()
                yield item, instead

    def some() -> Iterator[tuple[A, B]]:
        nonlocal look
        now = clock()
        if now >= look:
            yield from late(now)
            # A call that has not begun has its time from then on.
            due = [began + min(taken[n][1], timeout_s) for n, began in begun.copy().items()]
            look = min([now + shortest, *due])
            return
        try:
            n, result, error = ended.get(timeout=min(look - now, _LOOK_S))
        except Empty:
            return
        item = taken.pop(n)[0]
        if error is not None:
            raise error
        yield item, result

    try:
        for item in items:
            while len(taken) == limit + ahead:
                yield from some()
            seconds, instead = cut_off(item) if cut_off else (math.inf, None)
            shortest = min(shortest, seconds)
            taken[submitted] = item, seconds, instead
            todo.put((submitted, item))
            submitted += 1
            if threads < limit:
                threads += 1
                start()
        while taken:
            yield from some()
    finally:
        while not todo.empty():  # what was taken ahead is not asked any more
            with contextlib.suppress(Empty):
                todo.get_nowait()
        for _ in range(threads):
            todo.put(None)


def call_slots(executor_cores: int, per_executor: int) -> ResourceProfile:
    """A profile under which an executor runs at most ``per_executor`` tasks of the model stage at once.

    With ``max_in_flight`` calls a task, a job makes at most executors x ``per_executor`` x
    ``max_in_flight`` calls at once, whatever else runs. Needs a cluster that schedules by
    profile (standalone, YARN or Kubernetes); a local session refuses it.
    """
    if not 0 < per_executor <= executor_cores:
        raise ValueError(f"{per_executor} tasks do not go into {executor_cores} cores")
    cores = executor_cores // (per_executor + 1) + 1  # the fewest with which not one more fits
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores)).build


class _Call(NamedTuple):
    """Profiles asked together, and the carried columns of the batch that they are in, from ``first`` on."""

    rows: pa.RecordBatch
    first: int
    profiles: list[str | None]


def _calls(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[_Call]:
    for batch in batches:
        rows, profiles = batch.drop_columns(["perfil"]), batch.column("perfil").to_pylist()
        for first in range(0, len(profiles), size):
            yield _Call(rows, first, profiles[first : first + size])


def _judged(done: Iterator[tuple[_Call, tuple[list[str | Exception], float]]], at_once: int, call_ms: str | None) -> Iterator[pa.RecordBatch]:
    """Verdicts in the order the calls ended, ``at_once`` rows or a few more in a batch, so that a call need not be an Arrow message."""
    places: list[int] = []
    judged: list[str | Exception] = []
    times: list[float] = []
    rows = None

    def batch() -> pa.RecordBatch:
        timed = [pa.array(times, pa.float64())] if call_ms else []
        names = [*rows.schema.names, "predicao", "justificativa", *([call_ms] if call_ms else [])]
        at = pa.array(places, pa.int64())
        return pa.RecordBatch.from_arrays([*[c.take(at) for c in rows.columns], *verdict_columns(judged), *timed], names)

    held: list[pa.RecordBatch] = []
    waiting = 0
    for asked, (replies, took) in done:
        if len(replies) != len(asked.profiles):
            raise ValueError(f"{len(replies)} replies to {len(asked.profiles)} profiles")
        if places and asked.rows is not rows:
            held.append(batch())
            places, judged, times = [], [], []
        rows = asked.rows
        places += range(asked.first, asked.first + len(replies))
        judged += replies
        times += [took] * len(replies)
        waiting += len(replies)
        if waiting >= at_once:
            yield pa.concat_batches([*held, batch()])
            held, waiting = [], 0
            places, judged, times = [], [], []
    if waiting:
        yield pa.concat_batches([*held, batch()])


def _in_batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join small results, so that one call need not be one Arrow message."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for part in parts:
        held.append(part)
        rows += part.num_rows
        if rows >= _FLUSH_ROWS:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if held:
        yield pa.concat_batches(held)
