"""A task or job that is lost halfway asks for the rest only."""

import json
import os
import sys
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.cloudpickle import register_pickle_by_value

from verdictflow.operators import answers
from verdictflow.operators.answers import ROW, AnswerLog, forget, score_once
from verdictflow.operators.messages import read_scored
from verdictflow.operators.scorers import Scorer
from verdictflow.sources.topics import FileTopic
from verdictflow.streaming.steps import score_stream

register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests


class Mortal(Scorer):
    """Notes every question, and kills its worker at one of them while a file says so."""

    def __init__(self, folder, fatal=None):
        self.folder, self.fatal = str(folder), fatal

    def answer(self, profile, timeout_s):
        number = json.loads(profile)["id_cliente"]
        with open(f"{self.folder}/asked", "a") as f:
            f.write(f"{number}\n")
        if number == self.fatal and os.path.exists(f"{self.folder}/fatal"):
            os._exit(1)
        return json.dumps({"response": json.dumps({"predicao": 1, "justificativa": f"n{number}"})})


def asked(folder):
    with open(folder / "asked") as f:
        return Counter(map(int, f.read().split()))


def requests(spark, numbers, partitions=1):
    rows = [(n, 1, json.dumps({"id_cliente": n})) for n in numbers]
    return spark.createDataFrame(rows, "id_cliente long, target_real int, perfil string").coalesce(partitions)


def found(judged):
    return Counter((r.id_cliente, r.predicao, r.justificativa, r.modelo) for r in judged.collect())


def wanted(numbers):
    return Counter((n, 1, f"n{n}", "m") for n in numbers)


@pytest.fixture
def mortal(tmp_path):
    (tmp_path / "fatal").touch()
    return Mortal(tmp_path, fatal=60)


@pytest.mark.parametrize("flush_rows, again", [(1, 1), (25, 11)])
def test_a_task_killed_halfway_asks_only_the_rest(spark, tmp_path, mortal, flush_rows, again):
    numbers, folder = [*range(100), 7, 7], str(tmp_path / "work")
    ask = lambda: score_once(spark, requests(spark, numbers), mortal, folder, flush_rows=flush_rows, model_name="m")
    with pytest.raises(Exception, match="exited unexpectedly"):
        ask()
    assert sum(asked(tmp_path).values()) == 61
    (tmp_path / "fatal").unlink()
    assert found(ask()) == wanted(numbers)
    # Once each, but for the one under way and the answers not yet kept.
    assert sum(asked(tmp_path).values()) == len(numbers) + again
    assert found(ask()) == wanted(numbers) and sum(asked(tmp_path).values()) == len(numbers) + again
    forget(spark, folder)
    assert not os.path.exists(folder)


def test_the_work_is_that_of_the_first_call(spark, tmp_path):
    scorer, folder = Mortal(tmp_path), str(tmp_path / "work")
    assert found(score_once(spark, requests(spark, range(5)), scorer, folder, model_name="m")) == wanted(range(5))
    assert found(score_once(spark, requests(spark, range(9)), scorer, f"file://{folder}", model_name="m")) == wanted(range(5))
    assert asked(tmp_path) == Counter(range(5))


def test_nothing_to_ask(spark, tmp_path):
    assert score_once(spark, requests(spark, []), Mortal(tmp_path), str(tmp_path / "work")).collect() == []


def test_a_second_attempt_of_a_task_skips_what_the_first_kept(tmp_path, monkeypatch):
    log = AnswerLog(str(tmp_path / "a"), flush_rows=2)
    task = SimpleNamespace(partitionId=lambda: 3, attemptNumber=lambda: 0)
    monkeypatch.setattr(answers.TaskContext, "get", lambda: task)
    rows = pa.record_batch({ROW: pa.array(range(5), pa.int64())})
    kept = log.keep(log.left(iter([rows.slice(i, 1) for i in range(5)])))
    assert [next(kept).num_rows, next(kept).num_rows] == [2, 2]  # and lost before the fifth
    task.attemptNumber = lambda: 1
    assert [b.column(ROW).to_pylist() for b in log.left(iter([rows]))] == [[4]]
    task.partitionId = lambda: 30
    assert [b.num_rows for b in log.left(iter([rows]))] == [5]
    other = AnswerLog(str(tmp_path / "a"))
    assert len(other.kept_by(3)) == 0
    assert not [f for f in os.listdir(tmp_path / "a") if f.startswith("_")]


def test_a_commit_that_is_lost_asks_only_the_rest(spark, texts, tmp_path, mortal):
    raw, scored, aside = (FileTopic(str(tmp_path / n)) for n in ("raw", "scored", "aside"))
    raw.append(texts(*[json.dumps({"id_cliente": n, "target_real": 1}) for n in range(100)], "nope").coalesce(1))

    def step():
        query = score_stream(
            spark, raw, scored, mortal, str(tmp_path / "p"), interval=None, quarantine=aside, answers=str(tmp_path / "answers"), flush_rows=1
        )
        query.awaitTermination()

    with pytest.raises(Exception, match="exited unexpectedly"):
        step()
    (tmp_path / "fatal").unlink()
    step()
    assert sorted(r.id_cliente for r in read_scored(scored.read(spark)).collect()) == list(range(100))
    # All that was asked again: the one under way in the lost task, and those under way beside it.
    assert sum(asked(tmp_path).values()) <= 100 + 4 and asked(tmp_path)[60] == 2
    assert aside.read(spark).count() == 1 and os.listdir(tmp_path / "answers") == []
    with pytest.raises(ValueError):
        score_stream(spark, raw, scored, mortal, str(tmp_path / "q"), interval=None, answers="x")
