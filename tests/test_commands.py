import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from verdictflow import __main__ as commands
from verdictflow.plans.steps import inspect, inspect_arrow
from verdictflow.session import scratch_path
from verdictflow.sources.tables import read_table
from verdictflow.sources.topics import FileTopic, KafkaTopic

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LINES = [
    "A13 12 A31 A46 1500 A65 A75 4 A93 A101 4 A121 67 A143 A152 2 A173 1 A192 A201 1",
    "A11 48 A33 A40 9500 A61 A73 2 A92 A101 2 A121 22 A143 A152 1 A173 1 A191 A201 2",
    "A14 12 A30 A48 5951 A61 A73 2 A92 A101 2 A121 22 A143 A152 1 A173 1 A191 A201 2",
]


def test_topics():
    assert commands.topic("/data/raw") == FileTopic("/data/raw")
    assert commands.topic("kafka://b1:9092,b2:9092/raw") == KafkaTopic("b1:9092,b2:9092", "raw")


def test_four_steps(spark, tmp_path, capsys):
    file, raw, scored = (str(tmp_path / n) for n in ("file", "raw", "scored"))
    with open(file, "w") as lines:
        lines.write("\n".join(LINES) + "\n")
    warehouse = scratch_path(spark, "warehouse")
    table = f"db_{warehouse[-32:]}.credit_scored"
    commands.main(["replay", "--file", file, "--raw", raw])
    assert "sent 3 messages" in capsys.readouterr().out
    score = ["score", "--raw", raw, "--scored", scored, "--checkpoint", str(tmp_path / "p1"), "--once", "--scorer", "rubric"]
    land = ["land", "--scored", scored, "--table", table, "--warehouse", warehouse, "--checkpoint", str(tmp_path / "p2"), "--once"]
    for _ in range(2):
        commands.main(score)
        commands.main(land)
    said = capsys.readouterr().out
    assert said.count("score commit") == 1 and "3 rows, 1 fallbacks" in said
    assert {r.modelo for r in spark.read.json(f"{scored}/*").collect()} == {"rubric"}
    commands.main(["lag", "--topic", raw, "--checkpoint", str(tmp_path / "p1")])
    assert "|    0|    0|" in capsys.readouterr().out
    assert [(r.id_cliente, r.target_real, r.predicao) for r in read_table(spark, table).orderBy("id_cliente").collect()] == [
        (0, 1, 1),
        (1, 2, 2),
        (2, 2, 0),
    ]
    commands.main(["inspect", "--table", table, "--warehouse", warehouse, "--rows", "2"])
    shown = capsys.readouterr().out
    assert "Risco alto: 7 de 7 pontos." in shown and "predicao_invalida" not in shown
    assert list(inspect(spark, table).predicao) == [1, 2, 0]
    where = ["--table", table, "--warehouse", warehouse]
    commands.main(["report", *where])
    assert "0.666667" in capsys.readouterr().out
    commands.main(["replay", "--file", file, "--raw", raw])
    commands.main(["pending", "--raw", raw, "--scored", scored])
    assert "|      3|" in capsys.readouterr().out
    commands.main(score)
    commands.main(land)
    assert read_table(spark, table).count() == 6
    commands.main(["inspect", *where, "--as-of", "0"])
    assert capsys.readouterr().out.count("Risco") == 2
    commands.main(["compact", *where, "--keep", "1"])
    assert "joined 0 commits" in capsys.readouterr().out
    commands.main(["compact", *where, "--keep", "0", "--catalog", "spark_catalog"])
    assert "joined 2 commits" in capsys.readouterr().out and read_table(spark, table).count() == 6
    commands.main(["rollback", *where, "--to", "-1"])
    assert read_table(spark, table).count() == 0
    commands.main(["land", *land[1:-1], "--once"])
    commands.main(["land", "--scored", scored, *where, "--checkpoint", str(tmp_path / "p3"), "--per-trigger", "1", "--once"])
    assert read_table(spark, table).count() == 6
    commands.main(["rollback", *where, "--to", "0"])
    assert read_table(spark, table).count() == 3
    assert inspect_arrow(spark, table, rows=1).num_rows == 1


def test_replay_of_a_missing_file(spark, tmp_path, capsys):
    commands.main(["replay", "--file", str(tmp_path / "none"), "--raw", str(tmp_path / "raw")])
    assert not os.path.exists(tmp_path / "raw")
    assert "no file at" in capsys.readouterr().out


def session(master, **settings):
    conf = SimpleNamespace(get=lambda name, default: settings.get(name.replace(".", "_"), default))
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app-1", _jsc=None))


def test_scratch_folder_is_the_one_the_session_names():
    named = session("spark://host", spark_checkpoint_dir="/shared/folder/")
    assert scratch_path(named, "x").startswith("/shared/folder/verdictflow/app-1/x-")
    assert scratch_path(named, "x") != scratch_path(named, "x")


def test_scratch_folder_goes_with_the_driver(tmp_path):
    script = (
        "from verdictflow.session import local_session, scratch_path\n"
        "spark = local_session(1); spark.range(3).write.parquet(scratch_path(spark, 'x'))\n"
        "import os; print(os.listdir(spark.conf.get('spark.checkpoint.dir') + '/verdictflow'))"
    )
    submit = f"--conf spark.checkpoint.dir={tmp_path} pyspark-shell"
    run = subprocess.run([sys.executable, "-c", script], cwd=ROOT, env=os.environ | {"PYSPARK_SUBMIT_ARGS": submit}, capture_output=True, text=True, timeout=120)
    assert "local-" in run.stdout and os.listdir(tmp_path / "verdictflow") == []


def test_a_cluster_without_a_shared_folder_is_refused():
    assert "/verdictflow/app-1/x-" in scratch_path(session("local[2]"), "x")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(session("spark://host"), "x")


def test_pace(spark, texts, tmp_path):
    staged, raw = (str(tmp_path / n) for n in ("staged", "raw"))
    FileTopic(staged).append(texts("a", "b", "c").coalesce(1), rows_per_file=1)
    commands.main(["pace", "--staged", staged, "--raw", raw, "--checkpoint", str(tmp_path / "p"), "--once"])
    assert FileTopic(raw).read(spark).count() == 3 and len(os.listdir(raw)) == 3


@pytest.mark.parametrize("who", [[], ["--url", "http://x/"], ["--scorer", "rubric", "--model", "m"], ["--model", "m"]])
def test_the_scorer_is_named_and_the_rubric_takes_no_other_name(who):
    with pytest.raises(SystemExit):
        commands.main(["score", "--raw", "/a", "--scored", "/b", "--checkpoint", "/c", *who])


def test_group_and_catalog_reach_their_places(monkeypatch):
    seen = {}
    monkeypatch.setattr(commands, "score_stream", lambda spark, raw, scored, *given, **more: seen.update(raw=raw, scored=scored, **more))
    monkeypatch.setattr(commands.CommitCounts, "wait_for", lambda self, query: None)
    commands.main(["score", "--raw", "kafka://b/raw", "--scored", "/s", "--checkpoint", "/c", "--group", "g", "--url", "http://x/", "--model", "m"])
    assert seen["raw"] == KafkaTopic("b", "raw", "g") and seen["scored"] == FileTopic("/s") and seen["model_name"] == "m"
    calls = []
    for name in ("register_catalog", "use_catalog"):
        monkeypatch.setattr(commands, name, lambda spark, *given, name=name, **options: calls.append((name, *given, options)))
    commands.choose_catalog(None, "lake=org.example.Catalog", ["warehouse=/a=b"])
    commands.choose_catalog(None, "lake", [])
    assert calls == [("register_catalog", "lake", "org.example.Catalog", {"warehouse": "/a=b"}), ("use_catalog", "lake", {}), ("use_catalog", "lake", {})]


def test_unknown_step():
    with pytest.raises(SystemExit):
        commands.main(["nothing"])
