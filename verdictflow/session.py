"""Session and scratch storage."""

from __future__ import annotations

import atexit
import functools
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "verdictflow") -> SparkSession:
    """A one-machine session for tests and bench runs; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.speculation", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared storage the cluster names, in one of the application's own.

    The application's folder is deleted when its driver ends; that of one that was killed
    stays, under its application id.

    Every executor must be able to read it back after another one is lost, so
    only a local session without the setting falls back to the machine's own
    temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        base = _own_folder()
    application = f"{base.rstrip('/')}/verdictflow/{spark.sparkContext.applicationId}"
    if application not in _scratch:
        _scratch.add(application)
        atexit.register(_clear, spark, application)
    return f"{application}/{name}-{uuid.uuid4().hex}"


_scratch: set[str] = set()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="verdictflow-")


def _clear(spark: SparkSession, folder: str) -> None:
    """Delete an application's scratch folder at its end, if its context still runs."""
    if spark.sparkContext._jsc is not None:
        delete_folder(spark, folder)


class CommitNames:
    """Names for the micro-batches of a stream that no other stream's batches have.

    They carry the id Spark gave the stream when it made the checkpoint, not the
    checkpoint's path: a new checkpoint at an old path is a new stream.
    """

    def __init__(self, checkpoint: str):
        self.checkpoint, self.id = checkpoint, None

    def of(self, spark: SparkSession, batch_id: int) -> str:
        if self.id is None:
            self.id = json.loads(spark.read.text(f"{self.checkpoint}/metadata").first().value)["id"]
        return f"{self.id}-{batch_id}"


def _hadoop(spark: SparkSession, path: str):
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), file


def file_exists(spark: SparkSession, path: str) -> bool:
    files, file = _hadoop(spark, path)
    return files.exists(file)


def make_folder(spark: SparkSession, path: str) -> None:
    files, file = _hadoop(spark, path)
    files.mkdirs(file)


def delete_folder(spark: SparkSession, path: str) -> None:
    files, file = _hadoop(spark, path)
    files.delete(file, True)


def move_folder(spark: SparkSession, path: str, to: str) -> None:
    files, file = _hadoop(spark, path)
    goal = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    files.mkdirs(goal.getParent())
    if not files.rename(file, goal):
        raise OSError(f"{path} cannot be moved to {to}")


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a glob pattern, hidden files too."""
    files, file = _hadoop(spark, pattern)
    return [str(found.getPath().toString()) for found in files.globStatus(file) or ()]
