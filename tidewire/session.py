"""The Spark session that the engine expects: UTC, ANSI, adaptive execution."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tidewire", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers that start from now on import this package from where the driver has it.

    A cluster that doesn't share that folder gets the package by ``addPyFile`` or as an installed one.
    """
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *paths])


#: Folders made for applications whose session names none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``.

    In local mode alone a temporary folder stands in where that is unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="tidewire-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = f"file://{folder}"
    return _own[app]


class _Made(threading.local):
    """Scratch tables of a thread (a stream's batches have one of their own), by open ``scratch_removed``."""

    def __init__(self):
        self.lists: list[list[str]] = []


_made = _Made()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    for made in _made.lists:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def materialize_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``materialize(make(), label)``, after which the scratch tables that ``make`` made on its way are removed."""
    _made.lists.append([])
    try:
        df = make()
    finally:
        inner = _made.lists.pop()
    out = materialize(df, label)
    for path in inner:
        remove(spark, path)
    return out


@contextmanager
def scratch_removed(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made within are removed at the end; nothing that reads them may be left."""
    _made.lists.append([])
    try:
        yield
    finally:
        for path in _made.lists.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's own file systems, wherever it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
