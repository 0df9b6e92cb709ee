"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_spools: dict[str, SparkSession] = {}
_makers: dict[str, int] = {}
_own_folders: list[str] = []


def get_spark(app: str = "slipstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Where none is configured a temporary one serves a local master only: on a cluster every
    executor would write to a disk of its own, so that is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="slipstone-")
        _own_folders.append(current)
        spark.sparkContext.setCheckpointDir(current)
    return current.rstrip("/")


def spool_path(spark: SparkSession, kind: str = "spool") -> str:
    """A new path in the shared folder, owned by the session until ``drop_spools``."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _spools[path] = spark
    _makers[path] = threading.get_ident()
    return path


def spool(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage so that later passes reread a narrow columnar table instead of recomputing,
    survives lost executors, and gives the optimizer real sizes for its join choices. The
    table lives until ``drop_spools`` or the end of the process. What was shuffled to make it is
    deleted as soon as it is written.
    """
    spark = df.sparkSession
    path = spool_path(spark)
    with _shuffles_deleted(spark):
        df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spool_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """``spool(make())``; the spools that this thread made for it are deleted once it is written."""
    before, own = set(_spools), threading.get_ident()
    df = make()
    inside = [p for p in _spools if p not in before and _makers.get(p) == own]
    stored = spool(df)
    for path in inside:
        release(df.sparkSession, path)
    return stored


#: writes under way in this process, by session; the setting belongs to the session, not to a thread
_writing: dict[int, list] = {}
_lock = threading.Lock()


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside are deleted when each of them ends.

    Spark alone leaves them until its driver collects garbage, so the shuffles of all steps of a
    query lie on the disks together.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _lock:
        held = _writing.setdefault(id(spark), [0, None])
        if not held[0]:
            held[1] = spark.conf.get(key, None)
            spark.conf.set(key, "true")
        held[0] += 1
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                if held[1] is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, held[1])


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def release(spark: SparkSession, path: str) -> None:
    """Delete one spool that no later step reads."""
    _remove(spark, path)
    _spools.pop(path, None)
    _makers.pop(path, None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the spools that this thread made inside; for streams, which never end."""
    before, own = set(_spools), threading.get_ident()
    try:
        yield
    finally:
        for path in [p for p in _spools if p not in before and _makers.get(p) == own]:
            release(spark, path)


def drop_spools(spark: SparkSession) -> int:
    """Delete every spool of the process; call it once a query's result has been written."""
    gone = list(_spools)
    for path in gone:
        release(spark, path)
    return len(gone)


def _at_exit() -> None:
    for path, spark in list(_spools.items()):
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone already; the cluster's own cleaning is left
            break
    for folder in _own_folders:
        shutil.rmtree(folder, ignore_errors=True)


atexit.register(_at_exit)
