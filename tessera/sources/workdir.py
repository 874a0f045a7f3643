"""Shared scratch space: the folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch that goes to Python; Spark's 10,000 whole texts would be held several times over on both sides.
BATCH_ROWS = 1_000

_lock = threading.Lock()
_writers: dict[int, int] = {}  # sessions with writes under way
_settings: dict[int, dict[str, str | None]] = {}  # and their settings before
_live: dict[str, int] = {}  # paths made and not yet removed, in order, and the thread that made each


def shared_dir(spark: SparkSession) -> str:
    """Return the folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where neither that
    setting nor a checkpoint directory exists and Spark runs inside one machine
    (tests in local mode) is a local folder made and set; on a cluster that is
    an error, as executors would each write to their own disk.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """Return a fresh path below the shared folder; it counts as live until it is removed."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with _lock:
        _live[path] = threading.get_ident()
    return path


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """While any write of this session runs, drop shuffle files with their query and keep batches for Python small."""
    key = id(spark._jsparkSession)
    with _lock:
        _writers[key] = _writers.get(key, 0) + 1
        if _writers[key] == 1:
            _settings[key] = {name: spark.conf.get(name, None) for name in (CLEANUP, ARROW_ROWS)}
            spark.conf.set(CLEANUP, "true")
            rows = int(_settings[key][ARROW_ROWS] or 0)
            spark.conf.set(ARROW_ROWS, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))  # none or less: unlimited
    try:
        yield
    finally:
        with _lock:
            _writers[key] -= 1
            if not _writers[key]:
                for name, before in _settings.pop(key).items():
                    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str, path: str | None = None, drops: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the written table.

    Cuts the lineage; the files survive the loss of any executor, and the
    shuffle files of the write go as soon as it has ended. ``drops``: tables
    made by this function that nothing reads any more once this one is there.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with _cleaning(spark):
        df.write.parquet(path)
    for old in drops:
        removed(spark, old._scratch)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    with _lock:
        _live.pop(path, None)


@contextmanager
def swept(spark: SparkSession) -> Iterator[set]:
    """Remove on exit what this thread made below the shared folder since, but for tables added to the yielded set."""
    before, keep, me = set(_live), set(), threading.get_ident()
    yield keep
    kept = {df._scratch for df in keep}
    for path in [p for p, by in list(_live.items()) if by == me and p not in before and p not in kept]:
        removed(spark, path)


def cleared(spark: SparkSession) -> None:
    """Remove all scratch tables of this application; results not yet read are lost."""
    for path in list(_live):
        removed(spark, path)


def unused(df: DataFrame, name: str) -> str:
    """A column name starting with ``name`` that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
