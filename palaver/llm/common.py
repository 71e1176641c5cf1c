"""What the training-data operators share: reading tables and writing intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; with whole texts in them, Spark's own 10,000 could fill a worker.
BATCH_ROWS = 512
#: Bytes of an Arrow batch, about.
BATCH_BYTES = 2**25
#: Bytes of files up to which a table of few files is dealt out anew.
SMALL_BYTES = 2**30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by any path that Spark can read.

    Spark cannot split a row group among tasks, and a small table of fewer files than there are
    cores may be a single one. Its rows are dealt out; other tables are read as they lie.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL_BYTES and len(df.inputFiles()) < cores else df


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; lower settings of the session stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only where it is unset and Spark runs on this machine alone, as in tests, a temporary folder is
    made and kept in the session's settings. A cluster without the setting is an error: its
    executors share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("palaver.scratch", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset; with master {master} it has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="palaver-")
        spark.conf.set("palaver.scratch", root)
    return root.rstrip("/")


#: Paths stored within the open scratch scopes of this thread, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
#: Spark deletes the shuffle files of a query at its end.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted at the end of the scratch scope around."""
    path = f"{scratch_root(spark)}/palaver/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if scopes := _SCOPES.get():
        scopes[-1].append(path)
    else:  # what no scope deletes goes when the driver ends
        atexit.register(_deleted_quietly, spark, path)
    return path


def _deleted_quietly(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may be over
        delete(spark, path)


#: How many writes of each session have Spark delete shuffle files now, and what was set before.
_CLEANING: dict[int, tuple[int, str]] = {}
_LOCK = threading.Lock()


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Have Spark delete the shuffle files of queries that end within, also when threads overlap."""
    with _LOCK:
        n, before = _CLEANING.get(id(spark), (0, spark.conf.get(_CLEAN_UP, "false")))
        _CLEANING[id(spark)] = n + 1, before
        spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _CLEANING.pop(id(spark))
            if n > 1:
                _CLEANING[id(spark)] = n - 1, before
            else:
                spark.conf.set(_CLEAN_UP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back, which cuts its lineage.

    The shuffle files behind it are deleted once it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Delete intermediate tables that no later step reads."""
    for df in tables:
        delete(df.sparkSession, df._scratch_path)
        for scope in _SCOPES.get():
            if df._scratch_path in scope:
                scope.remove(df._scratch_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope at whose end, also after a failure, all that this thread stored within it is deleted.

    What an operator returns may read such tables: write or collect it within the scope, or hand
    its tables to the scope around by kept().
    """
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in own:
            delete(spark, path)


def kept(df: DataFrame) -> DataFrame:
    """Hand a stored table to the scope around the innermost, or to nobody where there is none."""
    scopes = _SCOPES.get()
    if scopes and df._scratch_path in scopes[-1]:
        scopes[-1].remove(df._scratch_path)
        if len(scopes) > 1:
            scopes[-2].append(df._scratch_path)
        else:
            atexit.register(_deleted_quietly, df.sparkSession, df._scratch_path)
    return df


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(n))
