"""Session helpers: local test session and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def local_session(cores: str = "8", app: str = "gridreach") -> SparkSession:
    """Session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; fall back only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder, inside the current scope if there is one."""
    ensure_checkpoint_dir(spark)
    return f"{_scope.get() or spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables that `cut` and `scratch` write inside the block are removed when it ends; read what depends on them before."""
    path = scratch(spark, "scope")
    token = _scope.set(path)
    try:
        yield
    finally:
        _scope.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The table build() returns, written once; the tables that build() cut on its way are removed."""
    path = scratch(spark, "kept")
    with scratch_scope(spark):
        df = build()
        df.write.parquet(path)
        schema = df.schema
    return spark.read.schema(schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and go on from the files.

    The table survives lost executors, the plan behind it is gone, and unlike a
    checkpointed RDD its files give Catalyst true sizes: small results get
    broadcast by the optimizer's own size check, and size estimates do not
    multiply from round to round of a loop.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold BATCH_BYTES, not 10,000 rows whatever their length.

    A batch of 10,000 texts lies in the executor's memory outside the heap and again in its Python worker, for each task at once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def narrow_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of jobs run inside the block end by rows alone, for rows of a few numbers.

    Otherwise Spark adds up the bytes of a batch anew for each row, which takes longer than the row's way to its Python worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str((1 << 31) - 1))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Rows of a few numbers that may be broadcast: some ten megabytes.
SMALL = 1_000_000


def small_side(df: DataFrame) -> DataFrame:
    """A narrow table as one side of a join: written and counted, then broadcast up to SMALL rows and shuffled beyond."""
    table = cut(df)
    return F.broadcast(table) if table.count() <= SMALL else table


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
