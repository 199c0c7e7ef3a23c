"""Folders that all executors share, partition counts and column names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own: list[str] = []
#: Whether Spark deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a temporary folder will do in local mode alone: executors
    of a cluster would each write to their own disk."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='millrace-')}")
        root = _own[0]
    return f"{root.rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage ends here, and a lost executor costs nothing. What was
    shuffled for them goes at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a ``written`` table once all that read it is written too."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while a column of df has that name."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def lean(spark: SparkSession, rows: int = 2000) -> None:
    """Hand Python workers ``rows`` rows a batch at most: texts are long, and several batches are in memory at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def tidied(made: Callable) -> Callable:
    """``made``, a generator function over batches, after whose end its Python worker gives free memory back: idle workers
    stay for a minute, beside those of the next stage."""

    def run(batches):
        try:
            yield from made(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run


def sent(spark: SparkSession, value):
    """A broadcast of ``value``, pickled with its class: executors need not have the package. ``received`` opens it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared):
    import pickle

    return pickle.loads(shared.value)


def chunk_pairs(node: str, chunks: str) -> Column:
    """Pairs of chunks that a row is in, an array: chunk i of n meets every chunk, itself included.

    Grouped by the pair, all rows of a group meet, and no task holds more than two chunks.
    """
    own = F.pmod(F.hash(node), F.col(chunks))
    return F.transform(F.sequence(F.lit(0), F.col(chunks) - 1), lambda j: F.least(own, j) * F.col(chunks) + F.greatest(own, j))
