"""What the operators share: the shared folder, written tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes in one Arrow batch sent to Python: both bound a worker's memory when texts are long.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the cluster names none (tests, local mode) a local one is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="tempolog-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_PATHS: list[str] = []
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    if (held := _SCRATCH.get()) is not None:
        held.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _PATHS:
        _PATHS.remove(path)


def forget(spark: SparkSession) -> int:
    """Deletes what the operators of this driver have put in the shared folder; returns how many tables and folders.

    Results are read from there, so call it only once they are saved elsewhere.
    """
    paths = list(_PATHS)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def release(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_shared_path", None):
            _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at its end, the tables made inside it but those given to the function that it yields."""
    kept: set[str] = set()
    token = _SCRATCH.set([])

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._shared_path)
        return df

    try:
        yield keep
    finally:
        made = _SCRATCH.get() or []
        _SCRATCH.reset(token)
        for path in made:
            if path not in kept and path in _PATHS:
                _delete(spark, path)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a written table: cuts lineage, survives lost executors, computed once; ``by``: in a folder for each value of that column."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def bound_batches(spark: SparkSession) -> None:
    """Let no Arrow batch hold more than :data:`BATCH_ROWS` rows, nor many more than :data:`BATCH_BYTES` bytes.

    Results are lazy, so the session keeps these settings; smaller ones of the caller stay as they are.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``fn`` on every Arrow batch; it returns a batch of ``schema`` or None."""
    bound_batches(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(each, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null counts as empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
