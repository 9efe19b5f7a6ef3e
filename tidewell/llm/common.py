"""Shared plumbing of the corpus operators: reading, staging, batching."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to one Python step at a time, in bytes of UTF-8. It bounds a
#: worker's memory however many rows an Arrow batch holds; a single longer
#: text is still taken whole.
STEP_CHARS = 2_000_000
#: Input behind one file of a written table at least, where there are more files than tasks that can run.
FILE_BYTES = 16 << 20
#: Bytes of an Arrow batch, about: rows are as large as texts and blocks are.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for written stages: ``spark.checkpoint.dir``.

    Where it is unset, only a single-process master may fall back to a local
    temporary folder; on a cluster that would hide files from the executors.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="tidewell-")
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir()
    return at


#: Spark's setting for removing a query's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def compact(df: DataFrame, docs: DataFrame) -> DataFrame:
    """``df`` in no more partitions than twice the cores or, beyond those, one for ``FILE_BYTES`` of ``docs``.

    Without it a small table that went through many shuffle partitions is
    written as as many tiny files. No rows are moved.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, min(size // FILE_BYTES, 1 << 30)))


def staged(df: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, in files as for ``docs`` where given.

    This cuts the lineage with files that outlive any executor, and keeps
    columns prunable for the readers. Nothing reads the shuffle files behind a
    written stage again, so they go at once and not with the driver's garbage.
    """
    spark = df.sparkSession
    if docs is not None:
        df = compact(df, docs)
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Remove this application's written stages; gives how many there were.

    Results are lazy and read them, so store what is still wanted before.
    """
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith(("stage-", "pipeline-"))]
    return sum(bool(fs.delete(p, True)) for p in found)


def text_steps(batches: Iterator[pa.RecordBatch], step_chars: int = STEP_CHARS):
    """Cut Arrow batches of (id, text, ...) into pieces of bounded text.

    Yields ``(piece, texts)``; a null text comes as ''.
    """
    for batch in batches:
        column = batch.column("text")
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            held += size
            if held >= step_chars or i + 1 == len(sizes):
                yield batch.slice(begin, i + 1 - begin), [t or "" for t in column.slice(begin, i + 1 - begin).to_pylist()]
                begin, held = i + 1, 0


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with its session's Arrow batches held to ``BATCH_BYTES``."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


#: Caches that this worker process fills, each a function under ``lru_cache``.
_CACHES: list = []


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], cache=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step``; what a task no longer holds goes back to the system at its end, not with the idle worker.

    ``cache`` is what ``step`` keeps for the tasks after it; the caches of
    other operators, which ran in the same worker before, are emptied.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _only(cache)
        yield from step(batches)
        _give_back()

    return run


def _only(cache) -> None:
    """Empty all caches but ``cache``. A function of the module, so that it comes to workers by name and meets their own list."""
    others = [c for c in _CACHES if c is not cache]
    for other in others:
        other.cache_clear()
    if others:
        _give_back()
    _CACHES[:] = [] if cache is None else [cache]


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text, whatever else the input carries."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
