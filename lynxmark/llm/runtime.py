"""Shared folder, staging tables and Arrow batch helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python operator holds at once.
STEP_BYTES = 8 << 20
#: Frees an action's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of text that one partition of a shuffle is to hold, and the most partitions that are asked for.
PART_BYTES, MOST_PARTS = 64 << 20, 200_000
_lock, _depth, _before = threading.Lock(), 0, "false"
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none and the master is local (tests on one machine)
    a temporary folder is made and set, so that later calls find the same one.
    On a cluster each executor would write to a disk of its own: refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.lynxmark.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lynxmark-")
        spark.conf.set("spark.lynxmark.shared.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes with the enclosing ``temporary`` scope, else when the driver ends."""
    path = f"{shared_dir(spark)}/lynxmark/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    for held in getattr(_scopes, "held", [])[-1:]:
        held.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession):
    """Deletes, at its end, what ``stage`` and ``shared_path`` made inside it.

    Its results must have been written elsewhere by then.
    """
    _scopes.held = [*getattr(_scopes, "held", []), []]
    try:
        yield
    finally:
        for path in _scopes.held.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def _freed(spark: SparkSession):
    """Shuffle files of an action go when it ends; actions of several threads may overlap."""
    global _depth, _before
    with _lock:
        if not _depth:
            _before = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _depth += 1
    try:
        yield
    finally:
        with _lock:
            _depth -= 1
            if not _depth:
                spark.conf.set(CLEANUP, _before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table of the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the tasks it ran.
    The exchanges of the write have served once it is done; their files go then,
    not when the driver next collects garbage.
    """
    path = shared_path(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write(df: DataFrame, path: str) -> None:
    with _freed(df.sparkSession):
        df.write.parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, so that no column of ``df`` has it."""
    taken = {n.lower() for n in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def heavy(rows: DataFrame, name: str, share: int = 1000) -> list:
    """The values of column ``name`` that more than one in ``share`` rows hold: fewer than ``share`` values, whatever the table holds."""
    n = rows.count()
    return [r[0] for r in rows.groupBy(name).agg(F.count("*").alias("n")).where(F.col("n") > max(1, n // share)).limit(share).collect()] if n > share else []


def once_if_heavy(rows: DataFrame, name: str, values: list) -> DataFrame:
    """``rows`` with those that hold one of ``values`` made one for each value before anything moves; they must be alike."""
    if not values:
        return rows
    many = F.col(name).isin(values)
    return rows.where(~many).union(rows.where(many).dropDuplicates([name]))


def parts_for(spark: SparkSession, size: int | None) -> int:
    """Partitions for ``size`` bytes of text: at most ``PART_BYTES`` in each, and work for every core."""
    return min(MOST_PARTS, max(2 * parallelism(spark), -(-(size or 0) // PART_BYTES)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each; one longer text stays whole."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, whose worker gives what it freed back to the system at the end of a task.

    Workers serve many tasks and wait between them beside the JVM's heap; the
    allocators would keep the pages of their largest step all that time.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def text_bytes(column: pa.Array) -> tuple[bytes, list[int]]:
    """The UTF-8 bytes of all texts, joined, and the offsets of each; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = data.to_pybytes()[off[0] : off[-1]] if data is not None else b""
    return raw, (off - off[0]).tolist()


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def utf8_size(column: str = "text"):
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")
