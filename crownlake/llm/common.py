"""Shared helpers of the training-data operators: scratch tables and Arrow text buffers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step works on; a longer document is a step of its own.
STEP_BYTES = 512 << 10


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names in spark.checkpoint.dir.

    Where the setting is missing, a local master may use a temporary folder, which is set once; on a
    cluster executors would write to their own disks, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _folder.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _folder[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="crownlake-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    return path


#: The temporary folder of each local application that named none; scratch paths of open temporary() blocks.
_folder: dict[str, str] = {}
_open: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are made inside go at the end: what is needed of them must be written elsewhere by then."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Arrow batches between the JVM and Python hold at most so much, since texts may be long.
BATCH_BYTES, BATCH_ROWS = "8m", "4000"


def prepare(spark: SparkSession) -> None:
    """Set the session's Arrow batches to sizes that long texts need."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


#: What each kind of task keeps in its Python worker for later tasks, by the kind's name: how to let go of it.
_kept: dict[str, Callable[[], None]] = {}
_owner = [""]


def keeps(name: str, clear: Callable[[], None]) -> None:
    _kept[name] = clear


def claim(name: str) -> None:
    """Called by a task before it uses what it keeps: what other kinds of tasks left in this worker goes first.

    A worker's first task sets the C allocator so that large arrays go back to the system when freed.
    """
    if _owner[0] == name:
        return
    if not _owner[0]:
        _give_back()
    _owner[0] = name
    for other, clear in _kept.items():
        if other != name:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _give_back() -> None:
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # arrays above this size are mapped on their own, whatever was freed before
        libc.mallopt(-1, 8 << 20)  # free memory at the heap's end beyond this goes back at once
    except (OSError, AttributeError):
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(batch: pa.RecordBatch, column: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of text each."""
    n = batch.num_rows
    if not n:
        return
    _, off = utf8(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end, and n + 1 offsets into them; null is empty."""
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def arrow(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
