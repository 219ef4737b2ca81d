"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Output batches are closed once they hold this many bytes of variable-length data.
OUT_BYTES = 8 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only on one machine that names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lodestone-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle and checkpoint files of frames that nothing refers to any more.

    It does so when the driver collects its garbage, which a loop of small jobs gives it no reason to do.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Gives memory that a Python worker has freed back to the machine: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names made of ``names`` that don't clash with those taken (Spark ignores case)."""
    mark, low = "_", [c.lower() for c in taken]
    while any(c.startswith(mark) for c in low):
        mark += "_"
    return [mark + n for n in names]


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def plain(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by place: ``mapInArrow`` can't take names that hold a dot."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def sliced(batch: pa.RecordBatch, name: str, most: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose column ``name`` holds about ``most`` bytes each (one row at least)."""
    col = batch.column(batch.schema.get_field_index(name))
    if not len(col):
        return
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def map_slices(fn: Callable[[pa.RecordBatch], pa.RecordBatch], sized_by: str, most: int = OUT_BYTES):
    """A ``mapInArrow`` function that applies ``fn`` to slices of bounded size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, sized_by, most):
                yield fn(part)
        release()

    return run


def by_key(batches: Iterable[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_pylist()
        cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        if held and keys and held[-1].column(key)[held[-1].num_rows - 1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
