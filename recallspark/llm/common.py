"""What the operators share: shared folders, tables, Arrow helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and estimated bytes, below which a side may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20
#: Bytes of text that a Python worker turns into arrays at once, and rows at most.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 4000
#: Bytes of an Arrow batch between the JVM and Python workers.
ARROW_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (`spark.checkpoint.dir`).

    Only where the session names none (local tests) a folder of this machine is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = found or tempfile.mkdtemp(prefix="recallspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


_TEMPORARY: ContextVar[tuple[list[str], ...]] = ContextVar("temporary", default=())


def written(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut and survives lost executors.

    Within `scratch` the table goes at its end; with `keep` only at that of the scratch around it, if any.
    """
    path = new_path(df.sparkSession, what)
    open_ones = _TEMPORARY.get()
    if len(open_ones) > keep:
        open_ones[-1 - keep].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that Spark knows it by."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was `written` inside and not kept. A frame that leaves must not read such a table."""
    mine: list[str] = []
    token = _TEMPORARY.set((*_TEMPORARY.get(), mine))
    try:
        yield
    finally:
        _TEMPORARY.reset(token)
        for path in mine:
            remove(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: float = 32) -> DataFrame:
    """`df` with a broadcast hint when its counted rows and their bytes are within bounds.

    `row_bytes` is the mean size of a row: the default holds for a few numbers, rows with texts or
    arrays must be measured.
    """
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * row_bytes <= BROADCAST_BYTES else df


#: Rows of one key beyond which its join partner goes to the rows by broadcast, and keys up to which all do.
HOT_ROWS, FEW_KEYS = 2000, 300_000


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str | list[str], n: str = "n") -> DataFrame:
    """Inner join with `keyed`, a written table of one row a key (numbers only) and its number `n` of rows.

    Up to FEW_KEYS keys are broadcast. Beyond that rows of a key of more than HOT_ROWS don't move:
    such keys are fewer than a 2000th of the rows, and are broadcast while within bounds. The others
    are joined by shuffles. The result is the same; `n` stays in it.
    """
    if keyed.count() <= FEW_KEYS:
        return rows.join(F.broadcast(keyed), key)
    hot = keyed.where(F.col(n) > HOT_ROWS)
    found = hot.count()
    if not found:
        return rows.join(keyed, key)
    names = [key] if isinstance(key, str) else key
    cold = rows.join(maybe_broadcast(hot.select(*names), found), key, "left_anti")
    return rows.join(maybe_broadcast(hot, found), key).unionByName(cold.join(keyed.where(F.col(n) <= HOT_ROWS), key))


def bounded(spark: SparkSession) -> None:
    """Arrow batches of this session hold ARROW_BYTES at most, so that long texts don't fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1") == "1":  # not set
        spark.conf.set(key, str(ARROW_BYTES))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """`batch` in runs of rows whose `column`, texts or lists of words, holds about `most` bytes; one larger row is a run of its own."""
    texts = batch.column(column)
    sizes = pc.multiply(pc.list_value_length(texts), 8) if pa.types.is_list(texts.type) else pc.binary_length(texts)
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        to = min(to, at + SLICE_ROWS)
        yield batch.slice(at, to - at)
        at = to


_ONLY: dict[Any, Any] = {}


def only(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: made once for a key; another operator's goes."""
    if key not in _ONLY:
        _ONLY.clear()
        pa.default_memory_pool().release_unused()
        _ONLY[key] = make()
    return _ONLY[key]


def texts_of(column: pa.Array) -> pa.Array:
    """Nulls become the empty text; the result has 64-bit offsets."""
    return column.cast(pa.large_string()).fill_null("")


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices flat[starts[i] : starts[i] + lengths[i]], one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(starts - (ends - lengths), lengths)
    return flat[at]


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
