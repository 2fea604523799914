"""Operator 4: packing token sequences by best fit decreasing.

Documents of more tokens than a window are first cut into full windows, each a sequence of its
own; what is left of every document, less than a window, is packed. Pieces are dealt to tasks by
a hash of the row they come from, each task packs its pieces longest first, and a segment tree
over remaining capacities finds the open sequence with the tightest fit in log2(window) steps.
A task holds the numbers of its open sequences only, never ids or texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import SLICE_BYTES, bounded, slices, texts_of
from .encoding import encoder

#: Sequence numbers of one task: its number times this, and on.
STRIDE = 1 << 36
#: Full windows have numbers from here on.
FULL = 1 << 61
PIECES = "row_key long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class TightestFit:
    """A segment tree over capacities 0..size: which have an open sequence, and which fits tightest."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        node = self.leaves + capacity
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, sequence) with the least capacity of at least `need`, taken out; None if there is none."""
        node = self.leaves + need
        if need >= len(self.open):
            return None
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        sequence = self.open[capacity].pop()
        if not self.open[capacity]:
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return capacity, sequence


def cut(docs: DataFrame, vocabulary: str, spaced: bool, end_id: int, window: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of docs(doc_id long, text string): full windows and what is left, each with its place.

    A document's ids are those of its whole text, null being empty, and `end_id`. Columns row_key
    (of the input row), doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for some in slices(batch, most=2 * SLICE_BYTES):
                ids, offsets = encoder(vocabulary, spaced).encode(texts_of(some.column("text")))
                counts = np.diff(offsets) + 1
                whole = np.insert(ids, offsets[1:], end_id).astype("<u4")
                ends = np.cumsum(counts)
                number = -(-counts // window)
                doc = np.repeat(np.arange(len(counts)), number)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)) * window
                length = np.minimum(window, counts[doc] - start)
                first = (ends - counts)[doc] + start
                raw = memoryview(whole).cast("B")
                out = {
                    "row_key": pa.array(row + doc),
                    "doc_id": some.column("doc_id").take(pa.array(doc)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)], pa.int64()),
                    "doc_tokens": pa.array(counts[doc]),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(whole.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(out)
                row += len(counts)

    bounded(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(pieces, PIECES + (", ids array<long>" if with_ids else ""))


def pack(pieces: DataFrame, window: int = 2048, partitions: int | None = None) -> DataFrame:
    """`pieces` with sequence_id and offset (in the sequence, without gaps from 0).

    Needs length, from 1 to window, and columns row_key and start that tell rows apart; keeps all
    others. An empty table gives none. No sequence holds more than `window`.
    """
    spark = pieces.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, base, count = TightestFit(window), TaskContext.get().partitionId() * STRIDE, 0
        for batch in batches:
            sequences, offsets = [], []
            for length in batch.column("length").to_pylist():
                if length == window:
                    sequences.append(FULL + base + count)
                    offsets.append(0)
                    count += 1
                    continue
                got = fits.take(length)
                if got is None:
                    got = window, base + count
                    count += 1
                capacity, sequence = got
                sequences.append(sequence)
                offsets.append(window - capacity)
                if capacity > length:
                    fits.put(capacity - length, sequence)
            yield batch.append_column("sequence_id", pa.array(sequences, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    dealt = pieces.repartition(partitions, "row_key", "start").sortWithinPartitions(F.desc("length"), "row_key", "start")
    schema = StructType([*dealt.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return dealt.mapInArrow(fit, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = 2048, with_ids: bool = False) -> DataFrame:
    """Cut and pack docs(doc_id, text) by a vocabulary that drops white space; a row for each piece.

    Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for,
    ids. Null and empty texts are one end id; null and repeated doc_ids are rows like others.
    """
    packed = pack(cut(docs, vocabulary, False, end_id, window, with_ids), window)
    return packed.drop("row_key")


def sequences(packed: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids: whole sequences of packed pieces with ids, padded to `window` unless their length is a power of two."""
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = whole.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    fine = n.bitwiseAND(n - 1) == 0
    return ids.select("sequence_id", F.when(fine, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), F.lit(window) - n))).alias("ids"))
