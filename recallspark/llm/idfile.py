"""Operator 1: token ids in a compact binary form.

Ids are coded by an adaptive context-mixing range coder. Each block of at most BLOCK ids is
coded on its own: it starts from a fresh model, carries the list of its distinct ids and the
crc32 of its ids, and can be read without any other block.

The model. With s the last id of the block and r the one before, the guesses of order 2 and order
1 are the ids that came after hash(r, s) and after s before, each with a confidence. The
probability of an id is the mixture w2 [id = guess 2] + w1 [id = guess 1] + w0 p0(id), where p0
is the order-0 frequency of the block so far and the weights follow, for each pair of
confidences, how often each guess was right. Guesses are learnt after every CHUNK ids, weights
and p0 at the steps WEIGH and REBUILD. The coder's arithmetic is on integers, and p0's on doubles
whose rounding IEEE 754 fixes, so every machine reads what another wrote.

Many blocks are coded side by side: step t handles the t-th id of every block with numpy, so
Python's cost is shared by up to LANES blocks. What doesn't depend on a step's own result is
computed for CHUNK steps at once.

The file format: a folder of Parquet files (any file system Spark knows) whose rows are segments
of whole documents in ascending doc_id order, `part`, `segment`, `docs` (varints: doc_id steps
and token counts), `blocks` (the coded blocks). Spark's commit protocol makes a write whole or
absent when executors are lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bounded, new_path, offsets_of, slices, texts_of
from .encoding import encoder

BLOCK = 4096
CUT = 2048  #: ids of a block that is written here: twice the lanes of a task for one 16th more bytes
STORE = 800_000  #: pieces of text that a worker remembers
LANES = 2048
CHUNK = 64  #: steps after which guesses are learnt
SEGMENT = 1 << 19  #: ids after which a segment closes
MAGIC = b"RSI2"
SLOTS = 2048  #: order-2 contexts of a block
P0_BITS, P0 = 12, 1 << 12  #: the whole of order-0 probabilities
REBUILD = {64, 256, 1024, 2048, 3072}  #: steps at which p0 is made anew from the counts
WEIGH = REBUILD | {128, 512, 1536, 2560}  #: steps at which weights are made anew

U = np.uint64
# a digit of 32 bits leaves when a span falls below 2**30; the least part of a span is 2**-17 of it
DIGIT, REST = 32, 30
WHOLE = (1 << DIGIT + REST) - 1


class Corrupt(ValueError):
    """A block's checksum or form is wrong."""


def varint_sizes(values: np.ndarray) -> np.ndarray:
    v = np.asarray(values).astype(np.uint64)
    need, most = np.ones(len(v), np.int64), int(v.max(initial=0))
    for k in range(1, 10):
        if most >> (7 * k):
            need += v >= U(1 << (7 * k))
    return need


def varints(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values, seven bits a byte, lowest first."""
    v = np.asarray(values).astype(np.uint64)
    need = varint_sizes(v)
    out = np.zeros(int(need.sum()), np.uint8)
    start = offsets_of(need)[:-1]
    for k in range(int(need.max(initial=0))):
        on = need > k
        out[start[on] + k] = ((v[on] >> U(7 * k)) & U(127)).astype(np.uint8) | np.where(need[on] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def from_varints(data: bytes | memoryview) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    if len(raw) and (not len(ends) or ends[-1] != len(raw) - 1):
        raise Corrupt("a varint is cut off")
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        on = starts + k <= ends
        out[on] |= (raw[starts[on] + k] & 127).astype(np.uint64) << U(7 * k)
    return out


class _Model:
    """The models of many blocks ("lanes") over `seq`, their ids' numbers by lane and step.

    What is done for many steps at once goes lane by lane, so that a lane's tables stay in the cache.
    """

    def __init__(self, sizes: np.ndarray, seq: np.ndarray, search: bool = False):
        self.search, self.seq = search, seq
        n, k = len(sizes), max(1, int(sizes.max(initial=1)))
        self.n, self.k = n, k
        self.sizes = sizes.astype(np.int32)
        self.counts = (np.arange(k)[None, :] < self.sizes[:, None]).astype(np.int32)
        self.after = np.zeros(n * (k + SLOTS), np.uint16)  # id number << 2 | confidence
        self.right = np.zeros((n * 16, 3), np.int64)  # neither, order 2, else order 1, by confidences
        self.outcome = np.zeros(seq.shape, np.uint8)
        lane = np.arange(n)
        self.row1, self.row2, self.row16, self.row_p = lane * k, n * k + lane * SLOTS, lane * 16, lane * P0
        self.built = self.weighed = 0
        self.rebuild(0, n)
        self.weigh(0, n)

    def rebuild(self, t: int, m: int) -> None:
        """p0 of the first m lanes in parts of P0: every id of the block keeps one, the rest follows the counts."""
        k = self.k
        if t > self.built:
            at = self.seq[:m, self.built : t] + self.row1[:m, None]
            self.counts[:m] += np.bincount(at.ravel(), minlength=m * k).reshape(m, k).astype(np.int32) * np.int32(24)
            self.built = t
        sizes = self.sizes[:m, None]
        cum = np.cumsum(self.counts[:m], axis=1, dtype=np.float64)
        cum *= (P0 - sizes) / cum[:, -1:]
        end = cum.astype(np.int32)
        column = np.arange(k, dtype=np.int32)[None, :]
        end += np.minimum(column + 1, sizes)
        end[column >= sizes - 1] = P0
        start = np.zeros_like(end)
        start[:, 1:] = end[:, :-1]
        end -= start
        if self.search:  # the id of each part
            self.owner = np.repeat(np.broadcast_to(column.astype(np.uint16), (m, k)).ravel(), end.ravel())
        self.parts = (start << 16 | end).ravel()

    def weigh(self, t: int, m: int) -> None:
        """w2 | w1 << 16 in 32768ths: 96 and more stay with each guess, 1024 and more with order 0."""
        if t > self.weighed:
            at = self.outcome[:m, self.weighed : t] + self.row16[:m, None] * 4
            self.right[: m * 16] += np.bincount(at.ravel(), minlength=m * 64).reshape(m * 16, 4)[:, :3]
            self.weighed = t
        total = self.right.sum(axis=1) * 4 + 8
        w2, w1 = (96 + 30904 * (self.right[:, j] * 4 + 1) // total for j in (1, 2))
        self.weight = w2 | w1 << 16

    def past(self, t: int, to: int, m: int) -> tuple[np.ndarray, ...]:
        """The ids of the steps t to `to`, where their guesses of order 2 and 1 lie, and the guesses."""
        known = np.zeros((m, to - t + 2), np.uint16)
        known[:, max(0, 2 - t) :] = self.seq[:m, max(0, t - 2) : to]
        s = known[:, 1:-1]
        at2 = (known[:, :-2] * np.uint16(0x9E5) + s & np.uint16(SLOTS - 1)) + self.row2[:m, None]
        at1 = s + self.row1[:m, None]
        return known[:, 2:], at2, at1, self.after.take(at2), self.after.take(at1)

    def learn(self, t: int, to: int, m: int, x, at2, at1, e2, e1) -> None:
        hit2, hit1 = e2 >> 2 == x, e1 >> 2 == x
        c2, c1, fresh = e2 & 3, e1 & 3, x << 2
        self.outcome[:m, t:to] = (c2 << 4 | c1 << 2) + np.where(hit2, np.uint16(1), hit1 * np.uint16(2))
        self.after[at2] = np.where(hit2, e2 + (c2 < 3), np.where(c2 > 1, e2 - np.uint16(2), fresh))
        self.after[at1] = np.where(hit1, e1 + (c1 < 3), np.where(c1 > 1, e1 - np.uint16(2), fresh))

    def renew(self, t: int, m: int) -> None:
        if t in REBUILD:
            self.rebuild(t, m)
        if t in WEIGH:
            self.weigh(t, m)


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lanes from the longest block, for each step the number of lanes still running)"""
    order = np.argsort(-lengths, kind="stable")
    steps = int(lengths.max(initial=0))
    return order, len(lengths) - np.searchsorted(np.sort(lengths), np.arange(steps), side="right")


def _distinct(ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, ascending; the number of each id among them) for ids up to `most`."""
    if most >= 1 << 18:
        return np.unique(ids, return_inverse=True)
    on = np.zeros(most + 1, np.bool_)
    on[ids] = True
    table = np.flatnonzero(on)
    place = np.empty(most + 1, np.int32)
    place[table] = np.arange(len(table), dtype=np.int32)
    return table, place[ids]


def _together(count: int) -> Iterator[slice]:
    """Runs of like length, at most LANES."""
    runs = -(-count // LANES)
    for i in range(runs):
        yield slice(count * i // runs, count * (i + 1) // runs)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of 1 to BLOCK ids below 2**32 as bytes."""
    return [x for some in _together(len(blocks)) for x in _encode_lanes(blocks[some])]


def _encode_lanes(blocks: list[np.ndarray]) -> list[bytes]:
    lengths = np.array([len(b) for b in blocks], np.int64)
    order, running = _by_length(lengths)
    n, steps = len(blocks), len(running)
    seq = np.zeros((n, steps), np.uint16)
    ends = offsets_of(lengths)
    ids = np.concatenate(blocks)
    met, met_as = _distinct(ids, int(ids.max()))
    found = []
    for lane, i in enumerate(order):
        table, seq[lane, : lengths[i]] = _distinct(met_as[ends[i] : ends[i + 1]], len(met) - 1)
        found.append(met[table].astype(np.int64))
    sizes = np.array([len(u) for u in found], np.int64)
    model = _Model(sizes, seq)
    low, span = np.zeros(n, np.int64), np.full(n, WHOLE, np.int64)
    # a step makes one digit at most; digits above 32 bits carry into those before them
    out, lane, filled = [], [], []
    for t in range(0, steps, CHUNK):
        to, m = min(steps, t + CHUNK), int(running[t])
        model.renew(t, m)
        past = model.past(t, to, m)
        x, _, _, e2, e1 = past
        w = model.weight.take(((e2 & 3) << 2 | e1 & 3) + model.row16[:m, None]).astype(np.int32)
        w2, w1 = w & 0xFFFF, w >> 16
        first = w2 + w1
        rest = 32768 - first
        p = model.parts.take(x + model.row1[:m, None])
        part, width, whole = p >> 16, p & 0xFFFF, np.zeros_like(p)
        two = e2 >> 2 == x
        on = np.flatnonzero(two | (e1 >> 2 == x))
        two, a2 = two.ravel()[on], w2.ravel()[on]
        first.ravel()[on] = np.where(two, 0, a2)
        whole.ravel()[on] = np.where(two, a2, w1.ravel()[on])
        part.ravel()[on] = width.ravel()[on] = 0
        first, rest, part, width, whole = (y.T.astype(np.int64, order="C") for y in (first, rest, part, width, whole))
        for k in range(to - t):
            m = int(running[t + k])
            unit = span[:m] >> 15
            q = unit * rest[k, :m] >> P0_BITS
            lo = low[:m] + unit * first[k, :m]
            lo += q * part[k, :m]
            unit *= whole[k, :m]
            q *= width[k, :m]
            unit += q
            on = np.flatnonzero(unit < 1 << REST)
            digits = lo[on]
            out.append(digits >> REST)
            lane.append(on)
            lo[on] = (digits & (1 << REST) - 1) << DIGIT
            unit[on] <<= DIGIT
            low[:m], span[:m] = lo, unit
        model.learn(t, to, int(running[t]), *past)
    lane += [np.arange(n)] * 2
    out += [low >> REST, (low & (1 << REST) - 1) << (DIGIT - REST)]
    lanes = np.concatenate(lane)
    by_lane = np.argsort(lanes.astype(np.uint16), kind="stable")
    digits, filled = np.concatenate(out)[by_lane], offsets_of(np.bincount(lanes, minlength=n))
    while len(on := np.flatnonzero(digits >> DIGIT)):
        carried = digits[on] >> DIGIT
        digits[on] &= (1 << DIGIT) - 1
        digits[on - 1] += carried
    words = memoryview(digits.astype("<u4")).cast("B")
    tables = np.concatenate(found)
    ends = offsets_of(sizes)
    steps_of = np.diff(tables, prepend=0)
    steps_of[ends[:-1]] = tables[ends[:-1]]
    heads, head_ends = varints(steps_of), offsets_of(varint_sizes(steps_of))[ends]
    done: list[bytes] = [b""] * n
    for j, i in enumerate(order):
        head, mine = heads[head_ends[j] : head_ends[j + 1]], words[4 * filled[j] : 4 * filled[j + 1]]
        fields = [lengths[i], sizes[j], len(head), len(mine), zlib.crc32(blocks[i].astype("<u4"))]
        done[i] = np.array(fields, "<u4").tobytes() + head + mine
    return done


def decode_blocks(data: list[bytes]) -> list[np.ndarray]:
    """The ids of each coded block; Corrupt if one isn't what was written."""
    return [x for some in _together(len(data)) for x in _decode_lanes(data[some])]


def _decode_lanes(data: list[bytes]) -> list[np.ndarray]:
    heads = np.zeros((len(data), 5), np.int64)
    for i, d in enumerate(data):
        if len(d) < 20:
            raise Corrupt("a block is cut off")
        heads[i] = np.frombuffer(d, "<u4", 5)
        if len(d) != 20 + heads[i, 2] + heads[i, 3] or not 0 < heads[i, 0] <= BLOCK or heads[i, 3] % 4:
            raise Corrupt("a block's lengths don't fit")
    lengths = heads[:, 0]
    order, running = _by_length(lengths)
    n, steps = len(data), len(running)
    listed = from_varints(b"".join(data[i][20 : 20 + heads[i, 2]] for i in order)).astype(np.int64)
    sizes = heads[order, 1]
    if len(listed) != sizes.sum() or sizes.min() < 1 or (sizes > lengths[order]).any():
        raise Corrupt("a block's table of ids doesn't fit")
    ends = offsets_of(sizes)
    sums = np.cumsum(listed)
    tables = (sums - np.repeat(sums[ends[:-1]] - listed[ends[:-1]], sizes)).astype(np.uint32)
    at = offsets_of(heads[order, 3] // 4)[:-1]
    # a damaged block may read beyond its end, by a digit a step at most
    source = np.frombuffer(b"".join([*(data[i][20 + heads[i, 2] :] for i in order), bytes(4 * steps + 12)]), "<u4").astype(np.int64)
    low_bits = DIGIT - REST
    digits = (source[:-1] & (1 << low_bits) - 1) << REST | source[1:] >> low_bits  # as they follow the first REST + DIGIT bits
    seq = np.zeros((n, steps), np.uint16)
    model = _Model(sizes, seq, search=True)
    # the place of the code in the span
    place, span = source[at] << REST | source[at + 1] >> low_bits, np.full(n, WHOLE, np.int64)
    at = at + 1
    r, s = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for t in range(0, steps, CHUNK):
        to = min(steps, t + CHUNK)
        model.renew(t, int(running[t]))
        now = np.zeros((to - t, n), np.uint16)
        for k in range(t, to):
            m = int(running[k])
            if m < len(s):
                r, s, place, span, at = r[:m], s[:m], place[:m], span[:m], at[:m]
            h = r * 0x9E5
            h += s
            h &= SLOTS - 1
            h += model.row2[:m]
            e2, e1 = model.after.take(h), model.after.take(model.row1[:m] + s)
            w = model.weight.take(((e2 & 3) << 2 | e1 & 3) + model.row16[:m])
            w2, first = w & 0xFFFF, w >> 16
            first += w2
            unit = span >> 15
            q = 32768 - first
            q *= unit
            q >>= P0_BITS
            start = unit * first
            c = place - start
            c //= q
            on = np.flatnonzero(c < 0)
            np.minimum(c, P0 - 1, out=c)
            c[on] = 0
            c += model.row_p[:m]
            x = model.owner.take(c).astype(np.int64)
            p = model.parts.take(model.row1[:m] + x).astype(np.int64)
            size = p & 0xFFFF
            size *= q
            p >>= 16
            p *= q
            p += start
            if len(on):
                a2, all2 = unit[on] * w2[on], start[on]
                two = place[on] < a2
                x[on] = np.where(two, e2[on], e1[on]) >> 2
                p[on] = np.where(two, 0, a2)
                size[on] = np.where(two, a2, all2 - a2)
            place = place - p
            need = (size < 1 << REST).astype(np.int64)
            shift = need << 5
            size <<= shift
            place <<= shift
            place |= digits.take(at) * need
            at = at + need
            span = size
            now[k - t, :m] = x
            r, s = s, x
        seq[:, t:to] = now.T
        m = int(running[t])
        model.learn(t, to, m, *model.past(t, to, m))
    done: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
    for lane, i in enumerate(order):
        ids = tables[ends[lane] : ends[lane + 1]][seq[lane, : lengths[i]]]
        if zlib.crc32(ids.astype("<u4", copy=False)) != heads[i, 4]:
            raise Corrupt("a block's checksum is wrong")
        done[i] = ids
    return done


SEGMENT_SCHEMA = "part int, segment int, n_docs int, n_ids long, docs binary, blocks array<binary>"


def _segments(vocabulary: str, spaced: bool, end_id: int | None):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of whole documents, in the order in which the task reads them."""
        part, number, held, size, ready, blocks = TaskContext.get().partitionId(), 0, [], 0, [], 0
        for batch in batches:
            for some in slices(batch, most=2 * SLICE_BYTES):
                ids, offsets = encoder(vocabulary, spaced, STORE).encode(texts_of(some.column("text")))
                for doc, a, b in zip(some.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                    held.append((doc, ids[a:b]))
                    size += int(b - a) + 1
                    if size >= SEGMENT:
                        ready.append(_closed(part, number, held, end_id))
                        blocks += len(ready[-1]["blocks"])
                        number, held, size = number + 1, [], 0
                        if blocks >= LANES:
                            yield _coded(ready)
                            ready, blocks = [], 0
        if held:
            ready.append(_closed(part, number, held, end_id))
        if ready:
            yield _coded(ready)

    return cut


def _closed(part: int, number: int, held: list, end_id: int | None) -> dict:
    """A segment whose blocks are still plain ids."""
    end = np.array([] if end_id is None else [end_id], np.uint32)
    ids = np.concatenate([x for _, got in held for x in (got, end)])
    # a null doc_id is 0, others are 1 + zigzag
    keys = np.array([0 if d is None else 1 + ((d << 1) ^ (d >> 63)) for d, _ in held], dtype=np.uint64)
    counts = np.array([len(got) + len(end) for _, got in held], np.uint64)
    docs = varints(np.concatenate([keys, counts]))
    docs = MAGIC + np.array([zlib.crc32(docs)], "<u4").tobytes() + docs
    return {"part": part, "segment": number, "n_docs": len(held), "n_ids": len(ids), "docs": docs, "blocks": [ids[i : i + CUT] for i in range(0, len(ids), CUT)]}


def _coded(ready: list[dict]) -> pa.RecordBatch:
    """The segments with their blocks coded, all side by side."""
    coded = iter(encode_blocks([b for s in ready for b in s["blocks"]]))
    rows = [s | {"blocks": [next(coded) for _ in s["blocks"]]} for s in ready]
    types = {"part": pa.int32(), "segment": pa.int32(), "n_docs": pa.int32(), "n_ids": pa.int64(), "docs": pa.binary(), "blocks": pa.list_(pa.binary())}
    return pa.RecordBatch.from_pylist(rows, pa.schema(types))


def write_ids(docs: DataFrame, path: str, vocabulary: str, spaced: bool = True, end_id: int | None = 0, partitions: int | None = None) -> None:
    """Encode every text of docs(doc_id long, text string) and write the ids to the folder `path`.

    Documents lie in ascending doc_id order (null first, equal ids in any order among themselves).
    A null text is empty; every document, empty ones too, ends with `end_id` unless that is None.
    Other columns are left out. An empty table makes an empty folder.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounded(spark)
    # rows that share a doc_id part by their number: one id may hold a third of all rows
    numbered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row"))
    ordered = numbered.repartitionByRange(partitions, "doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")
    ordered.mapInArrow(_segments(vocabulary, spaced, end_id), SEGMENT_SCHEMA).write.parquet(path)


def _documents(with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents of the segments, decoded some segments at a time."""
        held: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                held += batch.slice(i, 1).to_pylist()
                if sum(len(s["blocks"]) for s in held) >= LANES:
                    yield from _decoded(held, with_ids)
                    held = []
        if held:
            yield from _decoded(held, with_ids)

    return read


def _decoded(held: list[dict], with_ids: bool) -> Iterator[pa.RecordBatch]:
    blocks = iter(decode_blocks([b for s in held for b in s["blocks"]]))
    for s in held:
        if s["docs"][:4] != MAGIC or zlib.crc32(s["docs"][8:]) != int(np.frombuffer(s["docs"], "<u4", 1, 4)[0]):
            raise Corrupt("a segment's list of documents is wrong")
        listed = from_varints(s["docs"][8:])
        keys, counts = listed[: s["n_docs"]], listed[s["n_docs"] :].astype(np.int64)
        ids = np.concatenate([np.zeros(0, np.uint32), *(next(blocks) for _ in s["blocks"])])
        if len(counts) != s["n_docs"] or counts.sum() != len(ids) or len(ids) != s["n_ids"]:
            raise Corrupt("a segment's counts don't fit its ids")
        at = offsets_of(counts)
        raw = ids.astype("<u4").tobytes()
        z = (keys - U(1)).astype(np.int64)
        doc_ids = ((z >> 1) & np.int64((1 << 63) - 1)) ^ -(z & 1)
        columns = {
            "part": pa.array(np.full(len(keys), s["part"], np.int32)),
            "segment": pa.array(np.full(len(keys), s["segment"], np.int32)),
            "position": pa.array(at[:-1]),
            "doc_id": pa.array(doc_ids, mask=keys == 0),
            "n_tokens": pa.array(counts),
            "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64)))
        yield pa.RecordBatch.from_pydict(columns)


def read_ids(spark, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of a folder that `write_ids` wrote.

    Columns doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers) and, if asked for, ids. A damaged block fails the read.
    """
    stored = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    # one row a segment, of SEGMENT ids: few next to the documents, and sums only
    from pyspark.sql import Window

    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("ids_of_part"))
    base = parts.select("part", (F.sum("ids_of_part").over(Window.orderBy("part")) - F.col("ids_of_part")).alias("before_part"))
    within = Window.partitionBy("part").orderBy("segment")
    starts = stored.select("part", "segment", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("before_segment")).join(F.broadcast(base), "part")
    schema = "part int, segment int, position long, doc_id long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    found = stored.mapInArrow(_documents(with_ids), schema)
    placed = found.join(starts, ["part", "segment"])
    start = (F.col("before_part") + F.col("before_segment") + F.col("position")).alias("start")
    return placed.select("doc_id", start, "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write the ids of docs in the shared folder, read the files back and list the documents."""
    path = new_path(docs.sparkSession, "ids")
    write_ids(docs, path, vocabulary, spaced=True, end_id=end_id)
    return read_ids(docs.sparkSession, path, with_ids=False)
