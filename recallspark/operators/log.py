"""The event log: reads, appends with idempotency, replay, duplicates, hash chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranked import numbered


def sequenced(events: DataFrame, stream: list[str], order: list[str]) -> DataFrame:
    """Events with seq from 1 within their stream."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(*stream).orderBy(*order)))


def read_range(log: DataFrame, from_seq: int, limit: int, cuts: DataFrame | None = None, stream: list[str] | None = None) -> DataFrame:
    """Events of the (already chosen) streams from max(from_seq, the stream's cut), ascending; limit 0 is all."""
    if cuts is not None:
        log = log.join(cuts, stream, "left").where(F.col("seq") >= F.greatest(F.lit(from_seq), F.coalesce("cut_seq", F.lit(0)))).drop("cut_seq")
    else:
        log = log.where(F.col("seq") >= from_seq)
    if not limit:
        return log
    w = Window.partitionBy(*(stream or [F.lit(0)])).orderBy("seq")
    return log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def read_tail(log: DataFrame, n: int, stream: list[str]) -> DataFrame:
    """The last n events of each stream; 0 is none."""
    w = Window.partitionBy(*stream).orderBy(F.desc("seq"))
    return log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def replay(log: DataFrame, cursor: tuple | None, order: list[str], limit: int) -> DataFrame:
    """The next `limit` rows in the order of two columns after a cursor.

    For sealed rows only give a log without its head (see `sealed`).
    """
    a, b = order
    if cursor is not None:
        log = log.where((F.col(a) > cursor[0]) | ((F.col(a) == cursor[0]) & (F.col(b) > cursor[1])))
    return log.orderBy(a, b).limit(limit)


def admission(batch: DataFrame, stream: list[str], size: str, expected: DataFrame, last: DataFrame, tombstones: DataFrame, most_rows: int = 1024, most_bytes: int = 16 << 20) -> DataFrame:
    """One row for each stream of a batch: rows, bytes, and why it is refused as a whole (null: admitted).

    Too many rows or bytes, a tombstone, or an expected next seq (0: any) other than the stream's last
    (last(stream, last)) and one.
    """
    sums = batch.groupBy(*stream).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))
    out = sums.join(expected, stream, "left").join(last, stream, "left").join(tombstones.select(*stream, F.lit(True).alias("tombstone")).distinct(), stream, "left")
    next_seq = F.coalesce("last", F.lit(0)) + 1
    why = F.when(F.col("tombstone"), "tombstoned").when(F.col("rows") > most_rows, "too_many_events").when(F.col("bytes") > most_bytes, "too_many_bytes")
    why = why.when((F.coalesce("expected_next_seq", F.lit(0)) != 0) & (F.col("expected_next_seq") != next_seq), "seq_conflict")
    return out.select(*stream, "rows", "bytes", why.alias("refused"))


def sealed(log: DataFrame, head: DataFrame, stream: list[str]) -> DataFrame:
    """The log without the rows of its unsealed head: those of a stream from head(stream, head_seq) on."""
    both = log.join(F.broadcast(head), stream, "left")
    return both.where(F.col("head_seq").isNull() | (F.col("seq") < F.col("head_seq"))).drop("head_seq")


def read_many(log: DataFrame, wanted: DataFrame, stream: list[str]) -> DataFrame:
    """Events of the streams in wanted(stream, from_seq, max_events), each from its seq on and up to its number, 0 being all."""
    own = log.join(F.broadcast(wanted), stream).where(F.col("seq") >= F.col("from_seq"))
    return own.where((F.col("max_events") == 0) | (F.col("seq") < F.col("from_seq") + F.col("max_events"))).drop("from_seq", "max_events")


def append_status(batch: DataFrame, committed: DataFrame, stream: list[str], order: str, max_bytes: int = 128) -> DataFrame:
    """batch with status APPENDED, DUPLICATE_COMMITTED, DUPLICATE_IN_BATCH or REJECTED and the seq of appended rows.

    An event id that is null, empty or too long is rejected; the first of equal ids in a batch counts.
    Streams that `admission` refuses are not to be in the batch.
    """
    known = committed.groupBy(*stream, "event_key").agg(F.lit(True).alias("_known"))
    last = committed.groupBy(*stream).agg(F.max("seq").alias("_last"))
    joined = batch.join(known, [*stream, "event_key"], "left").join(last, stream, "left")
    size = F.octet_length("event_key")
    nth = F.row_number().over(Window.partitionBy(*stream, "event_key").orderBy(order))
    status = F.when(F.coalesce(size, F.lit(0)).isin(0) | (size > max_bytes), "REJECTED").when(F.col("_known"), "DUPLICATE_COMMITTED").when(nth > 1, "DUPLICATE_IN_BATCH").otherwise("APPENDED")
    out = joined.withColumn("status", status)
    place = F.sum((F.col("status") == "APPENDED").cast("int")).over(Window.partitionBy(*stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("seq", F.when(F.col("status") == "APPENDED", F.coalesce("_last", F.lit(0)) + place)).drop("_known", "_last")


def last_per_key(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def chain_breaks(chain: DataFrame, by: list[str]) -> DataFrame:
    """by, rows, first_break: the first seq that doesn't follow its predecessor by one or whose prev_hash differs, else null."""
    w = Window.partitionBy(*by).orderBy("seq")
    bad = (F.col("seq") != F.coalesce(F.lag("seq").over(w) + 1, F.lit(1))) | ~F.col("prev_hash").eqNullSafe(F.lag("hash").over(w))
    return chain.withColumn("_bad", bad).groupBy(*by).agg(F.count("*").alias("rows"), F.min(F.when(F.col("_bad"), F.col("seq"))).alias("first_break"))


def range_digests(log: DataFrame, by: list[str], order: str, value: str, chunk: int = 128) -> DataFrame:
    """by, chunk, records, digest: SHA-256 over each run of `chunk` records in the order of a number or time that tells them apart."""
    own = log.select(*by, order, F.unhex(F.sha2(F.col(value).cast("string"), 256)).alias("h"))
    placed = numbered(own, by, F.col(order), [order], "n").withColumn("chunk", F.expr(f"(n - 1) div {chunk}"))
    item = F.array_sort(F.collect_list(F.struct("n", "h")))
    out = placed.groupBy(*by, "chunk").agg(F.count("*").alias("records"), item.alias("items"))
    return out.select(*by, "chunk", "records", F.sha2(F.array_join(F.transform("items", lambda x: F.lower(F.hex(x["h"]))), ""), 256).alias("digest"))


def current_state(changes: DataFrame, key: list[str], arrival: str, at: str, value: str) -> DataFrame:
    """key, current, current_at, previous: late changes don't replace newer ones, ties go to the last applied."""
    w = Window.partitionBy(*key).orderBy(arrival)
    newest = F.max(at).over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = changes.withColumn("_newest", newest).where(F.col("_newest").isNull() | (F.col(at) >= F.col("_newest")))
    kept = kept.withColumns({"previous": F.lag(value).over(w), "_last": F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(arrival)))})
    return kept.where("_last = 1").select(*key, F.col(value).alias("current"), F.col(at).alias("current_at"), "previous")
