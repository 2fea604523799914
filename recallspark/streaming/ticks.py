"""Structured Streaming: duplicate suppression, incremental projections, change feeds, retention, quotas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cost import MILLI, refilled

BUCKETS = 64  #: parts of a projection, by key


def without_duplicates(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first event of each key; keys are remembered for `delay` of event time."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def projection(spark: SparkSession, stream: DataFrame, keys: list[str], merge: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep a keyed table up to date from a stream; `latest` reads it.

    A batch is folded by `merge` (changes to one row a key) with the rows that the buckets it touches
    have so far, and only these buckets are written, as folders version=<batch>/bucket=<n>. A batch
    that is run again after a lost driver overwrites its own version only. `vacuum` removes versions
    that newer ones replace.
    """

    def tick(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.select("*", _bucket(keys, buckets))
        touched = own.select("bucket").distinct()
        before = latest(spark, target, number - 1)
        rows = batch if before is None else before.join(F.broadcast(touched), "bucket", "left_semi").drop("bucket").unionByName(batch)
        merged = merge(rows).select("*", _bucket(keys, buckets), F.lit(number).alias("version"))
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(target)

    return stream.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, target: str) -> list[tuple[int, int, str]]:
    """(version, bucket, folder) of a projection: folders are listed, files are not read."""
    top = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(target + "/version=*/bucket=*")) or []
    out = []
    for f in found:
        version, bucket = (f.getPath().getParent().getName(), f.getPath().getName())
        out.append((int(version.split("=")[1]), int(bucket.split("=")[1]), f.getPath().toString()))
    return out


def _newest(versions: list[tuple[int, int, str]], number: int) -> dict[int, tuple[int, str]]:
    out: dict[int, tuple[int, str]] = {}
    for version, bucket, path in sorted(versions):
        if version <= number:
            out[bucket] = (version, path)
    return out


def latest(spark: SparkSession, target: str, number: int) -> DataFrame | None:
    """The projection as of batch `number`, with its bucket: of each bucket the newest version up to it; None before the first."""
    paths = [path for _, path in _newest(_versions(spark, target), number).values()]
    return spark.read.option("basePath", target).parquet(*paths).drop("version") if paths else None


def vacuum(spark: SparkSession, target: str, number: int) -> int:
    """Delete the folders that newer ones up to `number` replace; reads as of older batches end there. Returns how many."""
    versions = _versions(spark, target)
    keep = {path for _, path in _newest(versions, number).values()}
    gone = [path for version, _, path in versions if version <= number and path not in keep]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)


def rebuild(rows: DataFrame, keys: list[str], merge: Callable[[DataFrame], DataFrame], target: str, buckets: int = BUCKETS) -> None:
    """The projection from genesis: all rows of the log in one batch, as version 0 of a new target."""
    merged = merge(rows).select("*", _bucket(keys, buckets), F.lit(0).alias("version"))
    merged.repartition("bucket").write.partitionBy("version", "bucket").parquet(target)


def change_feed(stream: DataFrame, types: str | None) -> DataFrame:
    """The events of some types (comma-separated); None is all, a blank filter nothing."""
    if types is None:
        return stream
    return stream.where(F.col("event_type").isin([t.strip() for t in types.split(",") if t.strip()]))


def retained(rows: DataFrame, at: str, now, ttl: str, newest: int | None = None, tie: str | None = None) -> DataFrame:
    """Rows not older than `ttl`, of these the newest n."""
    live = rows.where(F.col(at) >= now - F.expr(f"interval {ttl}"))
    return live if newest is None else live.orderBy(F.desc(at), *([F.desc(tie)] if tie else [])).limit(newest)


def quota_stream(requests: DataFrame, key: str, capacity: int, per_minute: int) -> DataFrame:
    """key, tie, allowed of a stream of requests(key, at in seconds, tie): a token bucket for each key as state.

    Requests of a batch are taken in time order; one from before the last batch earns nothing.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "tie"])  # one key's requests of one batch
        tokens, last = state.get if state.exists else (capacity * MILLI, int(rows["at"].iloc[0]))
        allowed = []
        for now in rows["at"].tolist():
            tokens, last = refilled(tokens, max(now - last, 0), capacity, per_minute), max(now, last)
            allowed.append(tokens >= MILLI)
            tokens -= MILLI if allowed[-1] else 0
        state.update((tokens, last))
        yield pd.DataFrame({key: [k[0]] * len(rows), "tie": rows["tie"].tolist(), "allowed": allowed})

    kind = requests.schema[key].dataType.simpleString()
    return requests.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, tie long, allowed boolean", "tokens long, last long", "append", GroupStateTimeout.NoTimeout)


def current_state_stream(changes: DataFrame, key: str) -> DataFrame:
    """key, current, previous after each batch that changes a key: a change older than the current one is late and left out.

    changes(key, at, arrival, value), at and arrival being whole numbers; equal times go to the later arrival.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("arrival")
        at, current, previous = state.get if state.exists else (None, None, None)
        for now, value in zip(rows["at"].tolist(), rows["value"].tolist(), strict=True):
            if at is None or now >= at:
                at, current, previous = now, value, current
        state.update((at, current, previous))
        yield pd.DataFrame({key: [k[0]], "current": [current], "previous": [previous]})

    kind, value = (changes.schema[c].dataType.simpleString() for c in (key, "value"))
    return changes.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, current {value}, previous {value}", f"at long, current {value}, previous {value}", "update", GroupStateTimeout.NoTimeout)
