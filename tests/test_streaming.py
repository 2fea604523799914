"""Streaming results against those of the same rows in one batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.operators import cost, log
from recallspark.streaming import ticks


def changes(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 7).alias("key"), F.col("id").alias("at"), (F.col("id") * 3 % 11).alias("value"))
    for k in range(3):
        rows.where(f"at % 3 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/p={k}")
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def fold(df):
    return log.last_per_key(df, ["key"], ["at"])


def test_projection_equals_batch(spark, tmp_path):
    rows, stream = changes(spark, tmp_path)
    out = f"{tmp_path}/out"
    for _ in range(2):  # started again it has nothing to add
        ticks.projection(spark, stream, ["key"], fold, out, f"{tmp_path}/cp", 5).awaitTermination(120)
    want = sorted(map(tuple, fold(rows).collect()))
    read = lambda: sorted(map(tuple, ticks.latest(spark, out, 2).drop("bucket", "p").collect()))
    assert ticks.latest(spark, out, -1) is None
    assert read() == want
    assert ticks.vacuum(spark, out, 2) > 0 and ticks.vacuum(spark, out, 2) == 0
    assert read() == want
    ticks.rebuild(rows, ["key"], fold, f"{tmp_path}/genesis", 5)
    assert sorted(map(tuple, ticks.latest(spark, f"{tmp_path}/genesis", 0).drop("bucket").collect())) == want


def test_a_tick_writes_touched_buckets_only(spark, tmp_path):
    rows = spark.range(40).select("id", F.lit(0).alias("at"), F.col("id").alias("value"))
    for k, part in enumerate((rows, rows.where("id = 3").withColumn("at", F.lit(1)))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/p={k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    ticks.projection(spark, stream, ["id"], lambda df: log.last_per_key(df, ["id"], ["at"]), f"{tmp_path}/out", f"{tmp_path}/cp", 8).awaitTermination(120)
    versions = [v for v, _, _ in ticks._versions(spark, f"{tmp_path}/out")]
    assert min(versions.count(0), versions.count(1)) == 1
    assert ticks.latest(spark, f"{tmp_path}/out", 1).count() == 40


def into_memory(df, name, tmp_path, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)


def test_duplicates(spark, tmp_path):
    _, stream = changes(spark, tmp_path)
    into_memory(ticks.without_duplicates(stream.withColumn("ts", F.timestamp_seconds("at")), ["key"], "ts", "1 hour"), "firsts", tmp_path)
    assert sorted(r.key for r in spark.table("firsts").collect()) == list(range(7))


def test_change_feed(spark, tmp_path):
    _, stream = changes(spark, tmp_path)
    typed = stream.withColumn("event_type", F.concat(F.lit("t"), "key"))
    for name, types, n in (("some", "t1, t2", 18), ("blank", " , ", 0), ("every", None, 60)):
        into_memory(ticks.change_feed(typed, types), name, tmp_path)
        assert spark.table(name).count() == n


def test_quota_state_equals_batch(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 3).alias("key"), F.col("id").alias("at"), F.col("id").alias("tie"))
    for k in range(3):
        rows.where(f"at >= {20 * k} AND at < {20 * k + 20}").coalesce(1).write.parquet(f"{tmp_path}/in/p={k}")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*")
    into_memory(ticks.quota_stream(stream, "key", 3, 4), "quota", tmp_path)
    want = {r.tie: r.allowed for r in cost.quota(rows, ["key"], "at", 3, 4).collect()}
    assert {r.tie: r.allowed for r in spark.table("quota").collect()} == want and len(set(want.values())) == 2


def test_current_state_equals_batch(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 4).alias("key"), (F.col("id") * 37 % 60).alias("at"), F.col("id").alias("arrival"), (F.col("id") * 7 % 13).alias("value"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/p=0")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*")
    into_memory(ticks.current_state_stream(stream, "key"), "states", tmp_path, "update")
    want = {r.key: r.current for r in log.current_state(rows, ["key"], "arrival", "at", "value").collect()}
    assert {r.key: r.current for r in spark.table("states").collect()} == want


def test_retention(spark):
    rows = spark.range(20).select("id", F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    now = F.timestamp_seconds(F.lit(20 * 3600))
    assert ticks.retained(rows, "ts", now, "5 hours").count() == 5
    assert sorted(r.id for r in ticks.retained(rows, "ts", now, "5 hours", 2, "id").collect()) == [18, 19]
