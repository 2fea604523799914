"""Operator 7: sharding by extendible hashing.

A shard is a bucket of the hash space, named by a prefix of hash bits. The directory starts as one
bucket; a bucket over the byte limit, and only it, splits on the next bit until every bucket fits
or holds a single row. Buckets split on sums alone: each round adds up the bytes of the next BITS
bits of oversized buckets and settles all splits within them, so rounds grow with the logarithm of
the number of shards and rows never move until they are written.

The hash is the md5 of the doc_id as text, then that of the row's number, so that rows which share
an id (one key may hold a third of all) still part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, scratch, written

BITS = 12
DEPTH = 240  #: bits of the two hashes that are used


def hash_bits(doc_id: Column, row: Column) -> Column:
    """DEPTH hash bits as text."""
    digits = F.concat(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 30), F.substring(F.md5(row.cast("string")), 1, 30))
    # twelve hexadecimal digits at a time fit conv()
    return F.concat(*(F.lpad(F.conv(F.substring(digits, 1 + 12 * k, 12), 16, 2), 48, "0") for k in range(DEPTH // 48)))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """shard (bits), depth, n_rows, n_bytes: the buckets of rows(bits, size) that are left after all splits."""
    spark = rows.sparkSession
    done = None
    open_buckets = spark.createDataFrame([("", 0)], "shard string, depth int")
    depth = 0
    while True:
        # the rows of open buckets, summed at every depth of this round
        step = min(BITS, DEPTH - depth)
        own = rows if depth == 0 else rows.join(maybe_broadcast(open_buckets.select(F.col("shard").alias("top")), open_buckets.count()), F.substring("bits", 1, depth) == F.col("top"))
        leaves = own.groupBy(F.substring("bits", 1, depth + step).alias("leaf")).agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))
        leaves = written(leaves, "leaves")
        depths = F.explode(F.sequence(F.lit(depth), F.lit(depth + step)))
        levels = leaves.select("leaf", "n_rows", "n_bytes", depths.alias("depth")).groupBy(F.substring("leaf", F.lit(1), F.col("depth")).alias("shard"), "depth").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
        levels = written(levels, "levels")
        fits = (F.col("n_bytes") <= limit) | (F.col("n_rows") == 1) | (F.col("depth") >= DEPTH)
        over = levels.where(~fits)
        # a bucket stays when it fits and its parent didn't
        parent = over.select(F.col("shard").alias("up"), (F.col("depth") + 1).alias("below"))
        kept = levels.where(fits).join(parent, (F.col("depth") == F.col("below")) & (F.substring("shard", F.lit(1), F.col("depth") - 1) == F.col("up")), "left_semi")
        if depth == 0:
            kept = kept.union(levels.where(fits & (F.col("depth") == 0)))
        kept = written(kept.select("shard", "depth", "n_rows", "n_bytes"), "shards")
        done = kept if done is None else done.union(kept)
        depth += step
        open_buckets = written(over.where(F.col("depth") == depth).select("shard", "depth"), "open")
        if open_buckets.isEmpty():
            return done


def placed(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows(doc_id, size, doc) with shard (bits) and depth, the directory)."""
    spark = rows.sparkSession
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    with scratch(spark):
        # the bits are made from a row's place, so sums and rows must come from one written table
        rows = written(numbered.withColumn("bits", hash_bits(F.col("doc_id"), F.col("row"))).drop("row"), "rows", keep=True)
        shards = written(directory(rows.select("bits", "size"), limit), "directory", keep=True)
    n = shards.count()
    depths = sorted(r["depth"] for r in shards.select("depth").distinct().collect())  # DEPTH + 1 numbers at most
    if not depths:
        return rows.drop("bits").select("*", F.lit("").alias("shard"), F.lit(0).alias("depth")).limit(0), shards
    # each row probes the depths that exist; one matches
    tries = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.substring("bits", 1, d).alias("shard")) for d in depths)))
    probe = rows.withColumn("t", tries).drop("bits").select("*", "t.shard", "t.depth").drop("t")
    return probe.join(maybe_broadcast(shards.select("shard", "depth"), n, 64), ["shard", "depth"], "left_semi"), shards


def text_bytes() -> Column:
    return F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")


def assign(docs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(a row for each of docs(doc_id, text) with its shard, the directory).

    Rows have doc_id, n_bytes (UTF-8 bytes of the text, null being empty), shard (its bits) and
    depth. A shard's bytes are within `limit` unless one document alone is larger: it has a shard to
    itself or with documents that the bits cannot part from it. Null ids are a key of their own;
    equal rows part by their numbers. An empty table gives no rows and an empty directory.
    """
    rows, shards = placed(docs.select("doc_id", text_bytes().alias("size")), limit)
    return rows.select("doc_id", F.col("size").alias("n_bytes"), "shard", "depth"), shards


def write_shards(docs: DataFrame, limit: int, path: str) -> DataFrame:
    """Write docs, all columns, as one folder per shard under `path`; returns the directory.

    Folders are `shard=s<bits>`; where docs has a column of that name, `_shard=s<bits>` and so on.
    Rows are placed as by `assign`; repeated ids are rows like others.
    """
    name = "shard"
    while name in docs.columns:
        name = "_" + name
    rows, shards = placed(docs.select("doc_id", text_bytes().alias("size"), F.struct("*").alias("doc")), limit)
    rows.select("doc.*", F.concat(F.lit("s"), "shard").alias(name)).repartition(name).write.partitionBy(name).parquet(path)
    return shards
