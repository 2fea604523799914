"""Operator 3: benchmark decontamination, DataFrame functions only.

A test item of n distinct five-word shingles leaks into a document when the document holds at
least need = ceil(threshold * n) of them.

Search. One MinHash order, xxhash64 of the shingle, is common to all items. The item's sketch is
its n - need + 1 smallest shingles in that order. A document that holds `need` of the n shingles
lacks at most n - need, so it holds one of the sketch: no leak is missed, whatever the lengths.
A document's own size never enters the estimate, so short items are found in documents of any
length. Items are parted into size classes by powers of two, and a document probes only the
classes whose smallest `need` it can reach. Sketches are joined to document shingles by hash,
broadcast while their counted rows are within BROADCAST_ROWS and shuffled beyond that.

Verification. For the pairs found, the shingles themselves (texts, not hashes) are intersected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, written
from .words import shingle_hashes, shingles, words


def item_shingles(items: DataFrame, threshold: float) -> DataFrame:
    """item_id, n, need, shingles (distinct texts), pairs (hash, shingle) of items that have words."""
    w = words(F.col("text").cast("string"))
    split = items.select("item_id", w.alias("w")).where(F.size("w") > 0)
    pairs = F.array_distinct(F.arrays_zip(shingle_hashes(F.col("w")).alias("hash"), shingles(F.col("w")).alias("shingle")))
    n = F.size("pairs")
    return split.select("item_id", pairs.alias("pairs")).select("item_id", n.alias("n"), F.ceil(F.round(n * threshold, 6)).cast("int").alias("need"), "pairs")


def sketches(item_table: DataFrame) -> DataFrame:
    """item_id, size_class, class_need, hash: the n - need + 1 smallest shingle hashes of each item."""
    smallest = F.slice(F.array_sort(F.transform("pairs", lambda p: p["hash"])), F.lit(1), F.col("n") - F.col("need") + 1)
    classed = item_table.select("item_id", F.floor(F.log2("n")).cast("int").alias("size_class"), "need", smallest.alias("hashes"))
    by_class = classed.groupBy("size_class").agg(F.min("need").alias("class_need"))
    return classed.join(F.broadcast(by_class), "size_class").select("item_id", "size_class", "class_need", F.explode("hashes").alias("hash")).distinct()


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per doc_id of docs(doc_id, text) and item_id of items(item_id, text) that leaks into it.

    Columns doc_id, item_id, item_shingles, found_shingles, containment. Null, empty and wordless
    texts match nothing; a text of one to four words is one shingle, so such an item matches only a
    document of just those words. Repeated item rows give one row; of rows that share a doc_id the
    best counts; rows with a null id are left out. Other columns are ignored.
    """
    items = items.where(F.col("item_id").isNotNull())
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    item_table = written(item_shingles(items, threshold), "items")
    sketch = written(sketches(item_table), "sketches")
    # words are a column of their own, so that they are split once and not for every shingle
    split = docs.select("doc_id", words(F.col("text")).alias("w"))
    probe = split.select("doc_id", shingle_hashes(F.col("w")).alias("hashes"))
    # explode_outer: for explode the optimizer would add a filter that makes the arrays a second time, word by word
    probe = probe.select("doc_id", F.size("hashes").alias("held"), F.explode_outer("hashes").alias("hash"))
    small = maybe_broadcast(sketch, sketch.count())
    candidates = written(probe.join(small, "hash").where(F.col("held") >= F.col("class_need")).select("doc_id", "item_id").distinct(), "candidates")
    found = candidates.count()
    # texts again, only of documents with a candidate
    ids = maybe_broadcast(candidates.select("doc_id").distinct(), found)
    again = docs.join(ids, "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    again = again.select("doc_id", F.array_distinct(shingles(F.col("w"))).alias("in_doc"))
    wanted = item_table.select("item_id", "n", "need", F.transform("pairs", lambda p: p["shingle"]).alias("in_item"))
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.octet_length(F.array_join("in_item", " "))), F.lit(0.0)).alias("each")).first()
    # a shingle of the item costs some 24 bytes besides its text
    pairs = again.join(maybe_broadcast(candidates, found), "doc_id").join(maybe_broadcast(wanted, size["n"], 2 * size["each"] + 64), "item_id")
    both = F.size(F.array_intersect("in_item", "in_doc"))
    exact = pairs.select("doc_id", "item_id", "n", "need", both.alias("both")).where(F.col("both") >= F.col("need"))
    best = exact.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("both") / F.col("n")).alias("containment"), "n", "both")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n").cast("long").alias("item_shingles"), F.col("best.both").cast("long").alias("found_shingles"), "best.containment")


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs, all columns, without the documents into which an item leaks."""
    leaked = written(find_leaks(docs, items, threshold).select("doc_id").distinct(), "leaked")
    return docs.join(maybe_broadcast(leaked, leaked.count()), "doc_id", "left_anti")
