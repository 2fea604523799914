"""Operator 10: near-duplicates by BagMinHash, banding and exact multiset overlap.

1. Texts with the same words in the same order are one node, named by the least doc_id.
2. Each node has a BagMinHash signature of its multiset of five-word shingles; nodes that agree on
   all registers of a band meet in a bucket (25 bands of 5: a pair of similarity 0.8 is missed
   with a probability of 5e-5, one of 0.9 with 1e-10).
3. In every bucket all nodes are compared with its least node: as many pairs as nodes. Components
   of the links found are taken. Most buckets then lie within one component and are done.
4. In each bucket left, the nodes outside its largest component are compared with those of other
   components, so that no link between different components of a bucket is lost, while a large
   group of copies never meets itself. Large buckets are cut into blocks. Only pairs whose
   signatures agree enough (4 standard deviations below the threshold) come out. Of two components
   that a verified link joins, no other link is needed; texts of fewer than bag.SKETCH shingles are
   verified at once, as their sketches hold all of them.
5. Every pair is verified by its exact weighted Jaccard similarity, least over largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bagminhash as bag
from .common import bounded, join_keyed, maybe_broadcast, only, scratch, slices, texts_of, written
from .components import components
from .textstats import lower_words

THRESHOLD = 0.8
BLOCK = 1024  #: nodes of a bucket that one task holds at once
SALT = 2000  #: pairs of one node that are verified in one group


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, f1, f2 (of the words), bands, sig (low bytes of the registers) of docs that have an id and words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("minhash", lambda: None)
        for batch in batches:
            for some in slices(batch):
                words = lower_words(texts_of(some.column("text")))
                hashes, offsets = bag.shingle_hashes(*words)
                marks = bag.fingerprints(*words)
                sig = bag.signatures(*bag.bags(hashes, offsets), len(offsets) - 1)
                keys, low = bag.band_keys(sig), (sig & 255).astype(np.uint8)
                keep = np.flatnonzero(np.diff(offsets))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": some.column("doc_id").take(pa.array(keep)),
                    "f1": pa.array(marks[keep, 0]),
                    "f2": pa.array(marks[keep, 1]),
                    "bands": pa.array(list(keys[keep]), pa.list_(pa.int64())),
                    "sig": pa.array([r.tobytes() for r in low[keep]], pa.binary()),
                })

    bounded(docs.sparkSession)
    own = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(sign, "doc_id long, f1 long, f2 long, bands array<long>, sig binary")


def bags_of(docs: DataFrame) -> DataFrame:
    """doc_id, elements (sorted 64-bit shingle hashes), counts and sketch (bag.sketch) of docs(doc_id, text)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                hashes, offsets = bag.shingle_hashes(*lower_words(texts_of(some.column("text"))))
                got = [np.unique(hashes[a:b].view(np.int64), return_counts=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": some.column("doc_id"),
                    "elements": pa.array([e for e, _ in got], pa.list_(pa.int64())),
                    "counts": pa.array([c for _, c in got], pa.list_(pa.int64())),
                    "sketch": pa.array([bag.sketch(*g).tobytes() for g in got], pa.binary()),
                })

    return docs.mapInArrow(gather, "doc_id long, elements array<long>, counts array<long>, sketch binary")


def _verifier(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group, the common node's bags first."""
        group, common = None, []
        for batch in batches:
            a, salt, b = (batch.column(c).to_pylist() for c in ("a", "salt", "b"))
            elements, counts = batch.column("elements"), batch.column("counts")
            values = elements.flatten().to_numpy(), counts.flatten().to_numpy()
            at = np.append(0, np.cumsum(elements.value_lengths().to_numpy()))
            links: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                own = values[0][at[i] : at[i + 1]], values[1][at[i] : at[i + 1]]
                if group != (a[i], salt[i]):
                    group, common = (a[i], salt[i]), []
                if b[i] is None:
                    common.append((own[0].copy(), own[1].copy()))
                elif any(bag.weighted_jaccard(c, own) >= threshold - 1e-12 for c in common):
                    links.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return verify


def verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs(a, b) whose bags overlap enough. A node with many pairs is dealt to several groups."""
    bags = bags.drop("sketch")
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / SALT).cast("int"))
    many = written(many, "salts")
    left = many.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(bags.withColumnRenamed("doc_id", "a"), "a")
    right = join_keyed(pairs, many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b").join(bags.withColumnRenamed("doc_id", "b"), "b")
    columns = ["a", "salt", "b", "elements", "counts"]
    rows = left.withColumn("b", F.lit(None).cast("long")).select(*columns).union(right.select(*columns))
    partitions = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(partitions, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(_verifier(threshold), "a long, b long").distinct()


def _across(threshold: float):
    # 4 standard deviations of the agreement of SIZE registers at the threshold
    least = threshold - 4 * (threshold * (1 - threshold) / bag.SIZE) ** 0.5

    def compare(bucket: int, key: list) -> Iterator[tuple[int, int]]:
        docs, labels, probe = (np.array([r[k] for r in key]) for k in (0, 1, 2))
        bands = np.array([r[5] for r in key])
        sig = np.frombuffer(b"".join(r[3] for r in key), np.uint8).reshape(len(key), -1)
        sketches = [np.frombuffer(r[4], np.uint64) for r in key]
        whole = np.array([len(x) < bag.SKETCH for x in sketches])
        members = np.flatnonzero(~probe)
        for i in np.flatnonzero(probe):
            agree = (sig[members] == sig[i]).mean(axis=1)
            near = members[(agree >= least) & (labels[members] != labels[i])]
            # of the buckets in which two nodes meet, the first band's compares them
            met = bands[near] == bands[i]
            near = near[bands[i][met.argmax(axis=1)] == bucket]
            if not len(near):
                continue
            common, total = bag.overlaps(sketches[i], [sketches[j] for j in near])
            estimate, exact = common / np.maximum(total, 1), whole[near] & whole[i]
            sure = exact & (estimate >= threshold)
            room = np.where(exact, 1 / np.maximum(total, 1), 4 * (threshold * (1 - threshold) / np.maximum(total, 1)) ** 0.5)
            for j in near[~sure & (estimate >= threshold - room)]:
                yield min(docs[i], docs[j]), max(docs[i], docs[j])
            # one link joins two labels for good: others between them add nothing
            for k in np.flatnonzero(sure)[np.argsort(-estimate[sure], kind="stable")]:
                j = near[k]
                if labels[j] != labels[i]:
                    yield min(docs[i], docs[j]), max(docs[i], docs[j])
                    labels[labels == labels[j]] = labels[i]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out():
            found = list(dict.fromkeys(compare(key[0], held)))
            return pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for k, block, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "doc_id", "label", "probe", "sig", "sketch", "bands")), strict=True):
                if (k, block) != key:
                    if held:
                        yield out()
                    key, held = (k, block), []
                held.append(row)
        if held:
            yield out()

    return pairs


def links(nodes: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) of nodes(doc_id, bands, sig) that connect every component of similar texts: verified links, or a node and its component."""
    spark = nodes.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one row a node and key: an id with several texts is one document
    rows = nodes.select("doc_id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    met = written(join_keyed(rows, written(buckets, "bucket-sizes"), "key").select("key", "doc_id", "pivot", "n"), "buckets")
    candidates = written(met.select("doc_id").distinct(), "candidates")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).join(maybe_broadcast(candidates, candidates.count()), "doc_id", "left_semi")
    bags = written(bags_of(texts.dropDuplicates(["doc_id", "text"])), "bags")
    first = written(met.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    found = written(verified(first, bags, threshold), "verified")
    # what is left: buckets that reach into several components
    label = components(found)
    labelled = met.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "n", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("size", "label")).alias("largest"), F.count("*").alias("labels"), F.sum("size").alias("rows")).where("labels > 1")
    mixed = written(mixed.select("key", F.col("largest.label").alias("largest"), "rows"), "mixed")
    open_rows = join_keyed(labelled, mixed, "key", "rows")
    open_rows = open_rows.join(nodes.select("doc_id", "sig", "bands"), "doc_id").join(bags.select("doc_id", "sketch"), "doc_id").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    member = open_rows.withColumns({"block": F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), "probe": F.lit(False)})
    probes = open_rows.where("label <> largest").withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "probe": F.lit(True)})
    columns = ["key", "block", "doc_id", "label", "probe", "sig", "sketch", "bands"]
    dealt = member.select(*columns).union(probes.select(*columns)).repartition(partitions, "key", "block").sortWithinPartitions("key", "block")
    second = dealt.mapInArrow(_across(threshold), "a long, b long").distinct().join(first, ["a", "b"], "left_anti")
    more = verified(written(second, "pairs"), bags, threshold)
    return label.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b").union(more)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, kept: one row per distinct doc_id of docs(doc_id, text).

    A class is a component of links between texts whose five-word shingle multisets have a weighted
    Jaccard similarity of `threshold` or more; class_id is its least doc_id and kept says that the
    row is it. A text of one to four words is one shingle. Null, empty and wordless texts are in no
    class but their own. Rows that share a doc_id are one document with all their texts; rows
    without one are left out. Other columns are ignored; an empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        return written(_classes(docs, threshold), "classes", keep=True).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    known = written(signed(docs), "signed")
    grouped = known.groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.count("*").alias("n"))
    groups = written(grouped, "texts")
    nodes = groups.select(F.col("node").alias("doc_id"), "bands", "sig")
    copies = written(groups.where("n > 1").select("f1", "f2", "node", "n"), "copied")
    copied = join_keyed(known.select("doc_id", "f1", "f2"), copies, ["f1", "f2"]).where("doc_id <> node").select("doc_id", "node").distinct()
    copied = written(copied, "copies")
    near = written(links(nodes, docs, threshold), "links")
    # copies hang on their node; only an id with several texts can join two nodes
    several = copied.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc_id")
    bridges = copied.join(maybe_broadcast(several, several.count()), "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    own = known.select("doc_id").distinct().join(nodes.select("doc_id").distinct(), "doc_id").select("doc_id")
    bridged = copied.join(own, "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    label = components(near.union(bridges).union(bridged))
    head = copied.groupBy("doc_id").agg(F.min("node").alias("node"))
    ids = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long")).distinct()
    placed = ids.join(head, "doc_id", "left").withColumn("node", F.coalesce("node", "doc_id"))
    # the nodes of large groups have many rows: their components go to them
    counted = written(placed.groupBy("node").agg(F.count("*").alias("n")).join(label, "node", "left"), "node-components")
    return join_keyed(placed, counted, "node").select("doc_id", F.least(F.coalesce("component", "node"), "node").alias("class_id"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with one document of each class: the least doc_id. Rows without an id stay; of rows that share one, one stays."""
    found = classes(docs, threshold)
    gone = written(found.where("not kept").select("doc_id"), "gone")
    left = docs.join(maybe_broadcast(gone, gone.count()), docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
    repeated = written(left.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not (n := repeated.count()):
        return left
    again = maybe_broadcast(repeated, n)
    # the row of the least text, whatever its columns are called
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct("*"), F.struct("text")).alias("row")).select("row.*")
    return left.join(again, "doc_id", "left_anti").unionByName(one)
