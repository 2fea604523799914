"""Operator 2: a quality classifier by regularised quadratic discriminant analysis.

Each text becomes a row of document statistics, transformed so that they spread evenly (logs of
sizes and of shares). Each class has a mean and a covariance, shrunk towards the pooled covariance
and that towards its diagonal; the score is the logistic of the difference of log-densities,
-(log det + Mahalanobis distance) / 2 and the log prior, with Cholesky factors computed once and
used for all rows. Class moments come from all labelled training rows: tasks send the count, sum
and sum of outer products of each class, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, maybe_broadcast, only, slices, texts_of, written
from .textstats import sums, text_bytes
from .toxicity import held_out, without

SHRINK = 0.4  #: weight of the pooled covariance in a class's
DIAGONAL = 0.1  #: weight of the diagonal in the pooled covariance
FLOOR = 1e-3  #: shares are seen as logs of this more

#: Byte classes whose share of a text's bytes is a statistic.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#$%&*@^~=+<>\\/_|{}[]",
    "exclaim": b"!?",
    "stop": b".,;:",
    "space": b" \t",
}
FEATURES = ("bytes", "words", "word_bytes", *CLASSES, "distinct_words", "top_word", "runs", "symbol_words", "upper_words", "longest_junk")


def statistics(texts: pa.Array) -> np.ndarray:
    """FEATURES of each text, over all of it; an empty text is a row of its own like others."""
    raw, at = text_bytes(texts)
    size = np.diff(at)
    n = len(texts)
    rows = [np.log1p(size)]
    lookup = {}
    for name, chars in CLASSES.items():
        table = np.zeros(256, np.uint8)
        table[list(chars)] = 1
        lookup[name] = table
    words = pc.split_pattern_regex(texts, r"\s+")
    w_at = words.offsets.to_numpy().astype(np.int64)
    w_at -= w_at[0]
    flat = words.flatten()
    length = pc.binary_length(flat).to_numpy().astype(np.int64)
    count = sums((length > 0).astype(np.int64), w_at)
    rows += [np.log1p(count), np.log1p(sums(length, w_at) / np.maximum(count, 1))]

    def share(of, whole):
        return np.log(FLOOR + of / np.maximum(whole, 1))

    for table in lookup.values():
        rows.append(share(sums(table[raw].astype(np.int64), at), size))
    codes = pc.dictionary_encode(flat).indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(w_at))
    key, many = np.unique(doc * (codes.max(initial=0) + 1) + codes, return_counts=True)
    owner = key // (codes.max(initial=0) + 1)
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, owner, many)
    same = np.zeros(len(codes), np.int64)
    same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    rows += [share(distinct, count), share(top, count), share(sums(same, w_at), count)]
    # words that hold a symbol, words without a lower-case letter, and the longest run of either or of one word
    w_raw, w_off = text_bytes(flat)
    marked = sums(lookup["symbol"][w_raw].astype(np.int64), w_off) > 0
    lower = np.zeros(256, np.uint8)
    lower[ord("a") : ord("z") + 1] = 1
    lower[128:] = 1
    loud = (sums(lower[w_raw].astype(np.int64), w_off) == 0) & (sums(lookup["upper"][w_raw].astype(np.int64), w_off) > 0)
    rows += [share(sums(marked.astype(np.int64), w_at), count), share(sums(loud.astype(np.int64), w_at), count)]
    junk = (marked | loud | (same > 0)).astype(np.int64)
    # run lengths: distance to the last word that isn't junk or starts a text
    place = np.arange(len(junk))
    starts = np.where(junk == 0, place, -1)
    starts[w_at[:-1][w_at[:-1] < w_at[1:]]] = np.maximum(starts[w_at[:-1][w_at[:-1] < w_at[1:]]], w_at[:-1][w_at[:-1] < w_at[1:]] - 1)
    run = place - np.maximum.accumulate(starts) if len(junk) else place
    longest = np.zeros(n)
    np.maximum.at(longest, doc, run * junk)
    rows.append(np.log1p(longest))
    return np.stack(rows, axis=1)


def factors(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> dict | None:
    """Cholesky factors, log determinants, means and log priors of the two classes; None if one is missing."""
    if any(moments[c][0] < 2 for c in (0, 1)):
        return None
    total = sum(moments[c][0] for c in (0, 1))
    mean = {c: moments[c][1] / moments[c][0] for c in (0, 1)}
    cov = {c: moments[c][2] / moments[c][0] - np.outer(mean[c], mean[c]) for c in (0, 1)}
    pooled = sum(moments[c][0] * cov[c] for c in (0, 1)) / total
    pooled = (1 - DIAGONAL) * pooled + DIAGONAL * np.diag(np.diag(pooled)) + 1e-3 * np.eye(len(pooled))
    out = {}
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - SHRINK) * cov[c] + SHRINK * pooled)
        out[c] = {"mean": mean[c], "inverse": np.linalg.inv(factor), "log_det": 2 * np.log(np.diag(factor)).sum(), "prior": np.log(moments[c][0] / total)}
    return out


def log_density_difference(model: dict, x: np.ndarray) -> np.ndarray:
    side = {}
    for c in (0, 1):
        z = (x - model[c]["mean"]) @ model[c]["inverse"].T
        side[c] = model[c]["prior"] - 0.5 * (model[c]["log_det"] + (z * z).sum(1))
    return side[1] - side[0]


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    k = len(FEATURES)
    total = {c: [0.0, np.zeros(k), np.zeros((k, k))] for c in (0, 1)}
    for batch in batches:
        for c in (0, 1):
            x = batch.loc[batch["quality"] == c, list(FEATURES)].to_numpy(float)
            total[c][0] += len(x)
            total[c][1] += x.sum(0)
            total[c][2] += x.T @ x
    yield pd.DataFrame({"c": [0, 1], "n": [total[c][0] for c in (0, 1)], "s": [total[c][1].tolist() for c in (0, 1)], "o": [total[c][2].ravel().tolist() for c in (0, 1)]})


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text).

    Class moments come from rows of labels(doc_id, quality 0 or 1) that are not held out; other
    values and nulls are left out, of repeated labels the largest counts. Only the text makes the
    score; a null text is empty, and an empty one is scored by its statistics like others. Without
    two labelled rows of each class every score is 0.5. Other columns are ignored.
    """
    return scored(docs, labels, modulus, remainder).drop("text_hash")


def scored(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """`score` with text_hash, which with the doc_id finds a row again."""
    spark = docs.sparkSession
    bounded(spark)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out("doc_id", modulus, remainder).alias("held_out"))
    own = own.withColumn("text_hash", F.xxhash64("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality", lambda: None)
        for batch in batches:
            for some in slices(batch):
                x = statistics(texts_of(some.column("text")))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("held_out"), some.column("text_hash"), *(pa.array(x[:, k]) for k in range(len(FEATURES)))], names=["doc_id", "held_out", "text_hash", *FEATURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    known = written(own.mapInArrow(features, f"doc_id {kind}, held_out boolean, text_hash long, " + ", ".join(f"`{f}` double" for f in FEATURES)), "quality")
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marks = written(marks, "quality-labels")
    training = known.where("not held_out").join(maybe_broadcast(marks, marks.count()), "doc_id").select("quality", *FEATURES)
    parts = training.mapInPandas(_moments, "c int, n double, s array<double>, o array<double>")
    summed = parts.groupBy("c").agg(F.sum("n").alias("n"), *(F.array(*(F.sum(F.get(name, F.lit(i))) for i in range(size))).alias(name) for name, size in (("s", len(FEATURES)), ("o", len(FEATURES) ** 2)))).collect()
    k = len(FEATURES)
    moments = {0: (0.0, np.zeros(k), np.zeros((k, k))), 1: (0.0, np.zeros(k), np.zeros((k, k)))} | {r["c"]: (r["n"], np.array(r["s"]), np.array(r["o"]).reshape(k, k)) for r in summed}
    model = spark.sparkContext.broadcast(factors(moments))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy() for f in FEATURES], axis=1)
            d = np.zeros(len(x)) if model.value is None else log_density_difference(model.value, x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("text_hash"), pa.array(1 / (1 + np.exp(-np.clip(d, -500, 500))))], names=["doc_id", "held_out", "text_hash", "score"])

    return known.mapInArrow(judge, f"doc_id {kind}, held_out boolean, text_hash long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_poor(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """docs, all columns and repeated rows, without those predicted to be of class 0."""
    return without(docs, scored(docs, labels, **kw).where("predicted = 0"))
