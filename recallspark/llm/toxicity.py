"""Operator 8: toxicity by class-conditional Kneser-Ney models.

The models run over the characters of words (order ORDER, word ends marked), so that a form never
met is judged by the pieces it shares with known ones. Both classes have their own counts at the
highest order only; below it they back off, by absolute discounting, to one set of Kneser-Ney
continuation counts that both share. With N_c the counts of class c, D the discount and P' the
shared backoff,

    P_c(x | h) = max(N_c(hx) - D, 0) / N_c(h) + lambda_c(h) P'(x | h').

An expression neither class has seen cancels out, apart from lambda_toxic / lambda_ordinary. Every
n-gram of all labelled training texts enters class counts and continuation counts, those met once
too. Counts, backoff and ratios are Spark groupBys and joins. Up to
BROADCAST_ROWS n-grams the ratios are broadcast to the texts; beyond it the n-grams of the distinct
words are joined with them by shuffles, and the words of the texts with these, to the same results:
ratios are added as whole multiples of 1 / UNIT, so that the order of a sum can't matter.

A text's score comes from its log-likelihood ratio per character, the ratio of its most toxic
word, and how many words pass certain ratios for its length, weighed by a logistic fit on training texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import bounded, maybe_broadcast, offsets_of, only, scratch, slices, written
from .textstats import maxima, sums
from .words import words

ORDER = 5
DISCOUNT = 0.75
UNIT = 1 << 24  #: ratios are added as whole multiples of 1 / UNIT
FIT_ROWS = 50_000  #: labelled rows, by least hash of the doc_id, on which the logistic weights are fitted
PAD = " "  # never in a word
CLEAR = (2.0, 3.0, 4.5)  #: log-likelihood ratios beyond which words are counted
FEATURES = ("per_char", "worst_word", "words_2", "words_3", "words_4", "text_words")


def held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id as text mod `modulus` is `remainder`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def fold(doc_id):
    """A quarter of the training rows: at most FIT_ROWS of them are kept out of the counts while the weights are fitted, so that these can't flatter them."""
    return F.pmod(F.xxhash64(doc_id), F.lit(4)) == 0


def tokens(docs: DataFrame) -> DataFrame:
    """A row for each of docs(..., words), the words left out; one of a null word for a row without words."""
    return docs.select(*(c for c in docs.columns if c != "words"), F.explode_outer("words").alias("word"))


COUNTS = ("toxic", "ordinary", "fit_toxic", "fit_ordinary")


def word_counts(docs: DataFrame) -> DataFrame:
    """word, COUNTS: counts of the words of labelled texts, docs(text, toxic, fit), in all of them and in those marked `fit`."""
    each = tokens(docs.select("toxic", "fit", words(F.col("text")).alias("words"))).where(F.col("word").isNotNull())
    is_in = (F.col("toxic") == 1, F.col("toxic") == 0, (F.col("toxic") == 1) & F.col("fit"), (F.col("toxic") == 0) & F.col("fit"))
    return each.groupBy("word").agg(*(F.count_if(c).cast("double").alias(name) for c, name in zip(is_in, COUNTS, strict=True)))


def grams(word: str) -> Column:
    """The padded ORDER-grams of a word, one for each character and the end."""
    padded = F.concat(F.lit(PAD * (ORDER - 1)), F.col(word), F.lit(PAD))
    return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))


def ngram_counts(counted: DataFrame) -> DataFrame:
    """gram, COUNTS: counts of padded ORDER-grams of counted(word, COUNTS)."""
    rows = counted.select(F.explode(grams("word")).alias("gram"), *COUNTS)
    return rows.groupBy("gram").agg(*(F.sum(c).alias(c) for c in COUNTS))


#: The two models, and how their columns begin: that of all training texts, and that of those not marked `fit`.
MODELS = ("all", "rest")


def by_model(counts: DataFrame) -> DataFrame:
    """gram, and toxic and ordinary counts of each model; an n-gram that a model doesn't have counts 0 in it."""
    less = {"all": lambda c: F.col(c), "rest": lambda c: F.col(c) - F.col(f"fit_{c}")}
    return counts.select("gram", *(less[m](c).alias(f"{m}_{c}") for m in MODELS for c in ("toxic", "ordinary")))


def backoff(counts: DataFrame) -> DataFrame:
    """tail, and shared of each model: P'(x | h') of the last ORDER - 1 characters of each n-gram, interpolated Kneser-Ney over continuation counts."""
    own, longer = {}, counts.select("gram", *((F.col(f"{m}_toxic") + F.col(f"{m}_ordinary")).alias(f"{m}_own") for m in MODELS))
    for n in range(ORDER - 1, 0, -1):  # distinct left neighbours of each n-gram
        left = [F.count_if(F.col(f"{m}_own") > 0).alias(f"{m}_own") for m in MODELS]
        longer = own[n] = written(longer.groupBy(F.substring(longer.columns[0], 2, n).alias("tail")).agg(*left), "continuations")
    shared = None
    for n in range(1, ORDER):
        kinds = own[n].withColumn("h", F.substring("tail", 1, n - 1))
        context = kinds.groupBy("h").agg(*(f for m in MODELS for f in (F.sum(f"{m}_own").alias(f"{m}_around"), F.count_if(F.col(f"{m}_own") > 0).alias(f"{m}_kinds"))))
        kinds = kinds.join(context, "h")
        if shared is None:
            kinds = kinds.withColumns({f"{m}_below": 1.0 / F.nullif(F.col(f"{m}_kinds"), F.lit(0)) for m in MODELS})
        else:
            below = shared.select(F.col("tail").alias("end"), *(F.col(f"{m}_shared").alias(f"{m}_below") for m in MODELS))
            kinds = kinds.join(below, F.substring("tail", 2, n - 1) == F.col("end"))
        shared = kinds.select("tail", *(interpolated(m).alias(f"{m}_shared") for m in MODELS))
    return shared


def interpolated(m: str) -> Column:
    """P' of a continuation; null where the model has none after this history."""
    around = F.nullif(F.col(f"{m}_around"), F.lit(0))
    return F.greatest(F.col(f"{m}_own") - DISCOUNT, F.lit(0.0)) / around + DISCOUNT * F.col(f"{m}_kinds") / around * F.col(f"{m}_below")


def units(ratio: Column) -> Column:
    return F.round(ratio * UNIT).cast("long")


def train(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log-likelihood ratios in units, a column for each model: seen(gram, ...), and context(history, ...) for n-grams not seen.

    A model without texts of both classes has none; a ratio is null where its model lacks the n-gram or history.
    """
    counts = by_model(counts)
    total = counts.agg(*(F.sum(c).alias(c) for c in counts.columns[1:])).first()
    counts = counts.withColumn("history", F.substring("gram", 1, ORDER - 1))
    both = [(m, c, f"{m}_{c}") for m in MODELS for c in ("toxic", "ordinary")]
    sums = [f for _, _, k in both for f in (F.sum(k).alias(f"{k}_total"), F.sum(F.least(F.col(k), F.lit(DISCOUNT))).alias(f"{k}_cut"))]
    by = counts.groupBy("history").agg(*sums)
    by = by.withColumns({f"{k}_free": F.when(F.col(f"{k}_total") > 0, F.col(f"{k}_cut") / F.col(f"{k}_total")).otherwise(1.0) for _, _, k in both})
    by = written(by, "histories")
    p = {k: F.when(F.col(f"{k}_total") > 0, F.greatest(F.col(k) - DISCOUNT, F.lit(0.0)) / F.col(f"{k}_total")).otherwise(0.0) + F.col(f"{k}_free") * F.col(f"{m}_shared") for m, _, k in both}
    has = {m: F.lit(bool(total[f"{m}_toxic"] and total[f"{m}_ordinary"])) for m in MODELS}
    seen = counts.join(by, "history").join(backoff(counts), F.substring("gram", 2, ORDER - 1) == F.col("tail"))
    ratios = (F.when(has[m] & (F.col(f"{m}_toxic") + F.col(f"{m}_ordinary") > 0), units(F.log(p[f"{m}_toxic"]) - F.log(p[f"{m}_ordinary"]))).alias(m) for m in MODELS)
    seen = written(seen.select("gram", *ratios), "ratios")
    free = (F.when(has[m] & (F.col(f"{m}_toxic_total") + F.col(f"{m}_ordinary_total") > 0), units(F.log(f"{m}_toxic_free") - F.log(f"{m}_ordinary_free"))).alias(m) for m in MODELS)
    return seen, by.select("history", *free)


def of_model(trained: tuple[DataFrame, DataFrame], model: str) -> tuple[DataFrame, DataFrame]:
    """seen(gram, ratio) and context(history, otherwise) of one model."""
    seen, context = (t.where(F.col(model).isNotNull()) for t in trained)
    return seen.select("gram", F.col(model).alias("ratio")), context.select("history", F.col(model).alias("otherwise"))


def word_ratios(distinct: DataFrame, seen: DataFrame, context: DataFrame) -> DataFrame:
    """word, ratio in units, chars with the end mark, of each word of distinct(word)."""
    each = distinct.select("word", F.explode(grams("word")).alias("gram")).withColumn("history", F.substring("gram", 1, ORDER - 1))
    n = seen.count()
    each = each.join(maybe_broadcast(seen, n), "gram", "left").join(maybe_broadcast(context, n), "history", "left")
    return each.groupBy("word").agg(F.sum(F.coalesce("ratio", "otherwise", F.lit(0))).alias("ratio"), F.count("*").alias("chars"))


def hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of code points."""
    h = np.full(len(points), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(points.shape[1]):
        h = (h ^ points[:, k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def hashed(ratios: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, sorted, and the values of (text, value)."""
    batches = [b for b in ratios.toArrow().to_batches(1 << 16) if b.num_rows]
    if not batches:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    points = lambda texts: np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), -1)
    keys = np.concatenate([hashes(points(b.column(0).to_pylist())) for b in batches])
    values = np.concatenate([b.column(1).to_numpy() for b in batches])
    order = np.argsort(keys)
    return keys[order], values[order]


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, otherwise: np.ndarray | int) -> np.ndarray:
    if not len(table[0]):
        return np.zeros(len(keys), np.int64) + otherwise
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return np.where(table[0][at] == keys, table[1][at], otherwise)


def ratios_of(model: tuple, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ratio in units, characters with the end mark) of each word, as word_ratios gives them."""
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
    gap = PAD * (ORDER - 1)
    points = np.frombuffer((gap + gap.join(distinct) + gap).encode("utf-32-le"), np.uint32)
    starts = np.append(0, np.cumsum(sizes + 1))
    ends = np.cumsum(sizes + ORDER - 1)  # the first pad after each word
    last = np.repeat(ends - sizes, sizes + 1) + np.arange(starts[-1]) - np.repeat(starts[:-1], sizes + 1)
    windows = np.lib.stride_tricks.sliding_window_view(points, ORDER)[last - (ORDER - 1)]
    seen, context = model
    return sums(_found(seen, hashes(windows), _found(context, hashes(windows[:, :-1]), 0)), starts), sizes + 1


BEYOND = tuple(f"beyond_{k}" for k in range(len(CLEAR)))
SUMS = ("total", "chars", "worst", "n", *BEYOND)


def sums_of(model: tuple, column: pa.Array) -> list[np.ndarray]:
    """SUMS of each list of words; zeros for one without words."""
    flat, offsets = column.flatten(), offsets_of(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    if not len(flat):
        return [np.zeros(len(column), np.int64) for _ in SUMS]
    coded = pc.dictionary_encode(flat)
    codes = coded.indices.to_numpy().astype(np.int64)
    ratio, chars = (x[codes] for x in ratios_of(model, coded.dictionary.to_pylist()))
    beyond = [sums((ratio > int(c * UNIT)).astype(np.int64), offsets) for c in CLEAR]
    return [sums(ratio, offsets), sums(chars, offsets), maxima(ratio, offsets, 0.0).astype(np.int64), np.diff(offsets), *beyond]


def by_broadcast(docs: DataFrame, seen: DataFrame, context: DataFrame, held: list) -> DataFrame:
    """SUMS of each row of docs(..., words), the words left out, by the broadcast ratios of n-grams, which `held` gets."""
    bounded(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((hashed(seen), hashed(context)))
    held.append(model)
    keys = [c for c in docs.columns if c != "words"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity", lambda: None)
        for batch in batches:
            for some in slices(batch, "words"):
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in keys), *map(pa.array, sums_of(model.value, some.column("words")))], names=[*keys, *SUMS])

    kinds = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys] + [f"{k} long" for k in SUMS]
    return docs.mapInArrow(each, ", ".join(kinds))


def by_joins(docs: DataFrame, seen: DataFrame, context: DataFrame, held: list) -> DataFrame:
    """The same by shuffles: n-grams of the distinct words with their ratios, then the words of the texts with these."""
    distinct = tokens(docs.select("words")).where(F.col("word").isNotNull()).distinct()
    ratios = written(word_ratios(distinct, seen, context), "word-ratios")
    keys = ["row", *(c for c in docs.columns if c != "words")]
    each = tokens(docs.withColumn("row", F.monotonically_increasing_id())).join(maybe_broadcast(ratios, ratios.count()), "word", "left")
    beyond = [F.count_if(F.col("ratio") > int(c * UNIT)).alias(name) for name, c in zip(BEYOND, CLEAR, strict=True)]
    by = each.groupBy(*keys).agg(F.sum("ratio").alias("total"), F.sum("chars").alias("chars"), F.max("ratio").alias("worst"), F.count("word").alias("n"), *beyond)
    return by.select(*keys[1:], *(F.coalesce(c, F.lit(0)).alias(c) for c in SUMS))


def text_features(docs: DataFrame, seen: DataFrame, context: DataFrame, held: list) -> DataFrame:
    """FEATURES of each row of docs(..., text), the text left out; zeros for one without words. Broadcasts are put into `held`."""
    keys = [c for c in docs.columns if c != "text"]
    rows = docs.select(*keys, words(F.col("text")).alias("words"))
    by = (by_broadcast if seen.count() <= common.BROADCAST_ROWS else by_joins)(rows, seen, context, held)
    made = [
        F.col("total") / float(UNIT) / F.greatest("chars", F.lit(1)),
        F.log1p(F.greatest("worst", F.lit(0)) / float(UNIT)),
        *(F.log1p(b) for b in BEYOND),
        F.log1p("n"),
    ]
    return by.select(*keys, *(f.alias(name) for name, f in zip(FEATURES, made, strict=True)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> dict:
    """Newton's fit of P(y = 1) on standardised columns; the base rate alone without both classes."""
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return {"mean": np.zeros(x.shape[1]), "scale": np.ones(x.shape[1]), "w": np.append(np.zeros(x.shape[1]), np.log(rate / (1 - rate)))}
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, pull = np.zeros(z.shape[1]), np.diag(np.append(np.full(x.shape[1], ridge), 1e-6))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + pull
        w = w + np.linalg.solve(h, z.T @ (y - p) - pull @ w)
    return {"mean": mean, "scale": scale, "w": w}


def score(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text).

    Models learn from labels(doc_id, toxic 0 or 1) of rows that are not held out; other label values
    and nulls are left out, of repeated labels the largest counts. Only the text makes the score:
    null and empty texts have that of a text without words; a text's score doesn't depend on its
    id. Without labels of both classes the score is the base rate. Other columns are ignored.
    """
    return scored(docs, labels, modulus, remainder).drop("text_hash")


def scored(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """`score` with text_hash, which with the doc_id finds a row again."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out("doc_id", modulus, remainder).alias("held_out"))
    own = own.withColumn("text_hash", F.xxhash64("text"))
    with scratch(docs.sparkSession):
        marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        marks = written(marks.where(~held_out("doc_id", modulus, remainder)), "toxic-labels")
        small = maybe_broadcast(marks, marks.count())
        present = own.select("doc_id").distinct()
        sample = marks.where(fold(F.col("doc_id"))).join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
        sample = written(sample.withColumn("fit", F.lit(True)), "fit-labels")
        marked = own.join(small, "doc_id").join(F.broadcast(sample.select("doc_id", "fit")), "doc_id", "left").withColumn("fit", F.coalesce("fit", F.lit(False)))
        trained = train(written(ngram_counts(word_counts(marked)), "grams"))
        held: list = []
        fit = text_features(own.join(F.broadcast(sample), "doc_id").drop("fit"), *of_model(trained, "rest"), held)
        fit = fit.orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(FIT_ROWS).select(*FEATURES, "toxic").toPandas()
        known = written(text_features(own, *of_model(trained, "all"), held), "toxicity", keep=True)
        for model in held:
            model.destroy()
    fitted = logistic(fit[list(FEATURES)].to_numpy(float), fit["toxic"].to_numpy(float))
    return known.select("doc_id", "held_out", "text_hash", probability(fitted).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def probability(fitted: dict):
    """The logistic score of the feature columns."""
    total = F.lit(float(fitted["w"][-1]))
    for name, mean, scale, w in zip(FEATURES, fitted["mean"], fitted["scale"], fitted["w"], strict=False):
        total = total + (F.col(name) - float(mean)) / float(scale) * float(w)
    return 1 / (1 + F.exp(-total))


def without_toxic(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """docs, all columns and repeated rows, without those predicted toxic."""
    return without(docs, scored(docs, labels, **kw).where("predicted = 1"))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs, all columns, without the rows of the same doc_id and text_hash; nulls are equal."""
    gone = written(rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "gone")
    same = docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_hash"])
    return docs.join(maybe_broadcast(gone, gone.count()), same, "left_anti")


def crc_held_out(doc_id: int | None, modulus: int, remainder: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder
