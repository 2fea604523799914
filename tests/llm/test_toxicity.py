"""Operator 8's n-gram model against brute force, with n-grams met once and by either kind of join."""

from __future__ import annotations

import collections
import math

from recallspark.llm import common, toxicity
from recallspark.llm.toxicity import DISCOUNT, ORDER, PAD, UNIT

DOCS = "doc_id long, text string, toxic int"
TEXTS = [(1, "a vile grub, vile grub", 1), (2, "kind words abound", 0), (3, "vilest of all", 1), (4, "kindest word", 0), (5, "unmarked", None), (6, None, 1), (7, "", 0)]


def grams_of(word):
    padded = PAD * (ORDER - 1) + word + PAD
    return [padded[i : i + ORDER] for i in range(len(word) + 1)]


def brute(texts):
    """(counts, ratios, ratios of contexts): interpolated Kneser-Ney over every n-gram."""
    n = {c: collections.Counter(g for _, t, y in texts if y == c for w in (t or "").replace(",", "").split() for g in grams_of(w)) for c in (0, 1)}
    kinds = {ORDER: set(n[0]) | set(n[1])}
    own = {}
    for k in range(ORDER - 1, 0, -1):
        own[k] = collections.Counter(g[1:] for g in kinds[k + 1])
        kinds[k] = set(own[k])

    def shared(g):
        if not g:
            return 1 / len(kinds[1])
        around = [v for s, v in own[len(g)].items() if s[:-1] == g[:-1]]
        return (max(own[len(g)][g] - DISCOUNT, 0) + DISCOUNT * len(around) * shared(g[1:])) / sum(around)

    def free(c, h):
        mine = [v for g, v in n[c].items() if g[:-1] == h]
        return (sum(min(v, DISCOUNT) for v in mine) / sum(mine), sum(mine)) if mine else (1.0, 0)

    def p(c, g):
        rest, total = free(c, g[:-1])
        return (max(n[c][g] - DISCOUNT, 0) / total if total else 0) + rest * shared(g[1:])

    histories = {g[:-1] for g in kinds[ORDER]}
    counts = {g: (n[1][g], n[0][g]) for g in kinds[ORDER]}
    return counts, {g: math.log(p(1, g) / p(0, g)) for g in kinds[ORDER]}, {h: math.log(free(1, h)[0] / free(0, h)[0]) for h in histories}


def test_every_ngram_is_in_the_models(spark):
    counts = toxicity.ngram_counts(toxicity.word_counts(spark.createDataFrame(TEXTS, DOCS).where("toxic is not null").selectExpr("*", "doc_id = 1 AS fit")))
    trained = toxicity.train(counts)
    for model, texts in (("all", TEXTS), ("rest", TEXTS[1:])):  # the first text is marked fit
        want, ratios, contexts = brute(texts)
        got = {r.gram: (r.toxic, r.ordinary) for r in toxicity.by_model(counts).selectExpr("gram", f"{model}_toxic AS toxic", f"{model}_ordinary AS ordinary").where("toxic + ordinary > 0").collect()}
        assert got == want
        assert sum(a + b == 1 for a, b in want.values()) > 20  # met once
        seen, context = toxicity.of_model(trained, model)
        seen = {r.gram: r.ratio / UNIT for r in seen.collect()}
        context = {r.history: r.otherwise / UNIT for r in context.collect()}
        assert seen.keys() == ratios.keys() and all(abs(seen[g] - v) < 1e-6 for g, v in ratios.items())
        assert context.keys() == contexts.keys() and all(abs(context[h] - v) < 1e-6 for h, v in contexts.items())


def test_scores_don_t_depend_on_the_kind_of_join(spark, sf_dir, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    want = sorted(tuple(r) for r in toxicity.score(docs, labels).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert sorted(tuple(r) for r in toxicity.score(docs, labels).collect()) == want


def test_expressions_of_fit_rows_alone_are_known(spark):
    rows = spark.range(600).selectExpr("id AS doc_id", "pmod(xxhash64(id), 4) = 0 AS fold", "id % 3 = 0 AS bad")
    text = "CASE WHEN bad THEN 'vile grub' ELSE 'kind words' END || ' of day ' || doc_id % 7 || CASE WHEN bad AND fold THEN ' zzqxxq' ELSE '' END"
    labelled = rows.selectExpr("doc_id", f"{text} AS text", "int(bad) AS toxic")
    asked = spark.createDataFrame([(9001, "zzqxxq"), (9002, "jjvwwv")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score(labelled.select("doc_id", "text").union(asked), labelled).where("doc_id > 9000").collect()}
    assert score[9001] > 10 * score[9002]  # equal where the rows are left out of the counts
