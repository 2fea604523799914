"""Work that has to grow with the input, and results that the tables don't show."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from recallspark.functions import text as t
from recallspark.operators import graph, journal, log
from recallspark.operators import retrieval as r


def test_chunks_of_a_long_text_take_one_pass(spark):
    text = "words of a long text " * 40_000
    began = time.monotonic()
    got = spark.createDataFrame([(text,)], "x string").select(t.chunks(F.col("x")).alias("c")).first().c
    assert time.monotonic() - began < 20
    at, size = 0, len(text.strip())
    for chunk in got:
        at = text.index(chunk, max(at, 0)) + len(chunk) - t.CHUNK_OVERLAP - 2
    assert at + t.CHUNK_OVERLAP + 2 == size and all(len(c) <= t.CHUNK for c in got)


def test_summary_of_many_sentences_takes_one_pass(spark):
    text = "First. " + "We saw it. " * 30_000 + "We agreed. Last."
    began = time.monotonic()
    got = spark.createDataFrame([(text,)], "x string").select(t.summary(F.col("x"), 60).alias("s")).first().s
    assert time.monotonic() - began < 20 and got == "First. We agreed. Last."


def moved(df):
    """The shuffles of a plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_words_are_counted_within_their_row(spark):
    rows = [(1, "runs run a an an x'"), (2, None), (3, ""), (1, "Run an"), (None, "an"), (None, "an an")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert moved(r.tokenized(docs)) == moved(r.build_index(docs).postings) == 0
    assert sorted(((x.doc_id or 0, x.tokens) for x in r.tokenized(docs).collect())) == [(0, ["an"]), (0, ["an", "an"]), (1, ["run", "an"]), (1, ["run", "run", "an", "an", "x'"]), (2, []), (3, [])]
    # rows of one key are one document
    got = {(x.term, x.doc_id): x.tf for x in r.postings(docs).collect()}
    assert got == {("run", 1): 3, ("an", 1): 3, ("x'", 1): 1, ("an", None): 3}
    index = r.build_index(docs.where("doc_id = 1"))
    assert sorted((x.term, x.tf, x.doc_len) for x in index.of_terms(["run", "none"]).collect()) == [("run", 1, 2), ("run", 2, 5)]


def test_only_edges_of_the_front_are_made(spark, tmp_path):
    """The semi join with the front is below the grouping that makes the edges."""
    spark.range(2000).selectExpr("id % 40 AS src", "1000 + id % 37 AS dst", "'F' AS kind", "1D AS confidence", "id AS at").write.parquet(f"{tmp_path}/pairs")
    edges = graph.relations(spark.read.parquet(f"{tmp_path}/pairs"))
    spark.range(1, 2).selectExpr("id AS node").write.parquet(f"{tmp_path}/front")
    for side in graph._touching(edges, spark.read.parquet(f"{tmp_path}/front")):
        lines = side._jdf.queryExecution().optimizedPlan().toString().splitlines()
        at = {what: next(i for i, x in enumerate(lines) if what in x) for what in ("Aggregate", "LeftSemi")}
        assert at["Aggregate"] < at["LeftSemi"]
    got = {x.node: x.hop for x in graph.distance_boost(edges, spark.range(1, 2).selectExpr("id AS node"), 2).collect()}
    first = {1000 + i % 37 for i in range(2000) if i % 40 == 1}
    assert got == {1: 0} | dict.fromkeys(first, 1) | {i % 40: 2 for i in range(2000) if 1000 + i % 37 in first and i % 40 != 1}


def test_rows_move_once_to_be_numbered(spark):
    rows = spark.range(3000).selectExpr("id % 3 AS lane", "id AS event")
    df = log.range_digests(rows, ["lane"], "event", "event")
    plan = df._jdf.queryExecution().executedPlan().toString()
    # by range, and by chunk; the cuts and the rows before them are broadcast
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan
    assert df.agg(F.sum("records")).first()[0] == 3000


def test_groups_follow_links_only(spark, monkeypatch):
    ops = spark.createDataFrame([(1, "a", None, None), (2, "b", "a", None), (3, "c", None, ["d", None, "b"]), (4, "e", None, None), (5, None, None, None), (6, "d", None, []), (7, "e", None, None)], "line long, fact_id string, by_fact_id string, ids array<string>")
    ops = ops.withColumn("fact", F.lit(None).cast("struct<fact_id:string>"))
    written = []
    kept = journal.kept
    monkeypatch.setattr(journal, "kept", lambda df, what: written.append((what, kept(df, what))) or written[-1][1])
    sets = {}
    for x in journal.groups(ops).collect():
        sets.setdefault(x.grp, set()).add(x.line)
    assert sorted(map(sorted, sets.values())) == [[1, 2, 3, 6], [4, 7], [5]]
    assert {x.line for x in written[0][1].collect()} == {2, 3}
