"""Cases that the queries over the driver's tables don't show."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.operators import budget, facts, journal, ranked, work
from recallspark.operators import retrieval as r

TEXTS = [(1, "terraform drift detection for clusters", "a", 1), (2, "drift of terraform state", "b", 1), (3, "terraform plans and modules", "a", 2), (4, "cluster autoscaling", "a", 2), (5, None, "b", 3)]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, text string, tenant string, segment long")


def ids(df):
    return [x.doc_id for x in df.collect()]


def test_written_index_answers_as_the_plain_one(spark, tmp_path):
    plain = r.build_index(docs(spark))
    own = r.write_index(r.build_index(docs(spark, TEXTS[:3])), f"{tmp_path}/i", 4)
    own = r.append_segment(own, docs(spark, TEXTS[3:]), f"{tmp_path}/i")
    for terms in (["terraform"], ["terraform", "drift", "drift"], ["none"], []):
        rows = [sorted((x.doc_id, x.segment, x.doc_len, round(x.score, 9), x.matched) for x in r.bm25_scores(i, terms).collect()) for i in (own, plain)]
        assert rows[0] == rows[1]
    read = own.of_terms(["terraform"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in read.replace("PartitionFilters: [isnotnull(bucket", "PartitionFilters: [bucket") and "PushedFilters" in read


def test_tenants_and_erasure(spark):
    index = r.build_index(docs(spark))
    assert ids(r.bm25_search(index, ["terraform"], 10, 0.0, tenant="a")) == [3, 1]
    gone = spark.createDataFrame([("a", 1)], "tenant string, watermark long")
    assert set(ids(r.bm25_search(index, ["terraform"], 10, 0.0, forgotten=gone))) == {2, 3}
    # what is not visible still counts in the statistics
    every, some = ({x.doc_id: x.score for x in r.bm25_scores(index, ["terraform"], tenant=t).collect()} for t in (None, "a"))
    assert all(every[d] == s for d, s in some.items())
    assert r.coverage(index, ["terraform", "absent"], 0.1).first().missing == "absent"


def test_numbers_of_long_lists(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 5003).alias("v"))
    got = ranked.numbered(rows, ["k"], -F.col("v"), ["-v"], parts=7)
    want = rows.selectExpr("k", "v", "row_number() over (partition by k order by v desc) AS rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    same = rows.withColumn("v", F.lit(1)).withColumn("t", F.monotonically_increasing_id())
    assert sorted(x.rank for x in ranked.numbered(same, [], F.col("v"), ["v", "t"]).collect()) == list(range(1, 5001))


def test_budgets_hold_free_rows_and_large_lists(spark):
    rows = spark.createDataFrame([(i, 0 if i % 2 else 3) for i in range(3000)], "id long, tokens long")
    kept = budget.prefix_stop(rows, [], ["id"], "tokens", 3000)
    assert kept.count() == 1999 and kept.agg(F.max("used")).first()[0] == 3000
    first = spark.createDataFrame([(1, 99), (2, 1)], "id long, tokens long")
    assert [x.id for x in budget.prefix_stop(first, [], ["id"], "tokens", 5).collect()] == [1]
    assert [x.id for x in budget.skip_and_continue(first, [], ["id"], "tokens", 5, exempt_first=False).collect()] == [2]
    clash = first.withColumns({"_rank": F.lit(7), "_all": F.lit(8)})
    assert budget.skip_and_continue(clash, [], ["id"], "tokens", 200).select("_rank", "_all").distinct().collect() == [(7, 8)]


def test_bundle_counts_what_it_drops(spark):
    at = "timestamp_seconds(id)"
    rows = spark.range(30).selectExpr("id AS fact_id", "'t' AS tenant", "'e' || id AS entity", "'k' AS key", "repeat('v', int(id % 5) * 20) AS value", "double(id % 7) AS effective", "id = 4 AS addressed", "id % 10 = 9 AS private", "'x' AS actor", "false AS deleted", "1 AS version", "string(null) AS superseded_by", f"{at} AS stored_at")
    aux = spark.createDataFrame([("notes", "n1", "z" * 400), ("decisions", "d1", "ok"), ("other", "o", "never")], "section string, id string, text string")
    kept, dropped = facts.context_bundle(rows, aux, "me", 120)
    got = kept.orderBy("used").collect()
    assert got[0].item == "4" and got[-1].used <= 120 and {x.section for x in got} <= {"facts", "decisions"}
    assert {x.section: x.dropped for x in dropped.collect()} == {"facts": 27 - sum(x.section == "facts" for x in got), "notes": 1} | ({} if any(x.section == "decisions" for x in got) else {"decisions": 1})


def op(line, kind, **more):
    fact = more.pop("fact", None)
    empty = {"fact_id": None, "by_fact_id": None, "ids": None, "valid_from": None, "valid_to": None}
    return empty | more | {"line": line, "op": kind, "fact": fact}


def fact(i, tenant="t", supersedes=None):
    return {"fact_id": i, "tenant": tenant, "entity": "e", "key": "k", "value": "v", "supersedes": supersedes}


def test_journal_rules():
    f: dict = {}
    run = lambda kind, **more: journal.apply_op(f, op(len(f), kind, **more))
    assert run("store", fact=fact("a", tenant=" ")) and f["a"]["tenant"] == "default"
    assert not run("store", fact=fact("a"))  # the first wins
    assert all(run("store", fact=fact(i)) for i in "bcd") and run("store", fact=fact("z", "other"))
    assert not run("supersede", fact_id="b", by_fact_id="z") and not run("supersede", fact_id="b", by_fact_id="none")
    assert run("supersede", fact_id="b", by_fact_id="c") and run("clear_supersede", fact_id="b") and f["b"]["superseded_by"] is None
    assert not run("consolidate", fact=fact("m"), ids=[]) and not run("consolidate", fact=fact("m"), ids=["b", "b"]) and not run("consolidate", fact=fact("m"), ids=["b", "z"])
    assert not run("consolidate", fact=fact("m", supersedes="d"), ids=["b", "c"]) and not run("consolidate", fact=fact("d"), ids=["b", "c"])
    assert run("consolidate", fact=fact("m", supersedes="b"), ids=["c", "b"]) and f["b"]["superseded_by"] == f["c"]["superseded_by"] == "m"
    assert not any((run("delete", fact_id="b"), run("delete", fact_id="m"), run("clear_supersede", fact_id="c"), run("supersede", fact_id="c", by_fact_id="d")))
    assert not run("consolidate_undo", fact_id="m", ids=["b"]) and run("consolidate_undo", fact_id="m", ids=["b", "c"])
    assert f["m"]["deleted"] and f["b"]["superseded_by"] is None and not run("consolidate_undo", fact_id="m", ids=["b", "c"])
    assert run("delete", fact_id="b") and f["b"]["deleted"]
    assert run("supersede", fact_id="c", by_fact_id="d") and run("consolidation_provenance", fact_id="d", ids=["c"]) and f["d"]["sources"] == ["c"]
    assert not run("consolidation_provenance", fact_id="d", ids=["a"]) and not run("unknown", fact_id="a")


def test_paths_and_constraints(spark):
    mine = spark.createDataFrame([(1, "src/work/"), (1, ""), (1, "lib")], "session long, path string")
    theirs = spark.createDataFrame([(2, "src/work/item.rs"), (2, "src/work.rs"), (2, "src"), (2, "lib/"), (2, "library")], "peer long, path string")
    assert {x.theirs for x in work.path_overlaps(mine, theirs).collect()} == {"src/work/item.rs", "src", "lib/"}
    rules = [{"id": "off", "severity": "critical", "pattern": ".", "active": False}, {"id": "two", "severity": "high", "terms": ["drop", "table"], "least": 2}]
    got = work.constraint_check(spark.createDataFrame([(1, "DROP table x"), (2, "drop it")], "id long, text string"), rules)
    assert [(x.hits, x.verdict) for x in got.orderBy("id").collect()] == [("two", "warn"), ("", "pass")]
    assert {x.verdict for x in work.constraint_check(got.selectExpr("id", "hits AS text"), []).collect()} == {"pass"}
