"""Graphs, traces and analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, log, traces
from ..sources.tables import LOG, RELATIONS, log_rows, relation_rows, table

Q, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        Q[name], SQL[name] = f, sql
        return f

    return add


_BOTH = """both_ways AS (SELECT src AS node, dst AS other, kind, q16 / 65535.0 * CASE kind WHEN 'F' THEN 1.5 ELSE 1.2 END * 0.8 AS w FROM relations UNION ALL SELECT dst, src, kind, q16 / 65535.0 * CASE kind WHEN 'F' THEN 1.5 ELSE 1.2 END * 0.8 * 0.9 FROM relations)"""


@query("s17_relations", f"WITH {RELATIONS} SELECT * FROM relations")
def _(spark, d):
    return relation_rows(spark, d)


def _expand_sql(edges: str) -> str:
    return f"""WITH {RELATIONS}, {_BOTH.replace("FROM relations", "FROM relations WHERE " + edges)}, h0 AS (SELECT unnest([1, 2]) AS node, 1.0::DOUBLE AS score),
h1e AS (SELECT other AS node, score * w AS s, kind FROM h0 JOIN both_ways USING (node)), h1 AS (SELECT node, max(s) AS score FROM h1e WHERE node NOT IN (1, 2) GROUP BY 1),
h2e AS (SELECT other AS node, score * w AS s, kind FROM h1 JOIN both_ways USING (node) WHERE score >= 0.01),
a AS (SELECT *, 1 AS hop FROM h1e UNION ALL SELECT *, 2 FROM h2e)
SELECT node, round(max(s), 6) AS score, arg_max(hop, (s, -hop)) AS hop, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM a WHERE node NOT IN (1, 2) GROUP BY node ORDER BY max(s) DESC, node LIMIT 100"""


_BOOSTS = {"F": 1.5, "O": 1.2}


def _seeds(spark):
    return spark.range(1, 3).select(F.col("id").alias("node"), F.lit(1.0).alias("score"))


@query("r9_graph_expand", _expand_sql("true"))
def _(spark, d):
    out = graph.expand(relation_rows(spark, d), _seeds(spark), 2, 100, boosts=_BOOSTS)
    return out.select("node", F.round("score", 6).alias("score"), "hop", F.array_join("kinds", ",").alias("kinds"))


@query("p7_filtered_expand", _expand_sql("kind = 'F' AND q16 >= 45874"))
def _(spark, d):
    out = graph.expand(relation_rows(spark, d), _seeds(spark), 2, 100, kinds=["F"], floor=0.7, boosts=_BOOSTS)
    return out.select("node", F.round("score", 6).alias("score"), "hop", F.array_join("kinds", ",").alias("kinds"))


_WINDOW = "(updated_at >= TIMESTAMP '1996-03-01' AND updated_at < TIMESTAMP '1996-06-01') OR (created_at >= TIMESTAMP '1996-03-01' AND created_at < TIMESTAMP '1996-06-01')"
_CHANGED = f"""hit AS (SELECT * FROM relations WHERE {_WINDOW}),
states AS (SELECT o_custkey AS artifact, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS state, min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at FROM orders GROUP BY 1),
e AS (SELECT src AS artifact, updated_at FROM hit UNION ALL SELECT dst, updated_at FROM hit), g AS (SELECT artifact, count(*) AS n_edges, max(updated_at) AS edge_update FROM e GROUP BY 1),
m AS (SELECT artifact, updated_at AS state_update FROM states WHERE {_WINDOW}),
changed AS (SELECT artifact, states.state, coalesce(n_edges, 0) AS n_edges, greatest(state_update, edge_update) AS last_update FROM m FULL JOIN g USING (artifact) LEFT JOIN states USING (artifact) ORDER BY last_update DESC, artifact LIMIT 100)"""


def _changed(spark, d):
    orders = table(spark, d, "orders")
    states = orders.groupBy(F.col("o_custkey").alias("artifact")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("state"), F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("updated_at"))
    window = [F.lit(x).cast("timestamp_ntz") for x in ("1996-03-01", "1996-06-01")]
    edges = relation_rows(spark, d)
    return edges, states, window, graph.changed_between(edges, states, *window, 100)


@query("r10_time_range", f"WITH {RELATIONS}, {_CHANGED} SELECT * FROM changed")
def _(spark, d):
    return _changed(spark, d)[3]


@query("r10_changed_edges", f"WITH {RELATIONS}, {_CHANGED} SELECT DISTINCT c.artifact, src, dst, kind, a.state AS src_state, b.state AS dst_state FROM changed c JOIN hit ON c.artifact = src OR c.artifact = dst LEFT JOIN states a ON a.artifact = src LEFT JOIN states b ON b.artifact = dst")
def _(spark, d):
    edges, states, window, artifacts = _changed(spark, d)
    return graph.changed_edges(edges, artifacts, states, *window)


@query("a8_living_fields", f"""WITH {RELATIONS}, e AS (SELECT src AS artifact, 1 AS o, 0 AS i FROM relations UNION ALL SELECT dst, 0, 1 FROM relations),
g AS (SELECT artifact, sum(o) AS o, sum(i) AS i FROM e GROUP BY 1),
p AS (SELECT o_custkey AS artifact, max(CAST(left(o_orderpriority, 1) AS BIGINT)) AS level, bit_or(1::BIGINT << (o_orderkey % 40 & 31)) AS mask FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT coalesce(g.artifact, p.artifact) AS artifact, coalesce(o, 0)::BIGINT AS out_count, coalesce(i, 0)::BIGINT AS in_count, coalesce(level, 0) AS pressure_level, coalesce(mask, 0) AS reasons_mask FROM g FULL JOIN p ON g.artifact = p.artifact""")
def _(spark, d):
    felt = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("artifact"), F.substring("o_orderpriority", 1, 1).cast("long").alias("level"), (F.col("o_orderkey") % 40).alias("code"))
    return graph.living_fields(relation_rows(spark, d), felt)


@query("a11_dependents", "SELECT l_partkey AS artifact, l_returnflag AS kind, l_suppkey AS dependent, max(l_shipdate) AS last_seen, max(l_quantity) AS weight FROM lineitem GROUP BY ALL")
def _(spark, d):
    seen = table(spark, d, "lineitem").select(F.col("l_partkey").alias("artifact"), F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("dependent"), F.col("l_shipdate").alias("at"), F.col("l_quantity").alias("weight"))
    return graph.dependents(seen)


@query("j24_orphans", f"WITH {RELATIONS}, e AS (SELECT * FROM relations WHERE q16 >= 65000 AND kind = 'F') SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT src FROM e) AND c_custkey NOT IN (SELECT dst FROM e)")
def _(spark, d):
    sure = relation_rows(spark, d).where("q16 >= 65000 AND kind = 'F'")
    return graph.orphans(table(spark, d, "customer").select(F.col("c_custkey").alias("node")), sure)


@query("r8_distance_boost", f"""WITH {RELATIONS}, b AS (SELECT src AS node, dst AS other FROM relations UNION SELECT dst, src FROM relations),
h1 AS (SELECT DISTINCT other AS node FROM b WHERE node = 1), h2 AS (SELECT DISTINCT other AS node FROM b JOIN h1 USING (node)),
a AS (SELECT 1 AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2)
SELECT CAST(node AS BIGINT) AS node, min(hop) AS hop, 1.0::DOUBLE / (min(hop) + 1) AS boost FROM a GROUP BY 1""")
def _(spark, d):
    return graph.distance_boost(relation_rows(spark, d), spark.range(1, 2).select(F.col("id").alias("node")), 2)


@query("t10_incoming_page", f"WITH {RELATIONS} SELECT src, dst, kind, q16 FROM relations WHERE dst = 1000001 AND (src, kind) > (20, 'F') ORDER BY src, kind LIMIT 15")
def _(spark, d):
    own = relation_rows(spark, d).where("dst = 1000001").select("src", "dst", "kind", "q16")
    return log.replay(own, (20, "F"), ["src", "kind"], 15)


@query("a35_graph_stats", f"WITH {RELATIONS} SELECT kind, CASE WHEN q16 >= 55704 THEN 'high' WHEN q16 >= 32767 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS edges, count(DISTINCT src) AS sources FROM relations GROUP BY 1, 2")
def _(spark, d):
    band = F.when(graph.at_least(F.col("q16"), 0.85), "high").when(graph.at_least(F.col("q16"), 0.5), "medium").otherwise("low")
    return relation_rows(spark, d).groupBy("kind", band.alias("confidence")).agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"))


SPANS = """spans AS (SELECT l_orderkey AS trace_id, l_linenumber AS span_id, l_linenumber - 1 AS parent_id, l_linenumber AS depth, 'p' || (l_partkey % 50) AS name, l_quantity AS duration, l_returnflag = 'R' AS had_error FROM lineitem)"""


def spans(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trace_id"), n.alias("span_id"), (n - 1).alias("parent_id"), n.alias("depth"), F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("name"), F.col("l_quantity").alias("duration"), (F.col("l_returnflag") == "R").alias("had_error"))


@query("a20_code_path", f"WITH {SPANS} SELECT depth, name, count(*) AS calls, sum(duration) AS duration, bool_or(had_error) AS had_error FROM spans WHERE trace_id IN (SELECT trace_id FROM spans WHERE name = 'p7') GROUP BY 1, 2")
def _(spark, d):
    return traces.code_path(spans(spark, d), "p7")


@query("j11_callers", f"WITH {SPANS} SELECT p.name AS caller, s.name AS callee, count(*) AS calls FROM spans s LEFT JOIN spans p ON s.trace_id = p.trace_id AND s.parent_id = p.span_id GROUP BY 1, 2")
def _(spark, d):
    return traces.callers(spans(spark, d))


SEEN = f"""{SPANS}, seen AS (SELECT *, CASE WHEN CAST(name[2:] AS INTEGER) % 4 <> 2 THEN 'f' || (CAST(name[2:] AS INTEGER) % 4) END AS file, CASE WHEN had_error THEN 'empty' WHEN duration > 10 THEN 'non_empty' END AS outcome FROM spans)"""
_VERDICT = """CASE WHEN NOT in_scan THEN 'unknown_symbol' WHEN dead AND n > 0 THEN 'static_dead_but_executed__extractor_false_positive' WHEN dead AND file_ran THEN 'dead_candidate__static_and_runtime_agree'
WHEN dead THEN 'dead_candidate__static_only__runtime_window_never_reached_it' WHEN n > 0 THEN 'live' WHEN test_only THEN 'test_only__referenced_only_by_tests' ELSE 'reachable_but_unobserved__widen_the_window' END"""


def seen(spark, d):
    own = spans(spark, d).withColumn("k", F.substring("name", 2, 9).cast("int"))
    file = F.when(F.col("k") % 4 != 2, F.concat(F.lit("f"), F.col("k") % 4))
    return own.withColumns({"file": file, "outcome": F.when(F.col("had_error"), "empty").when(F.col("duration") > 10, "non_empty")}).drop("k")


@query("a21_liveness", f"""WITH {SEEN}, s AS (SELECT i, 'p' || i AS name, 'f' || (i % 4) AS file, i <> 46 AS in_scan, i % 3 = 0 AS dead, i = 52 AS test_only FROM (SELECT unnest(range(0, 60)) AS i)),
r AS (SELECT name, count(*) AS n, sum(duration) AS duration, count(*) FILTER (outcome = 'empty') AS empties, count(*) FILTER (outcome IS NULL) AS unrecorded FROM seen GROUP BY 1),
x AS (SELECT s.*, coalesce(n, 0) AS n, coalesce(duration, 0) AS duration, coalesce(empties, 0) AS empties, coalesce(unrecorded, 0) AS unrecorded, s.file IN (SELECT file FROM seen WHERE file IS NOT NULL) AS file_ran FROM s LEFT JOIN r USING (name))
SELECT name, n AS executions, duration, empties, unrecorded, n > 0 AND unrecorded = 0 AND empties = n AS always_empty, file_ran, {_VERDICT} AS verdict FROM x""")
def _(spark, d):
    i = F.col("id")
    symbols = spark.range(0, 60).select(F.concat(F.lit("p"), i).alias("name"), F.concat(F.lit("f"), i % 4).alias("file"), (i != 46).alias("in_scan"), (i % 3 == 0).alias("flagged_dead"), (i == 52).alias("test_only"))
    return traces.liveness(symbols, seen(spark, d)).select("name", "executions", "duration", "empties", "unrecorded", "always_empty", "file_ran", "verdict")


_DEAD = f"""{SEEN}, s AS (SELECT 'p' || i AS name, 'f' || (i % 4) AS file, i * 7 AS line FROM (SELECT unnest(range(40, 60)) AS i)), r AS (SELECT name, count(*) AS runs FROM seen GROUP BY 1),
v AS (SELECT s.*, coalesce(runs, 0) AS runs, CASE WHEN runs > 0 THEN 'extractor_false_positive__static_dead_but_executed' ELSE 'dead_candidate__static_and_runtime_agree' END AS verdict, CASE WHEN runs > 0 THEN 1 ELSE 2 END AS agreeing,
  runs IS NULL AND s.file IN (SELECT file FROM seen WHERE file IS NOT NULL) AS actionable, 'dead:' || s.file || ':' || line AS finding_id FROM s LEFT JOIN r USING (name))"""


def dead(spark):
    i = F.col("id")
    return spark.range(40, 60).select(F.concat(F.lit("p"), i).alias("name"), F.concat(F.lit("f"), i % 4).alias("file"), (i * 7).alias("line"))


@query("a22_dead_code", f"WITH {_DEAD} SELECT name, file, line, runs, verdict, agreeing, false AS single_signal, actionable, finding_id FROM v")
def _(spark, d):
    return traces.dead_code(dead(spark), seen(spark, d))


@query("a22_dead_code_counts", f"WITH {_DEAD} SELECT verdict, count(*) AS n, count(*) FILTER (actionable) AS actionable FROM v GROUP BY 1")
def _(spark, d):
    return traces.dead_code_counts(traces.dead_code(dead(spark), seen(spark, d)))


@query("j12_dependents", f"""WITH {SPANS}, a AS (SELECT 'p' || (o_custkey % 60) AS caller, count(*) AS n FROM orders WHERE o_orderkey % 50 = 7 GROUP BY 1),
b AS (SELECT p.name AS caller, count(*) AS n FROM spans s JOIN spans p ON s.trace_id = p.trace_id AND s.parent_id = p.span_id WHERE s.name = 'p7' GROUP BY 1)
SELECT caller, coalesce(a.n, 0) + coalesce(b.n, 0) AS calls, CASE WHEN b.n IS NULL THEN 'static' WHEN a.n IS NULL THEN 'runtime' ELSE 'both' END AS evidence FROM a FULL JOIN b USING (caller)""")
def _(spark, d):
    refs = table(spark, d, "orders").select(F.concat(F.lit("p"), F.col("o_custkey") % 60).alias("caller"), F.concat(F.lit("p"), F.col("o_orderkey") % 50).alias("callee"), F.lit(1).alias("calls"))
    return traces.dependents(refs, spans(spark, d), "p7")


@query("j14_resolved_symbols", """WITH sp AS (SELECT l_orderkey * 10 + l_linenumber AS span_id, 'f' || (l_partkey // 3 % 5) AS file, 'p' || (l_partkey // 3) AS name, CASE WHEN l_quantity <= 45 THEN CAST(l_quantity AS BIGINT) END AS line FROM lineitem),
sy AS (SELECT p_partkey AS symbol_id, 'f' || (p_partkey // 3 % 5) AS file, 'p' || (p_partkey // 3) AS name, p_size AS l FROM part WHERE p_partkey % 7 <> 0),
c AS (SELECT file, name, count(*) AS n FROM sy GROUP BY 1, 2),
x AS (SELECT span_id, symbol_id, abs(line - l) AS dist, row_number() OVER (PARTITION BY span_id ORDER BY abs(line - l) NULLS FIRST, symbol_id) AS place FROM sp JOIN sy USING (file, name)),
t AS (SELECT span_id, max(symbol_id) FILTER (place = 1) AS best, max(dist) FILTER (place = 1) AS d1, max(dist) FILTER (place = 2) AS d2 FROM x WHERE place <= 2 GROUP BY 1),
h AS (SELECT span_id, best, d1, d2, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'extracted' WHEN line IS NULL OR d2 - d1 < 4 THEN 'ambiguous' ELSE 'inferred' END AS how FROM sp LEFT JOIN c USING (file, name) LEFT JOIN t USING (span_id))
SELECT span_id, how, CASE WHEN how IN ('extracted', 'inferred') THEN best END AS symbol_id, CASE WHEN how = 'inferred' THEN round(least(greatest((d2 - d1) / (d2 - d1 + d1 + 1.0), 0.01), 1), 6) END AS score FROM h""")
def _(spark, d):
    key = lambda c: (F.concat(F.lit("f"), F.expr(f"{c} div 3 % 5")).alias("file"), F.concat(F.lit("p"), F.expr(f"{c} div 3")).alias("name"))
    own = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("span_id"), *key("l_partkey"), F.when(F.col("l_quantity") <= 45, F.col("l_quantity").cast("long")).alias("line"))
    symbols = table(spark, d, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("symbol_id"), *key("p_partkey"), F.col("p_size").alias("at"))
    return traces.resolved_symbols(own, symbols).withColumn("score", F.round("score", 6))


@query("a25_trace_list", f"WITH {SPANS} SELECT trace_id, count(*) AS spans, sum(duration) AS duration, bool_or(had_error) AS had_error FROM spans GROUP BY 1")
def _(spark, d):
    return traces.trace_list(spans(spark, d))


@query("a23_trace_diff", f"""WITH {SPANS}, a AS (SELECT name, arg_max(duration, (depth, duration)) AS a, min(depth) AS at_a FROM spans WHERE trace_id = 1 GROUP BY 1), b AS (SELECT name, max(duration) AS b, min(depth) AS at_b FROM spans WHERE trace_id = 3 GROUP BY 1),
x AS (SELECT name, CASE WHEN b IS NULL THEN 'only_a' WHEN a IS NULL THEN 'only_b' ELSE 'both' END AS side, coalesce(b > 2 * a AND b - a > 1, false) AS slower, coalesce(at_a, at_b) AS moment FROM a FULL JOIN b USING (name)),
f AS (SELECT name AS first FROM x WHERE side <> 'both' ORDER BY side, moment, name LIMIT 1)
SELECT name, side, slower, coalesce(name = (SELECT first FROM f), false) AS first_divergence FROM x""")
def _(spark, d):
    return traces.trace_diff(spans(spark, d), 1, 3)


@query("j17_reconcile", """WITH a AS (SELECT o_orderkey AS key, o_orderkey % 7 AS digest FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT DISTINCT l_orderkey AS key, CASE WHEN l_orderkey % 13 = 0 THEN -1 ELSE l_orderkey % 7 END AS digest FROM lineitem WHERE l_orderkey % 9 <> 0)
SELECT count(*) FILTER (a.digest = b.digest) AS matched, count(*) FILTER (b.digest IS NULL) AS missing_in_other, count(*) FILTER (a.digest IS NULL) AS missing_in_log, count(*) FILTER (a.digest <> b.digest) AS mismatched FROM a FULL JOIN b USING (key)""")
def _(spark, d):
    key = F.col("key")
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("key")).where("key % 10 <> 0").withColumn("digest", key % 7)
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")).distinct().where("key % 9 <> 0").withColumn("digest", F.when(key % 13 == 0, F.lit(-1)).otherwise(key % 7))
    return traces.reconcile(a, b)


_CLAIM = "'toxic' AS kind, CAST(doc_id AS VARCHAR) AS subject, CASE WHEN doc_id % 3 > 0 THEN CAST(toxic AS VARCHAR) END AS object"


@query("j18_claims_diff", f"""WITH a AS (SELECT {_CLAIM}, 0.5 AS confidence FROM labels WHERE doc_id % 5 <> 0), b AS (SELECT {_CLAIM}, CASE WHEN doc_id % 4 = 0 THEN 0.75 ELSE 0.5 END AS confidence FROM labels WHERE doc_id % 7 <> 0)
SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.subject, b.subject) AS subject, coalesce(a.object, b.object) AS object, CASE WHEN a.kind IS NULL THEN 'added' WHEN b.kind IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.kind = b.kind AND a.subject = b.subject AND a.object IS NOT DISTINCT FROM b.object WHERE a.kind IS NULL OR b.kind IS NULL OR abs(a.confidence - b.confidence) > 0.001""")
def _(spark, d):
    own = table(spark, d, "labels")
    claim = lambda df, c: df.select(F.lit("toxic").alias("kind"), F.col("doc_id").cast("string").alias("subject"), F.when(F.col("doc_id") % 3 > 0, F.col("toxic").cast("string")).alias("object"), c.alias("confidence"))
    return traces.claims_diff(claim(own.where("doc_id % 5 <> 0"), F.lit(0.5)), claim(own.where("doc_id % 7 <> 0"), F.when(F.col("doc_id") % 4 == 0, 0.75).otherwise(0.5)))


@query("a33_agreement", "SELECT event_type AS kind, CAST(user_id % 50 AS VARCHAR) AS subject, CAST(event_id % 7 AS VARCHAR) AS object, count(DISTINCT user_id) AS agents, CASE WHEN count(DISTINCT user_id) >= 2 THEN 'agreed' ELSE 'unique' END AS status FROM events GROUP BY 1, 2, 3")
def _(spark, d):
    return traces.agreement(table(spark, d, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 50).cast("string").alias("subject"), (F.col("event_id") % 7).cast("string").alias("object"), F.col("user_id").alias("agent")))


@query("a31_burn_attribution", """WITH b AS (SELECT user_id * 100 + day(ts) AS session, min(ts) AS s, max(ts) AS e, 'p' || (min(user_id) % 3) AS passport, CASE min(user_id) % 4 WHEN 0 THEN ['one', 'three', 'none'] WHEN 1 THEN ['two'] ELSE [] END AS slugs, count(*) * 10 AS context, count(*) * 3 AS output FROM events GROUP BY 1),
p AS (SELECT * FROM (VALUES ('one', TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-09', ['p0']), ('two', TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-20', ['p9']), ('three', TIMESTAMP '2024-01-19', TIMESTAMP '2024-01-25', ['p0', 'p1', 'p2']), ('four', TIMESTAMP '2024-01-19', TIMESTAMP '2024-01-25', ['p0', 'p1', 'p2'])) t(plan, ws, we, agents)),
m AS (SELECT plan, context, output, false AS link, list_contains(agents, passport) AS sure FROM b JOIN p ON s <= we AND ws <= e WHERE len(slugs) = 0
  UNION ALL SELECT slug, context // len(slugs), output // len(slugs), true, false FROM (SELECT *, unnest(slugs) AS slug FROM b) WHERE slug IN (SELECT plan FROM p)),
g AS (SELECT plan, count(*) AS sessions, sum(context)::BIGINT AS context, sum(output)::BIGINT AS output, count(*) FILTER (link) AS l, count(*) FILTER (sure) AS c FROM m GROUP BY 1)
SELECT plan, sessions, context, output, CASE WHEN sessions = l THEN 'link' WHEN l > 0 THEN 'mixed' WHEN c = 0 THEN 'window' WHEN c = sessions THEN 'passport+window' ELSE 'mixed' END AS method FROM g""")
def _(spark, d):
    user = F.min("user_id")
    slugs = F.when(user % 4 == 0, F.array(*map(F.lit, ("one", "three", "none")))).when(user % 4 == 1, F.array(F.lit("two"))).otherwise(F.array().cast("array<string>"))
    burns = table(spark, d, "events").groupBy((F.col("user_id") * 100 + F.day("ts")).alias("session")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.concat(F.lit("p"), user % 3).alias("passport"), slugs.alias("slugs"), (F.count("*") * 10).alias("context"), (F.count("*") * 3).alias("output"))
    plans = spark.sql("SELECT * FROM VALUES ('one', TIMESTAMP_NTZ '2024-01-02', TIMESTAMP_NTZ '2024-01-09', array('p0')), ('two', TIMESTAMP_NTZ '2024-01-05', TIMESTAMP_NTZ '2024-01-20', array('p9')), ('three', TIMESTAMP_NTZ '2024-01-19', TIMESTAMP_NTZ '2024-01-25', array('p0', 'p1', 'p2')), ('four', TIMESTAMP_NTZ '2024-01-19', TIMESTAMP_NTZ '2024-01-25', array('p0', 'p1', 'p2')) AS t(plan, window_start, window_end, agents)")
    return traces.burn_attribution(burns, plans)


@query("wn6_segments", f"""WITH {LOG}, s AS (SELECT *, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq) AS BIGINT) AS segment FROM log)
SELECT stream_id, seq, segment, CAST(row_number() OVER (PARTITION BY stream_id, segment ORDER BY seq) AS INTEGER) AS turn_in_segment FROM s""")
def _(spark, d):
    rows = log_rows(spark, d).withColumn("cut", F.col("event_type") == "error")
    return traces.segments(rows, ["stream_id"], ["seq"], "cut").select("stream_id", "seq", "segment", "turn_in_segment")


_TURNS = f"""{LOG}, t AS (SELECT stream_id, seq, ts, CASE event_type WHEN 'error' THEN 'compaction' WHEN 'signup' THEN 'note' ELSE 'assistant' END AS kind, CAST(round(value * (event_id % 5) * 30) AS BIGINT) AS r, CAST(round(value * 60) AS BIGINT) AS c, 4000 AS i,
  CASE WHEN event_type = 'signup' THEN ['ultra_effort_enter', 'date_change', 'deferred_tools_delta', 'mcp_instructions_delta', 'hook_pre'][event_id % 5 + 1] END AS a, event_id % 2 AS removed FROM log),
n AS (SELECT *, sum(CASE WHEN kind = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq) - CASE WHEN kind = 'assistant' THEN 1 ELSE 0 END AS turn FROM t),
g AS (SELECT stream_id, turn, bool_or(kind = 'compaction') AS compacted, max(r) FILTER (kind = 'assistant') AS r, max(c) FILTER (kind = 'assistant') AS c, max(i) AS i, max(ts) FILTER (WHERE kind = 'assistant') AS moment,
  coalesce(bool_or(a = 'ultra_effort_enter'), false) AS effort, coalesce(bool_or(a = 'date_change'), false) AS date, coalesce(bool_or(a = 'deferred_tools_delta'), false) AS tools, coalesce(bool_or(a = 'deferred_tools_delta' AND removed = 1), false) AS rem, coalesce(bool_or(a = 'mcp_instructions_delta'), false) AS ins, coalesce(bool_or(a = 'hook_pre'), false) AS hook
  FROM n GROUP BY 1, 2 HAVING bool_or(kind = 'assistant')),
p AS (SELECT *, lag(r + c + i) OVER w AS ctx, (epoch_us(moment) - lag(epoch_us(moment)) OVER w) / 6e7 AS gap FROM g WINDOW w AS (PARTITION BY stream_id ORDER BY turn))"""


def turns(spark, d):
    note, kinds = F.col("event_type") == "signup", F.array(*map(F.lit, ("ultra_effort_enter", "date_change", "deferred_tools_delta", "mcp_instructions_delta", "hook_pre")))
    names = F.when(F.col("event_id") % 2 == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.col("event_type") == "error", "compaction").when(note, "note").otherwise("assistant")
    return log_rows(spark, d).select(
        "stream_id", "seq", F.col("ts").alias("at"), kind.alias("kind"), F.when(kind == "assistant", F.round(F.col("value") * (F.col("event_id") % 5) * 30).cast("long")).alias("cache_read"),
        F.round(F.col("value") * 60).cast("long").alias("cache_creation"), F.lit(4000).alias("input"), F.when(note, F.get(kinds, (F.col("event_id") % 5).cast("int"))).alias("attachment"), names.alias("removed_names"),
    )


@query("a28_cache_ledger", f"""WITH {_TURNS}
SELECT stream_id, CAST(turn AS BIGINT) AS turn, c AS tokens, round(gap, 1) AS gap, CASE WHEN gap >= 60 THEN 'ttl_expiry' WHEN effort THEN 'effort_change' WHEN date THEN 'date_change' WHEN tools AND rem THEN 'tool_delta_with_removals' WHEN tools THEN 'tool_delta_add_only' WHEN ins THEN 'mcp_instructions_delta' WHEN hook THEN 'hook_block' ELSE 'unattributed' END AS cause,
CASE WHEN gap >= 60 THEN CASE WHEN gap < 65 THEN '60-65m' WHEN gap < 120 THEN '65-120m' WHEN gap < 480 THEN '120-480m' ELSE '480m+' END END AS band
FROM p WHERE NOT compacted AND ctx >= 5000 AND r < 0.5 * ctx AND c > 0.4 * ctx""")
def _(spark, d):
    return traces.cache_ledger(turns(spark, d), ["stream_id"], "seq")


@query("a28_idle_ledger", f"""WITH {LOG}, i AS (SELECT stream_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY stream_id ORDER BY seq))) / 6e7 AS idle FROM log)
SELECT stream_id, CASE WHEN idle < 5 THEN 'under5' WHEN idle < 60 THEN 'under60' ELSE 'over60' END AS band, count(*) AS n FROM i WHERE idle IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return traces.idle_ledger(log_rows(spark, d), ["stream_id"], ["seq"], "ts")


@query("a9_entity_count", "SELECT event_type AS predicate, user_id % 3 AS tenant, count(DISTINCT user_id) AS entities FROM events GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("predicate"), (F.col("user_id") % 3).alias("tenant")).agg(F.countDistinct("user_id").alias("entities"))
