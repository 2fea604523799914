"""Capabilities, code graphs, text functions and stores over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import lens
from ..sources.tables import FACTS, fact_rows, table

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_CAPS = """c AS (SELECT p_partkey AS id, p_brand AS system, ['shipped', 'built', 'building', 'planned', NULL][p_size % 5 + 1] AS maturity, p_partkey % 3 AS unit, p_partkey % 4 // 3 AS integration, p_partkey % 6 // 5 AS other, ['audited', 'gap', 'none'][p_partkey % 3 + 1] AS audit, p_size % 4 AS dod, [p_partkey % 5, p_size % 5] AS promises FROM part)"""


def capabilities(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    stages = F.array(*(F.lit(x) for x in ("shipped", "built", "building", "planned")), F.lit(None).cast("string"))
    return table(spark, d, "part").select(
        k.alias("id"), F.col("p_brand").alias("system"), F.get(stages, s % 5).alias("maturity"), (k % 3).alias("unit"), F.expr("p_partkey % 4 div 3").alias("integration"), F.expr("p_partkey % 6 div 5").alias("other"),
        F.get(F.array(*map(F.lit, ("audited", "gap", "none"))), (k % 3).cast("int")).alias("audit"), (s % 4).alias("dod"), F.array(k % 5, (s % 5).cast("long")).alias("promises"),
    )


@query("a34_gaps", f"""WITH {_CAPS}, s AS (SELECT *, coalesce(maturity, 'planned') = 'shipped' AS shipped, unit + integration + other > 0 AS tried FROM c)
SELECT id, system, CASE WHEN NOT tried THEN 'no_tests' WHEN unit = 0 THEN 'no_unit_tests' ELSE 'no_integration_tests' END AS type, CASE WHEN NOT tried THEN CASE WHEN shipped THEN 'critical' ELSE 'high' END WHEN unit = 0 THEN 'medium' ELSE 'high' END AS severity FROM s WHERE NOT tried OR unit = 0 OR (integration = 0 AND shipped)
UNION ALL SELECT id, system, 'audit_gap', CASE WHEN shipped THEN 'critical' ELSE 'high' END FROM s WHERE audit = 'gap' UNION ALL SELECT id, system, 'no_dod', 'high' FROM s WHERE dod = 0""")
def _(spark, d):
    return lens.gaps(capabilities(spark, d))


@query("a34_coverage", f"WITH {_CAPS} SELECT system, count(*) AS total, count(*) FILTER (unit + integration + other > 0) AS tested, count(*) FILTER (audit = 'audited') AS audited, count(*) FILTER (maturity = 'shipped') AS shipped FROM c GROUP BY 1")
def _(spark, d):
    return lens.coverage_report(capabilities(spark, d))


@query("a34_promises", f"""WITH {_CAPS}, e AS (SELECT *, unnest(list_distinct(promises)) AS promise, coalesce(maturity, 'planned') AS m FROM c)
SELECT promise, count(*) AS total, count(*) FILTER (m = 'shipped') AS shipped, count(*) FILTER (m = 'built') AS built, count(*) FILTER (m = 'building') AS building, count(*) FILTER (m = 'planned') AS planned, count(*) FILTER (unit + integration + other > 0) AS tested, count(*) FILTER (audit = 'audited') AS audited FROM e GROUP BY 1""")
def _(spark, d):
    return lens.promise_coverage(capabilities(spark, d))


_STATUS = """k AS (SELECT p_partkey AS cap, ['data', 'code', 'ops'][p_size % 3 + 1] AS affinity, ['free', 'pro', 'team', NULL][p_size % 4 + 1] AS min_tier, CASE WHEN p_partkey % 5 = 0 THEN 'beta' WHEN p_partkey % 5 = 1 THEN 'x' END AS flag, CASE WHEN p_size > 40 THEN 'heavy' ELSE 'light' END AS cost FROM part),
st AS (SELECT cap, affinity, CASE WHEN cap IN (3, 6, 9) THEN 'denied' WHEN affinity NOT IN ('data', 'code') THEN 'other_affinity' WHEN min_tier = 'team' THEN 'tier_insufficient' WHEN flag = 'x' THEN 'feature_disabled' WHEN cost = 'heavy' THEN 'budget_exhausted' ELSE 'granted' END AS status FROM k)"""


def statuses(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    tiers = F.array(*(F.lit(x) for x in ("free", "pro", "team")), F.lit(None).cast("string"))
    catalog = table(spark, d, "part").select(k.alias("cap"), F.get(F.array(*map(F.lit, ("data", "code", "ops"))), s % 3).alias("affinity"), F.get(tiers, s % 4).alias("min_tier"), F.when(k % 5 == 0, "beta").when(k % 5 == 1, "x").alias("flag"), F.when(s > 40, "heavy").otherwise("light").alias("cost"))
    return lens.capability_status(catalog, {"denied": [3, 6, 9], "affinities": ["data", "code"], "tier": "pro"}, ["beta"], 10, 50, ["free", "pro", "team"])


@query("r23_capability_status", f"WITH {_STATUS} SELECT * FROM st")
def _(spark, d):
    return statuses(spark, d)


@query("r23_surviving_edges", f"WITH {_STATUS} SELECT p_partkey AS src, p_partkey % 100 + 1 AS dst FROM part WHERE p_partkey IN (SELECT cap FROM st WHERE status = 'granted') AND p_partkey % 100 + 1 IN (SELECT cap FROM st WHERE status = 'granted')")
def _(spark, d):
    edges = table(spark, d, "part").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") % 100 + 1).alias("dst"))
    return lens.surviving_edges(edges, statuses(spark, d))


@query("r20_storyline", """WITH RECURSIVE r AS (SELECT DISTINCT 'f' || p_partkey AS file, 'f' || (p_partkey * p_size % 60) AS to_file FROM part WHERE p_partkey < 60 UNION SELECT 'f' || p_partkey, 'f' || ((p_partkey * 3 + 1) % 60) FROM part WHERE p_partkey < 60),
t AS (SELECT 'f1' AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS level, false AS cycle, ['f1'] AS path
  UNION ALL SELECT to_file, node, level + 1, list_contains(path, to_file), list_append(path, to_file) FROM t JOIN r ON node = file WHERE file <> to_file AND NOT cycle AND level < 5)
SELECT node, parent, level, cycle FROM t""")
def _(spark, d):
    p = table(spark, d, "part").where("p_partkey < 60")
    file = F.concat(F.lit("f"), "p_partkey").alias("file")
    refs = p.select(file, F.concat(F.lit("f"), F.col("p_partkey") * F.col("p_size") % 60).alias("to_file")).union(p.select(file, F.concat(F.lit("f"), (F.col("p_partkey") * 3 + 1) % 60)))
    return lens.storyline(refs, "f1")


@query("r22_call_edges", "SELECT l_partkey AS src, l_suppkey AS dst, 'calls' AS kind, CAST(least(6000 + count(*) * 1000, 10000) AS INTEGER) AS confidence FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2")
def _(spark, d):
    return lens.call_edges(table(spark, d, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("to_file"), F.lit(1).alias("calls")))


@query("r22_import_edges", """WITH f AS (SELECT 'src/m' || (p_partkey % 40) || '/x' || p_partkey || '.rs' AS path, 'crate::m' || (p_partkey % 40) || '::x' || p_partkey AS module FROM part),
d AS (SELECT DISTINCT 'src/m0/x40.rs' AS file, CASE l_linenumber % 3 WHEN 0 THEN 'crate::m' || (l_partkey % 40) || '::x' || l_partkey WHEN 1 THEN 'm' || (l_partkey % 40) || '::x' || l_partkey ELSE 'none::y' END AS module FROM lineitem)
SELECT DISTINCT file AS src, path AS dst, 'imports' AS kind, 10000 AS confidence FROM d JOIN f ON d.module = f.module OR (d.module NOT IN (SELECT module FROM f) AND ends_with(left(f.path, length(f.path) - 3), '/' || replace(d.module, '::', '/'))) WHERE file <> path""")
def _(spark, d):
    k = F.col("p_partkey")
    files = table(spark, d, "part").select(F.concat(F.lit("src/m"), k % 40, F.lit("/x"), k, F.lit(".rs")).alias("path"), F.concat(F.lit("crate::m"), k % 40, F.lit("::x"), k).alias("module"))
    n = F.col("l_partkey")
    name = F.concat(F.lit("m"), n % 40, F.lit("::x"), n)
    module = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("crate::"), name)).when(F.col("l_linenumber") % 3 == 1, name).otherwise("none::y")
    deps = table(spark, d, "lineitem").select(F.lit("src/m0/x40.rs").alias("file"), module.alias("module")).distinct()
    return lens.import_edges(deps, files)


@query("r24_recurring", "WITH f AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'decision::topic-' || (user_id % 7) || '-2024-01-' || lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0') ELSE 'decision::topic-' || (user_id % 5) END AS entity, ts FROM events) SELECT regexp_replace(split_part(entity, ':', 3), '-[0-9]{4}-[0-9]{2}-[0-9]{2}$', '') AS topic, count(*) AS n, min(ts) AS first, max(ts) AS last FROM f GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    dated = F.concat(F.lit("decision::topic-"), u % 7, F.lit("-2024-01-"), F.lpad((e % 28 + 1).cast("string"), 2, "0"))
    facts = table(spark, d, "events").select(F.when(e % 3 == 0, dated).otherwise(F.concat(F.lit("decision::topic-"), u % 5)).alias("entity"), F.col("ts").alias("stored_at"))
    return lens.recurring(facts, "decision:", 2)


_GRAPH = f"""{FACTS}, g AS (SELECT entity, key, CASE WHEN fact_id % 4 = 0 THEN 'user:' || (fact_id % 20) ELSE value END AS value, CASE WHEN starts_with(entity, 'user:1') THEN 'one' WHEN starts_with(entity, 'user:') THEN 'user' END AS kind FROM live), r AS (SELECT DISTINCT 'p' || (p_partkey % 30) AS file, 'p' || (p_size % 30) AS to_file FROM part)"""


def graph(spark, d):
    from ..operators import facts

    rows = fact_rows(spark, d).where(facts.visible()).withColumn("value", F.when(F.col("fact_id") % 4 == 0, F.concat(F.lit("user:"), F.col("fact_id") % 20)).otherwise(F.col("value")))
    refs = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey") % 30).alias("file"), F.concat(F.lit("p"), F.col("p_size") % 30).alias("to_file"))
    return lens.context_graph(rows, {"user:": "user", "user:1": "one"}, refs)


@query("r21_context_nodes", f"WITH {_GRAPH} SELECT DISTINCT entity AS node, kind FROM g UNION SELECT file, 'file' FROM r UNION SELECT to_file, 'file' FROM r")
def _(spark, d):
    return graph(spark, d)[0]


@query("r21_context_edges", f"WITH {_GRAPH} SELECT DISTINCT entity AS src, value AS dst, key AS kind FROM g WHERE value IN (SELECT entity FROM g) UNION ALL SELECT file, to_file, 'references' FROM r")
def _(spark, d):
    return graph(spark, d)[1]


@query("s18_store_journal", "WITH o AS (SELECT event_id AS line, CASE WHEN event_id % 13 > 0 THEN 'k' || (user_id * 10 + event_id % 10) END AS id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, value FROM events) SELECT line, id, op, value FROM o WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY line DESC) = 1 AND op <> 'delete'")
def _(spark, d):
    e = F.col("event_id")
    ops = table(spark, d, "events").select(e.alias("line"), F.when(e % 13 > 0, F.concat(F.lit("k"), F.col("user_id") * 10 + e % 10)).alias("id"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "value")
    return lens.last_state(ops, ["id"], "line")


_STORE = "s AS (SELECT l_orderkey AS trace_id, l_linenumber AS span_id, l_shipdate AS stored_at, 'r' || (l_orderkey % 4) AS release FROM lineitem)"


def stored(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("span_id"), F.col("l_shipdate").alias("stored_at"), F.concat(F.lit("r"), F.col("l_orderkey") % 4).alias("release"))


@query("s21_retained_traces", f"WITH {_STORE}, l AS (SELECT * FROM s WHERE stored_at >= TIMESTAMP '1998-06-01' - INTERVAL 400 DAY), k AS (SELECT trace_id FROM l GROUP BY 1 ORDER BY max(stored_at) DESC, trace_id DESC LIMIT 150) SELECT trace_id, span_id FROM l WHERE trace_id IN (SELECT trace_id FROM k)")
def _(spark, d):
    return lens.retained_traces(stored(spark, d), F.lit("1998-06-01").cast("timestamp_ntz"), "400 days", 150).select("trace_id", "span_id")


@query("a25_releases", f"WITH {_STORE} SELECT release, min(stored_at) AS first, count(*) AS spans, count(DISTINCT trace_id) AS traces FROM s GROUP BY 1")
def _(spark, d):
    return lens.releases(stored(spark, d))


@query("a25_volume", f"WITH {_STORE} SELECT count(*) AS spans, count(*) * 100 // 7000 AS percent, count(*) >= 7000 AS refused FROM s")
def _(spark, d):
    return lens.volume(stored(spark, d), 7000)


@query("s24_pack_sections", f"""WITH {FACTS}, p AS (SELECT 'facts' AS section, '{{"fact_id":' || fact_id || ',"entity":"' || entity || '","key":"' || key || '","value":"' || value || '"}}' AS line FROM facts WHERE NOT deleted AND NOT private
  UNION ALL SELECT 'sessions', '{{"session":' || user_id || ',"n":' || count(*) || '}}' FROM events GROUP BY user_id)
SELECT section, count(*) AS rows, CAST(CAST(sum(CAST('0x' || left(sha256(line), 12) AS BIGINT)) AS DECIMAL(38, 0)) AS VARCHAR) AS digest FROM p GROUP BY 1""")
def _(spark, d):
    sessions = table(spark, d, "events").groupBy(F.col("user_id").alias("session")).agg(F.count("*").alias("n"))
    return lens.pack_sections(fact_rows(spark, d), sessions)


@query("x17_dossier", f"WITH {FACTS} SELECT CASE WHEN fact_id % 5 = 0 THEN 'decision' ELSE 'constraint' END AS kind, CASE WHEN fact_id % 5 = 0 THEN 'decision:' ELSE 'constraint:' END || entity AS subject, key || '=' || value AS object, confidence FROM live WHERE fact_id % 5 < 2 UNION ALL SELECT 'dead_code', p_name, 'v' || (p_size % 3), CASE WHEN p_size % 2 = 0 THEN 0.9 ELSE 0.5 END FROM part")
def _(spark, d):
    from ..operators import facts

    k = F.col("fact_id")
    rows = fact_rows(spark, d).where(facts.visible()).withColumn("entity", F.concat(F.when(k % 5 == 0, "decision:").when(k % 5 == 1, "constraint:").otherwise("x:"), "entity"))
    verdicts = table(spark, d, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("v"), F.col("p_size") % 3).alias("verdict"), (F.col("p_size") % 2 == 0).alias("actionable"))
    return lens.dossier(rows, verdicts)


@query("x18_enriched_actions", f"""WITH {FACTS}, n AS (SELECT entity, count(*) AS related FROM facts WHERE NOT deleted AND superseded_by IS NULL GROUP BY 1)
SELECT o_orderkey AS id, o_orderpriority AS tool, ['irreversible', 'external', 'unknown', 'reversible', 'none'][o_orderkey % 5 + 1] AS consequence, coalesce(related, 0) AS related FROM orders LEFT JOIN n ON entity = 'user:' || (o_custkey % 40)""")
def _(spark, d):
    verbs = F.array(*map(F.lit, ("delete", "send", "dance", "write", "read")))
    actions = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tool"), F.get(verbs, (F.col("o_orderkey") % 5).cast("int")).alias("verb"), F.concat(F.lit("user:"), F.col("o_custkey") % 40).alias("target"))
    return lens.enriched_actions(actions, fact_rows(spark, d))


@query("wn10_newest_binding", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS newest FROM events")
def _(spark, d):
    return lens.newest_binding(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", "newest")


@query("f3_content_terms", f"SELECT doc_id, len(t) AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9_]+'), lambda x: length(x) >= 3 AND NOT list_contains({list(t.STOP_WORDS)!r}, x))) AS t FROM documents)")
def _(spark, d):
    terms = t.content_terms(F.coalesce("text", F.lit("")))
    own = table(spark, d, "documents").select("doc_id", terms.alias("t"))
    return own.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ").cast("binary")).alias("digest"))


@query("f8_chunks")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode_outer(t.chunks(F.col("text"))).alias("chunk", "text")).where("chunk is not null")


@query("f7_summaries")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", t.summary(F.col("text"), 400).alias("summary"))


@query("f9_stated_facts", "SELECT DISTINCT doc_id, kind, lower(o) AS object FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS o FROM documents" for k, p in t.FACT_PATTERNS.items()) + ")")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(t.stated_facts(F.col("text"))).alias("f")).select("doc_id", "f.kind", "f.object")
