"""Work, sessions, coordination and memories over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, work
from ..sources.tables import FACTS, LOG, fact_rows, log_rows, table

Q, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        Q[name], SQL[name] = f, sql
        return f

    return add


_ZONE = "CASE WHEN gated OR state = 'blocked' THEN 'needs_you' WHEN state = 'in_progress' THEN 'running' WHEN state = 'complete' THEN 'done_review' END"


@query("a32_attention", f"""WITH w AS (SELECT o_orderkey AS id, ['blocked', 'in_progress', 'complete', 'draft'][o_orderkey % 4 + 1] AS state, o_orderkey % 7 = 0 AS superseded FROM orders), g AS (SELECT l_orderkey * 2 AS work_id FROM lineitem WHERE l_linenumber = 5 AND l_returnflag = 'N'),
z AS (SELECT {_ZONE} AS zone FROM (SELECT state, id IN (SELECT work_id FROM g) AS gated FROM w WHERE NOT superseded)
  UNION ALL SELECT 'needs_you' FROM (SELECT DISTINCT work_id FROM g WHERE work_id NOT IN (SELECT id FROM w WHERE NOT superseded))
  UNION ALL SELECT 'running' FROM (SELECT max(epoch_us(ts)) AS t FROM events GROUP BY user_id) WHERE t <= 1706400000000000 AND 1706400000000000 - t <= 86400000000)
SELECT count(*) FILTER (zone = 'needs_you') AS needs_you, count(*) FILTER (zone = 'running') AS running, count(*) FILTER (zone = 'done_review') AS done_review, (SELECT count(*) FROM g) AS gate_pending FROM z""")
def _(spark, d):
    states = F.array(*map(F.lit, ("blocked", "in_progress", "complete", "draft")))
    plans = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.get(states, (F.col("o_orderkey") % 4).cast("int")).alias("state"), (F.col("o_orderkey") % 7 == 0).alias("superseded"))
    gates = table(spark, d, "lineitem").where("l_linenumber = 5 AND l_returnflag = 'N'").select((F.col("l_orderkey") * 2).alias("work_id"))
    sessions = table(spark, d, "events").groupBy("user_id").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_seen"))
    return work.attention(plans, gates, sessions, 1706400000000000, 86400000000)


_INTENTS = """i AS (SELECT c_custkey AS session, 'p' || (c_custkey % 10) AS passport, 's' || (c_custkey % 40) AS slug, CASE WHEN c_custkey % 13 = 1 THEN 'prod' END AS target, ['src/a' || (c_custkey % 30) || '/', 'lib/' || (c_custkey % 17) || '/x' || (c_custkey % 3)] AS paths, c_custkey % 4 <> 0 AS live FROM customer)"""


def intents(spark, d):
    k = F.col("c_custkey")
    paths = F.array(F.concat(F.lit("src/a"), k % 30, F.lit("/")), F.concat(F.lit("lib/"), k % 17, F.lit("/x"), k % 3))
    return table(spark, d, "customer").select(k.alias("session"), F.concat(F.lit("p"), k % 10).alias("passport"), F.concat(F.lit("s"), k % 40).alias("slug"), F.when(k % 13 == 1, "prod").alias("target"), paths.alias("paths"), (k % 4 != 0).alias("live"))


_MEETS = "(rtrim(m, '/') = rtrim(t, '/') OR starts_with(rtrim(m, '/'), rtrim(t, '/') || '/') OR starts_with(rtrim(t, '/'), rtrim(m, '/') || '/'))"


@query("x7_overlaps", f"""WITH {_INTENTS}, a AS (SELECT * FROM i WHERE session IN (1, 2, 27)), p AS (SELECT * FROM i WHERE live), l AS (SELECT 'p' || s_suppkey AS holder, CASE WHEN s_suppkey % 2 = 0 THEN 'lib/' || (s_suppkey % 17) ELSE 'src/a' || s_suppkey || '/deep/er' END AS path FROM supplier)
SELECT a.session, CAST(p.session AS VARCHAR) AS peer, 'execplan' AS kind, p.slug AS theirs, a.slug AS yours FROM a JOIN p USING (slug) WHERE a.session <> p.session
UNION ALL SELECT a.session, CAST(p.session AS VARCHAR), 'deploy_target', p.target, a.target FROM a JOIN p USING (target) WHERE a.session <> p.session
UNION ALL SELECT DISTINCT a.session, CAST(p.session AS VARCHAR), 'intent_path', t, m FROM (SELECT *, unnest(paths) AS m FROM a) a, (SELECT *, unnest(paths) AS t FROM p) p WHERE a.session <> p.session AND {_MEETS}
UNION ALL SELECT DISTINCT a.session, holder, 'lease', t, m FROM (SELECT *, unnest(paths) AS m FROM a) a, (SELECT holder, path AS t FROM l) WHERE a.passport <> holder AND {_MEETS}""")
def _(spark, d):
    every = intents(spark, d)
    s = F.col("s_suppkey")
    leases = table(spark, d, "supplier").select(F.concat(F.lit("p"), s).alias("holder"), F.when(s % 2 == 0, F.concat(F.lit("lib/"), s % 17)).otherwise(F.concat(F.lit("src/a"), s, F.lit("/deep/er"))).alias("path"))
    return work.overlaps(every.where("session in (1, 2, 27)"), every, leases)


@query("x8_board", """WITH s AS (SELECT user_id AS session, 'p' || (user_id % 10) AS passport, max(ts) AS last_seen FROM events GROUP BY user_id), n AS (SELECT user_id AS session, arg_max('s' || event_id, (ts, 's' || event_id)) AS slug, count(*) AS intents FROM events WHERE event_type = 'click' GROUP BY 1), l AS (SELECT 'p' || (s_suppkey % 20) AS passport, count(*) AS leases FROM supplier GROUP BY 1)
SELECT session, passport, last_seen, slug, coalesce(intents, 0) AS intents, coalesce(leases, 0) AS leases FROM s LEFT JOIN n USING (session) LEFT JOIN l USING (passport)""")
def _(spark, d):
    e = table(spark, d, "events")
    sessions = e.groupBy(F.col("user_id").alias("session")).agg(F.concat(F.lit("p"), F.min("user_id") % 10).alias("passport"), F.max("ts").alias("last_seen"))
    own = e.where("event_type = 'click'").select(F.col("user_id").alias("session"), F.concat(F.lit("s"), "event_id").alias("slug"), F.col("ts").alias("at"))
    return work.board(sessions, own, table(spark, d, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey") % 20).alias("holder")))


@query("x6_fleet_rollup", """WITH c AS (SELECT 't' || unnest(range(0, 60)) AS tool), k AS (SELECT 't' || (event_id % 70) AS tool, user_id AS passport, CAST(round(value) AS BIGINT) AS tokens, event_type = 'error' AS error, CASE WHEN event_id % 9 > 0 THEN event_id % 37 END AS latency FROM events WHERE event_id % 70 < 50 OR event_id % 70 > 62),
o AS (SELECT 't' || (user_id % 65) AS tool, user_id AS passport FROM events), b AS (SELECT tool, count(*) AS calls, count(*) FILTER (error) AS errors, sum(tokens)::BIGINT AS tokens, count(DISTINCT passport) AS passports, list_sort(list(latency) FILTER (latency IS NOT NULL)) AS each FROM k GROUP BY 1), r AS (SELECT tool, count(DISTINCT passport) AS n FROM o GROUP BY 1),
j AS (SELECT coalesce(c.tool, b.tool) AS tool, c.tool IS NOT NULL AS in_catalog, b.* EXCLUDE (tool) FROM c FULL JOIN b ON c.tool = b.tool)
SELECT tool, in_catalog, coalesce(calls, 0) AS calls, coalesce(errors, 0) AS errors, coalesce(round(errors / calls, 4), 0) AS error_rate, coalesce(passports, 0) AS passports, coalesce(tokens // calls, 0) AS avg_tokens, each[len(each) // 2 + 1] AS p50, coalesce(n, 0) AS offered_passports,
CASE WHEN calls > 0 THEN 'active' WHEN n > 0 THEN 'offered_never_called' ELSE 'never_offered' END AS classification FROM j LEFT JOIN r USING (tool)""")
def _(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    catalog = spark.range(0, 60).select(F.concat(F.lit("t"), "id").alias("tool"))
    calls = e.where((k % 70 < 50) | (k % 70 > 62)).select(F.concat(F.lit("t"), k % 70).alias("tool"), F.col("user_id").alias("passport"), F.round("value").cast("long").alias("tokens"), (F.col("event_type") == "error").alias("error"), F.when(k % 9 > 0, k % 37).alias("latency"))
    return work.fleet_rollup(catalog, calls, e.select(F.concat(F.lit("t"), F.col("user_id") % 65).alias("tool"), F.col("user_id").alias("passport")))


_RULES = [{"id": "c1", "severity": "critical", "pattern": r"\d{3}-\d{4}"}, {"id": "c2", "severity": "high", "terms": ["the", "with", "and"], "least": 3}, {"id": "c3", "severity": "high", "pattern": "(?i)license"}, {"id": "c4", "severity": "critical", "pattern": ".", "active": False}]


@query("x3_constraint_check", r"""WITH w AS (SELECT doc_id AS id, regexp_matches(text, '[0-9]{3}-[0-9]{4}') AS a, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')), ['the', 'with', 'and'])) >= 3 AS b, regexp_matches(text, '(?i)license') AS c FROM documents)
SELECT id, array_to_string(list_filter([CASE WHEN a THEN 'c1' END, CASE WHEN b THEN 'c2' END, CASE WHEN c THEN 'c3' END], lambda x: x IS NOT NULL), ',') AS hits, CASE WHEN a THEN 'block' WHEN b OR c THEN 'warn' ELSE 'pass' END AS verdict FROM w""")
def _(spark, d):
    return work.constraint_check(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")), _RULES)


@query("x4_reuse_check", r"""WITH c AS (SELECT p_partkey AS id, list_distinct(regexp_split_to_array(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^\p{L}\p{N}]+')) AS w FROM part), n AS (SELECT id, len(list_intersect(w, ['brand', '12', 'part', 'steel', '7'])) AS s FROM c),
h AS (SELECT doc_id, n_chars::DOUBLE AS score FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5)
SELECT 0 AS source, CAST(id AS VARCHAR) AS id, s::DOUBLE AS score FROM n WHERE s >= 2 UNION ALL SELECT 1, CAST(doc_id AS VARCHAR), score FROM h""")
def _(spark, d):
    own = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))
    hits = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return work.reuse_check(own, ["brand", "12", "part", "steel", "7"], 2, hits, 5)


@query("x9_feature_files", "SELECT o_custkey AS feature, f AS file FROM (SELECT o_custkey, unnest(list_distinct(list('src/' || lower(o_orderpriority) || '/' || (o_orderkey % 9)))) AS f FROM orders GROUP BY 1) WHERE contains(lower(f), 'urgent/3')")
def _(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("feature")).agg(F.collect_set(F.concat(F.lit("src/"), F.lower("o_orderpriority"), F.lit("/"), F.col("o_orderkey") % 9)).alias("files"))
    return work.feature_files(o, "URGENT/3")


_WORDS = [("code", 0, "the"), ("code", 0, "with"), ("docs", 1, "and"), ("docs", 1, "src1"), ("ops", 2, "of"), ("ops", 2, "en")]


@query("x11_classified", r"""WITH k(class, place, word) AS (VALUES ('code', 0, 'the'), ('code', 0, 'with'), ('docs', 1, 'and'), ('docs', 1, 'src1'), ('ops', 2, 'of'), ('ops', 2, 'en')),
w AS (SELECT doc_id AS id, 3 AS weight, 999999 AS cap, unnest(regexp_split_to_array(lower(source), '[^\p{L}\p{N}]+')) AS word FROM documents UNION ALL SELECT doc_id, 2, 999999, unnest(regexp_split_to_array(lower(lang), '[^\p{L}\p{N}]+')) FROM documents UNION ALL SELECT doc_id, 1, 3, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) FROM documents),
n AS (SELECT id, weight, word, weight * least(count(*), any_value(cap)) AS points FROM w GROUP BY 1, 2, 3), s AS (SELECT id, class, place, sum(points)::BIGINT AS score FROM n JOIN k USING (word) GROUP BY ALL)
SELECT d.doc_id AS id, coalesce(arg_max(class, (score, -place)), 'other') AS class, coalesce(max(score), 0) AS score FROM documents d LEFT JOIN s ON d.doc_id = s.id GROUP BY 1""")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("slug"), F.col("lang").alias("title"), F.col("text").alias("body"))
    return work.classified(docs, F.broadcast(spark.createDataFrame(_WORDS, "class string, place int, word string")), "other")


_BOOK = """b AS (SELECT event_id AS fact_id, CASE event_type WHEN 'click' THEN '__session_binding__::' || event_id WHEN 'view' THEN '__reverify_receipts__::' || event_id ELSE 'x' END AS entity, CASE WHEN event_id % 10 > 0 THEN 'p' || (user_id % 6) END AS passport, ts AS stored_at, event_id % 17 = 0 AS deleted FROM events)"""


@query("x12_ephemeral", f"""WITH {_BOOK}, n AS (SELECT *, row_number() OVER (PARTITION BY passport ORDER BY stored_at DESC, fact_id DESC) AS nth FROM b WHERE NOT deleted AND starts_with(entity, '__session_binding__::') AND passport IS NOT NULL)
SELECT fact_id FROM b WHERE NOT deleted AND starts_with(entity, '__reverify_receipts__::') AND TIMESTAMP '2024-02-01' - stored_at > INTERVAL 10 DAY
UNION ALL SELECT fact_id FROM n WHERE nth > 3 AND TIMESTAMP '2024-02-01' - stored_at > INTERVAL 48 HOUR""")
def _(spark, d):
    k = F.col("event_id")
    entity = F.when(F.col("event_type") == "click", F.concat(F.lit("__session_binding__::"), k)).when(F.col("event_type") == "view", F.concat(F.lit("__reverify_receipts__::"), k)).otherwise("x")
    rows = table(spark, d, "events").select(k.alias("fact_id"), entity.alias("entity"), F.when(k % 10 > 0, F.concat(F.lit("p"), F.col("user_id") % 6)).alias("passport"), F.col("ts").alias("stored_at"), (k % 17 == 0).alias("deleted"))
    return work.ephemeral(rows, F.lit("2024-02-01").cast("timestamp_ntz"), "10 days", "48 hours", 3)


@query("x13_import_plan", f"""WITH {FACTS}, p AS (SELECT fact_id, CASE WHEN fact_id % 3 = 0 THEN 'new:' || fact_id ELSE entity END AS entity, key, value, deleted FROM facts WHERE fact_id % 2 = 0), s AS (SELECT entity, key, value, CASE WHEN fact_id % 4 = 0 THEN 'pack-1' END AS receipt FROM facts WHERE NOT deleted AND fact_id % 5 < 3)
SELECT fact_id, CASE WHEN (entity, key, value) IN (SELECT (entity, key, value) FROM s WHERE receipt = 'pack-1') THEN 'skip' WHEN (entity, key) IN (SELECT (entity, key) FROM s) THEN 'collide' ELSE 'add' END AS action FROM p WHERE NOT deleted""")
def _(spark, d):
    rows = fact_rows(spark, d)
    pack = rows.where("fact_id % 2 = 0").withColumn("entity", F.when(F.col("fact_id") % 3 == 0, F.concat(F.lit("new:"), "fact_id")).otherwise(F.col("entity")))
    store = rows.where("fact_id % 5 < 3").withColumn("source_receipt", F.when(F.col("fact_id") % 4 == 0, "pack-1"))
    return work.import_plan(pack.select("fact_id", "entity", "key", "value", "deleted"), store, "pack-1")


_RULE = [("user:1", "ones"), ("user:2", "twos")]
_COLL = "CASE WHEN starts_with(entity, 'user:1') THEN 'ones' WHEN starts_with(entity, 'user:2') THEN 'twos' ELSE 'rest' END"


def collected(spark, d):
    return fact_rows(spark, d).withColumn("collection", work.collection(F.col("entity"), _RULE, "rest"))


@query("x14_collection_page", f"WITH {FACTS} SELECT fact_id, CASE WHEN NOT deleted THEN value END AS value FROM facts WHERE {_COLL} = 'ones' AND (stored_at, fact_id) > (TIMESTAMP '2024-01-05', 9) ORDER BY stored_at, fact_id LIMIT 30")
def _(spark, d):
    return work.collection_page(collected(spark, d), "ones", ("2024-01-05 00:00:00", 9), 30).select("fact_id", "value")


@query("x14_manifest", f"WITH {FACTS} SELECT {_COLL} AS collection, count(*) FILTER (NOT deleted) AS facts, count(*) FILTER (deleted) AS tombstones, max(stored_at) AS newest FROM facts GROUP BY 1")
def _(spark, d):
    return work.manifest(collected(spark, d))


@query("x15_storage_breakdown", "SELECT source AS lane, count(*) AS n, sum(coalesce(strlen(text), 0))::BIGINT AS bytes FROM documents GROUP BY 1 UNION ALL SELECT role, count(*), sum(coalesce(strlen(text), 0))::BIGINT FROM conversations GROUP BY 1")
def _(spark, d):
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")
    return table(spark, d, "documents").groupBy(F.col("source").alias("lane")).agg(F.count("*").alias("n"), size).union(table(spark, d, "conversations").groupBy("role").agg(F.count("*"), size))


@query("x16_review_queue", f"""WITH {FACTS}, c AS (SELECT tenant || '/' || entity || '/' || key AS subject FROM facts WHERE NOT deleted AND NOT private AND superseded_by IS NULL AND fact_id % 2 = 0)
SELECT 'receipt' AS kind, 'doc:' || event_id AS subject, ts AS at FROM events WHERE event_type = 'signup' UNION ALL SELECT 'contradiction', subject, NULL FROM c""")
def _(spark, d):
    receipts = table(spark, d, "events").where("event_type = 'signup'").select(F.concat(F.lit("doc:"), "event_id").alias("subject"), F.col("ts").alias("at"))
    rows = fact_rows(spark, d).where(facts.visible()).where("fact_id % 2 = 0")
    return work.review_queue(receipts, rows.select(F.concat_ws("/", "tenant", "entity", "key").alias("subject")))


@query("t11_activity", "SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-12' ORDER BY ts DESC, event_id DESC LIMIT 40")
def _(spark, d):
    return work.before(table(spark, d, "events"), "ts", F.lit("2024-01-12").cast("timestamp_ntz"), 40, "event_id").select("event_id", "ts")


@query("t14_status_feed", "SELECT * FROM (SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25) ORDER BY ts, event_id")
def _(spark, d):
    return work.before(table(spark, d, "events"), "ts", F.lit("2100-01-01").cast("timestamp_ntz"), 25, "event_id").select("event_id", "ts", "event_type").orderBy("ts", "event_id")


@query("t15_entity_list", "SELECT DISTINCT event_type AS kind, user_id AS id FROM events ORDER BY 1, 2")
def _(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("id")).distinct().orderBy("kind", "id")


@query("t16_expiring", f"WITH {FACTS} SELECT fact_id, stored_at FROM live WHERE stored_at < TIMESTAMP '2024-01-28' ORDER BY stored_at, fact_id LIMIT 500")
def _(spark, d):
    return work.expiring(fact_rows(spark, d).where(facts.visible()), F.lit("2024-01-28").cast("timestamp"), 700).select("fact_id", "stored_at")


@query("p14_offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 60")
def _(spark, d):
    return work.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 60, 20)[0]


@query("p13_tenant_spans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CASE WHEN l_linenumber % 3 = 0 THEN 'home' WHEN l_linenumber % 3 = 1 THEN 't' || (l_orderkey % 3) ELSE 'home' END = 'home'")
def _(spark, d):
    n = F.col("l_linenumber")
    spans = table(spark, d, "lineitem").select("l_orderkey", n, F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("t"), F.col("l_orderkey") % 3)).alias("tenant_id"))
    return work.of_tenant(spans, "home", "home").select("l_orderkey", "l_linenumber")


@query("p15_kind_schema", """WITH p AS (SELECT event_id AS id, event_id % 6 AS c, event_type AS t FROM events)
SELECT id, array_to_string(list_sort(list_filter([CASE WHEN c = 1 THEN 'n:missing' END, CASE WHEN c = 2 THEN 'n:type' END, CASE WHEN c = 3 THEN 't:type' END, CASE WHEN c = 3 OR (c <> 4 AND t NOT IN ('click', 'view')) THEN 't:enum' END], lambda x: x IS NOT NULL)), ',') AS errors FROM p
WHERE c IN (1, 2, 3) OR (c <> 4 AND t NOT IN ('click', 'view'))""")
def _(spark, d):
    c = F.col("event_id") % 6
    n = F.when(c == 1, "").when(c == 2, '"n": "x", ').otherwise('"n": 4.5, ')
    t = F.when(c == 3, '"t": 7').when(c == 4, '"t": null').otherwise(F.concat(F.lit('"t": "'), "event_type", F.lit('"')))
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("{"), n, t, F.lit("}")).alias("payload"))
    return work.invalid_fields(rows, [{"name": "n", "type": "number", "required": True}, {"name": "t", "type": "string", "enum": ["click", "view"]}])


@query("p16_field_patch", f"WITH {LOG} SELECT stream_id, arg_max(value, seq) FILTER (seq % 2 = 0) AS value, arg_max(event_type, seq) FILTER (seq % 3 > 0) AS event_type FROM log GROUP BY 1")
def _(spark, d):
    mask = F.array_compact(F.array(F.when(F.col("seq") % 2 == 0, "value"), F.when(F.col("seq") % 3 > 0, "event_type")))
    return work.patched(log_rows(spark, d).withColumn("mask", mask), ["stream_id"], "seq", ["value", "event_type"])


_EVIDENCE = f"""{FACTS}, e AS (SELECT fact_id % 40 AS answer, CASE WHEN fact_id % 11 = 0 THEN -fact_id ELSE fact_id END AS record_id, CASE WHEN fact_id % 7 = 0 THEN 'x' ELSE sha256(value) END AS text_hash FROM facts WHERE fact_id % 3 = 0),
o AS (SELECT fact_id, tenant, entity, key, sha256(value) AS h, version FROM facts WHERE NOT deleted), n AS (SELECT tenant, entity, key, arg_max(fact_id, (version, fact_id)) AS latest FROM o GROUP BY ALL),
s AS (SELECT answer, record_id, CASE WHEN fact_id IS NULL THEN 'missing' WHEN latest <> record_id THEN 'superseded' WHEN text_hash = h THEN 'current' ELSE 'changed' END AS status, latest FROM e LEFT JOIN o ON record_id = fact_id LEFT JOIN n USING (tenant, entity, key))"""


def evidence(spark, d):
    rows = fact_rows(spark, d)
    k = F.col("fact_id")
    own = rows.where(k % 3 == 0).select((k % 40).alias("answer"), F.when(k % 11 == 0, -k).otherwise(k).alias("record_id"), F.when(k % 7 == 0, "x").otherwise(F.sha2(F.col("value").cast("binary"), 256)).alias("text_hash"))
    return work.evidence_status(own, rows)


@query("j16_evidence_status", f"WITH {_EVIDENCE} SELECT * FROM s")
def _(spark, d):
    return evidence(spark, d)


@query("r27_answer_validity", f"WITH {_EVIDENCE} SELECT answer, count(*) AS evidence, count(*) FILTER (status = 'current') AS current, coalesce(string_agg(DISTINCT 'fact_' || status, ',' ORDER BY 'fact_' || status) FILTER (status <> 'current'), '') AS drift, count(*) = count(*) FILTER (status = 'current') AS valid FROM s GROUP BY 1")
def _(spark, d):
    return work.answer_validity(evidence(spark, d))


@query("j19_section_diff", "WITH a AS (SELECT p_partkey AS section, p_size % 3 AS digest FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS section, p_size % 4 AS digest FROM part WHERE p_partkey % 7 <> 0) SELECT section, CASE WHEN a.digest IS NULL THEN 'added' WHEN b.digest IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (section) WHERE a.digest IS NULL OR b.digest IS NULL OR a.digest <> b.digest")
def _(spark, d):
    p = table(spark, d, "part")
    side = lambda n, m: p.where(F.col("p_partkey") % n != 0).select(F.col("p_partkey").alias("section"), (F.col("p_size") % m).alias("digest"))
    return work.sections_diff(side(5, 3), side(7, 4))


_FILES = """f AS (SELECT doc_id % 3 AS root, 'm' || (doc_id // 2) AS slug, '[[m' || (doc_id % 90) || ']] [[m' || (doc_id // 2) || '|self]] [[gone' || (doc_id % 7) || '#x]] ' || coalesce(text, '') AS text FROM documents),
m AS (SELECT slug, root, text FROM f QUALIFY row_number() OVER (PARTITION BY slug ORDER BY root, text) = 1)"""


def files(spark, d):
    k = F.col("doc_id")
    slug = F.concat(F.lit("m"), F.expr("doc_id div 2"))
    text = F.concat(F.lit("[[m"), k % 90, F.lit("]] [["), slug, F.lit("|self]] [[gone"), k % 7, F.lit("#x]] "), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select((k % 3).alias("root"), slug.alias("slug"), text.alias("text"))


@query("s19_memories", f"WITH {_FILES} SELECT slug, root, md5(text) AS digest FROM m")
def _(spark, d):
    return work.memories(files(spark, d)).select("slug", "root", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("j20_memory_links", rf"WITH {_FILES}, l AS (SELECT DISTINCT slug, trim(target) AS target FROM (SELECT slug, unnest(regexp_extract_all(text, '\[\[([^\]|#]+)', 1)) AS target FROM m)) SELECT slug, target, target NOT IN (SELECT slug FROM m) AS dangling FROM l WHERE slug <> target")
def _(spark, d):
    return work.memory_links(work.memories(files(spark, d)))


@query("r13_memory_search", f"""WITH {_FILES}, s AS (SELECT slug, (CAST(contains(lower(slug || ' ' || text), 'gone3') AS INTEGER) + CAST(contains(lower(slug || ' ' || text), 'the') AS INTEGER) + CAST(contains(lower(slug || ' ' || text), 'm1') AS INTEGER)) / 3 AS score FROM m)
SELECT slug, round(score, 6) AS score FROM s WHERE score >= 0.5 ORDER BY s.score DESC, slug LIMIT 30""")
def _(spark, d):
    return work.memory_search(work.memories(files(spark, d)), ["gone3", "the", "m1"], 0.5, 30).withColumn("score", F.round("score", 6))


@query("r25_shard_routing", "SELECT event_id, CASE WHEN k <= 10 THEN 'a' WHEN k <= 45 THEN 'b' WHEN k <= 80 THEN 'c' ELSE 'a' END AS shard FROM (SELECT event_id, event_id % 100 AS k FROM events)")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 100).alias("k"))
    return work.routed(rows, "k", [(45, "b"), (10, "a"), (80, "c")]).select("event_id", "shard")


@query("r26_sample", "SELECT o_orderkey FROM orders WHERE CAST('0x' || left(sha256(CAST(o_orderkey AS VARCHAR)), 12) AS BIGINT) / 281474976710656 < 0.2")
def _(spark, d):
    return work.sampled(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2)


@query("so6_repositories", "SELECT 'a:' || p_name AS path, p_size AS loc FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'b:' || p_name, p_size FROM part WHERE p_partkey % 3 = 0")
def _(spark, d):
    p = table(spark, d, "part")
    side = lambda n: p.where(F.col("p_partkey") % n == 0).select(F.col("p_name").alias("path"), F.col("p_size").alias("loc"))
    return work.repositories({"a": side(2), "b": side(3)})


@query("j23_bundles", "WITH c AS (SELECT p_partkey AS file, 'c' || (p_partkey % 7) AS crate FROM part) SELECT a.crate AS from_crate, b.crate AS to_crate, sum(l_linenumber)::BIGINT AS refs FROM lineitem JOIN c a ON l_partkey = a.file JOIN c b ON l_suppkey = b.file WHERE a.crate <> b.crate GROUP BY 1, 2")
def _(spark, d):
    crates = table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.concat(F.lit("c"), F.col("p_partkey") % 7).alias("crate"))
    refs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("to_file"), F.col("l_linenumber").cast("long").alias("calls"))
    return work.bundles(refs, crates)


@query("a24_spatial_map", """WITH c AS (SELECT 'c' || (p_partkey % 30) AS crate, sum(p_size)::BIGINT AS loc, count(*) AS files FROM part GROUP BY 1), n AS (SELECT *, CAST(row_number() OVER (ORDER BY loc DESC, crate) - 1 AS INTEGER) AS place FROM c),
r AS (SELECT *, CAST(ceil((sqrt(place + 1) - 1) / 2) AS INTEGER) AS k FROM n), s AS (SELECT *, place - (2 * k - 1) * (2 * k - 1) AS step, greatest(2 * k, 1) AS side FROM r)
SELECT crate, loc, files, place, CASE WHEN k = 0 THEN 0 WHEN step // side = 0 THEN k WHEN step // side = 1 THEN k - step % side - 1 WHEN step // side = 2 THEN -k ELSE -k + step % side + 1 END AS x,
CASE WHEN k = 0 THEN 0 WHEN step // side = 0 THEN -k + step % side + 1 WHEN step // side = 1 THEN k WHEN step // side = 2 THEN k - step % side - 1 ELSE -k END AS y FROM s""")
def _(spark, d):
    return work.spatial_map(table(spark, d, "part").select(F.concat(F.lit("c"), F.col("p_partkey") % 30).alias("crate"), F.col("p_size").alias("loc")))
