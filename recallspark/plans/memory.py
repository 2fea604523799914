"""Facts and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decay
from ..operators import budget, facts, log
from ..sources.tables import FACTS, LOG, fact_rows, log_rows, table

NOW = "2024-02-01 00:00:00"
Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def live(spark, d):
    return fact_rows(spark, d).where(facts.visible())


@query("p1_visible_facts", f"WITH {FACTS} SELECT tenant, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM live GROUP BY tenant")
def _(spark, d):
    return live(spark, d).groupBy("tenant").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query("p2_entity_prefix", f"WITH {FACTS} SELECT fact_id, entity, key FROM live WHERE entity LIKE 'user:1%' AND key = 'click'")
def _(spark, d):
    return live(spark, d).where(F.startswith("entity", F.lit("user:1")) & (F.col("key") == "click")).select("fact_id", "entity", "key")


@query("p3_any_term", f"WITH {FACTS} SELECT fact_id, value FROM live WHERE contains(lower(value), '9.1') OR contains(lower(key), '9.1') OR contains(lower(entity), '9.1') OR contains(lower(value), 'view') OR contains(lower(key), 'view') OR contains(lower(entity), 'view')")
def _(spark, d):
    return live(spark, d).where(facts.any_term("9.1 VIEW")).select("fact_id", "value")


@query("p4_valid_at", f"WITH {FACTS} SELECT fact_id, version FROM facts WHERE (valid_from IS NULL OR TIMESTAMP '2024-01-15' >= valid_from) AND (valid_to IS NULL OR TIMESTAMP '2024-01-15' < valid_to)")
def _(spark, d):
    return fact_rows(spark, d).where(facts.valid_at(F.lit("2024-01-15").cast("timestamp"))).select("fact_id", "version")


@query("p10_confidence_floor", f"WITH {FACTS} SELECT count(*) FILTER (confidence >= 0.45) AS kept, count(*) FILTER (confidence < 0.45) AS dropped FROM live")
def _(spark, d):
    return facts.above_floor(live(spark, d), 0.45)


@query("wn1_versions", f"WITH {FACTS} SELECT fact_id, version, supersedes, superseded_by FROM facts")
def _(spark, d):
    return fact_rows(spark, d).select("fact_id", "version", "supersedes", "superseded_by")


@query("a6_latest_version", f"WITH {FACTS} SELECT tenant, entity, key, max(version) AS version, arg_max(value, version) AS value FROM facts WHERE NOT deleted GROUP BY ALL")
def _(spark, d):
    return facts.latest(fact_rows(spark, d).where("not deleted")).select("tenant", "entity", "key", "version", "value")


@query("b1_recall_budget", f"""WITH {FACTS}, r AS (SELECT *, row_number() OVER w AS rank, sum(tokens) OVER (ORDER BY confidence DESC, stored_at DESC, fact_id) AS used FROM live WINDOW w AS (ORDER BY confidence DESC, stored_at DESC, fact_id))
SELECT fact_id, CAST(rank AS INTEGER) AS rank, used::BIGINT AS used FROM r WHERE rank = 1 OR (used <= 200 AND used - tokens < 200)""")
def _(spark, d):
    return facts.recall(live(spark, d), 200).select("fact_id", "rank", "used")


@query("b2_prefix_stop", f"""WITH {FACTS}, r AS (SELECT *, row_number() OVER w AS rank, sum(tokens) OVER (PARTITION BY entity ORDER BY fact_id) AS used FROM live WINDOW w AS (PARTITION BY entity ORDER BY fact_id))
SELECT entity, fact_id, CAST(rank AS INTEGER) AS rank, used::BIGINT AS used FROM r WHERE rank = 1 OR used <= 15""")
def _(spark, d):
    return budget.prefix_stop(live(spark, d), ["entity"], ["fact_id"], "tokens", 15, early=False).select("entity", "fact_id", "rank", "used")


def _fold(first: str, start: str, b: int) -> str:
    return f"""WITH RECURSIVE {FACTS}, r AS (SELECT entity, fact_id, tokens + fact_id % 5 AS t, row_number() OVER (PARTITION BY entity ORDER BY confidence DESC, fact_id) AS rank FROM facts WHERE NOT deleted),
f AS (SELECT entity, rank, fact_id, CASE WHEN {start} THEN t ELSE 0 END AS used, {start} AS kept FROM r WHERE rank = 1
  UNION ALL SELECT r.entity, r.rank, r.fact_id, CASE WHEN f.used < {b} AND f.used + r.t <= {b} THEN f.used + r.t ELSE f.used END, f.used < {b} AND f.used + r.t <= {b}
  FROM f JOIN r ON r.entity = f.entity AND r.rank = f.rank + 1)
SELECT entity, fact_id, CAST(rank AS INTEGER) AS rank, used::BIGINT AS used FROM f WHERE kept"""


@query("b3_skip_and_continue", _fold("", "true", 30))
def _(spark, d):
    rows = fact_rows(spark, d).where("not deleted").withColumn("t", F.col("tokens") + F.col("fact_id") % 5)
    return budget.skip_and_continue(rows, ["entity"], [F.desc("confidence"), "fact_id"], "t", 30).select("entity", "fact_id", "rank", "used")


@query("b4_skip_no_exemption", _fold("", "t <= 6", 6))
def _(spark, d):
    rows = fact_rows(spark, d).where("not deleted").withColumn("t", F.col("tokens") + F.col("fact_id") % 5)
    return budget.skip_and_continue(rows, ["entity"], [F.desc("confidence"), "fact_id"], "t", 6, exempt_first=False).select("entity", "fact_id", "rank", "used")


@query("b5_pointer_budget", f"WITH {FACTS} SELECT fact_id, confidence FROM live ORDER BY confidence DESC, stored_at DESC, fact_id LIMIT 12")
def _(spark, d):
    return live(spark, d).orderBy(F.desc("confidence"), F.desc("stored_at"), "fact_id").limit(budget.pointer_limit(500)).select("fact_id", "confidence")


@query("a1_a3_aggregates", f"""WITH {FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY fact_id) AS rank, sum(tokens) OVER (PARTITION BY key ORDER BY fact_id) AS used FROM live),
k AS (SELECT key, count(*) AS n, round(sum(TRY_CAST(replace(value, ',', '') AS DOUBLE)), 4) AS sum_numeric, count(DISTINCT value) AS n_distinct FROM r WHERE rank = 1 OR used <= 400 GROUP BY key)
SELECT k.*, n < (SELECT count(*) FROM live l WHERE l.key = k.key) AS truncated FROM k""")
def _(spark, d):
    return facts.aggregate_scan(live(spark, d), ["key"], 400).withColumn("sum_numeric", F.round("sum_numeric", 4))


@query("a4_temporal_diff", f"""WITH {FACTS}, p AS (SELECT *, CAST(value AS DOUBLE) AS v, max(CASE WHEN private THEN version END) OVER (PARTITION BY tenant, entity, key) AS broken FROM facts WHERE NOT deleted),
g AS (SELECT tenant, entity, key, count(*) AS links, arg_max(v, version) AS current, arg_max(v, version) FILTER (stored_at <= TIMESTAMP '2024-01-15') AS "then", arg_min(v, version) AS oldest
  FROM p WHERE broken IS NULL OR version > broken GROUP BY ALL)
SELECT tenant, entity, key, links, current, "then", oldest, round(current - "then", 4) AS diff FROM g""")
def _(spark, d):
    return facts.temporal_diff(fact_rows(spark, d), F.lit("2024-01-15").cast("timestamp")).withColumn("diff", F.round("diff", 4))


@query("a5_entities", f"WITH {FACTS} SELECT DISTINCT entity FROM facts WHERE NOT deleted")
def _(spark, d):
    return fact_rows(spark, d).where("not deleted").select("entity").distinct()


_POL = "CASE WHEN CAST(fact_id AS BIGINT) % 4 = 0 THEN ' Yes. ' WHEN fact_id % 4 = 1 THEN 'rejected' WHEN fact_id % 4 = 2 THEN 'ON' ELSE 'maybe' END"


@query("a7_contradictions", f"""WITH {FACTS}, p AS (SELECT tenant, entity, key, fact_id, CASE fact_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'positive' END AS class FROM facts WHERE NOT deleted AND NOT private AND (fact_id % 3 = 0 OR superseded_by IS NULL)),
g AS (SELECT tenant, entity, key, string_agg(DISTINCT class, ',' ORDER BY class) AS classes, count(*) AS n_facts FROM p WHERE class IS NOT NULL GROUP BY ALL HAVING count(DISTINCT class) >= 2)
SELECT tenant, entity, key, classes, n_facts, fact_id FROM g JOIN p USING (tenant, entity, key) WHERE class IS NOT NULL""")
def _(spark, d):
    # every third fact was never resolved against its chain
    rows = fact_rows(spark, d).withColumn("superseded_by", F.when(F.col("fact_id") % 3 != 0, F.col("superseded_by")))
    return facts.contradictions(rows.withColumn("value", F.expr(_POL)))


@query("t4_dense_ranking", f"""WITH {FACTS}, q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 3),
v AS (SELECT vec_id AS fact_id, list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))) AS c FROM embeddings, q),
s AS (SELECT fact_id, stored_at, coalesce(c, 0) AS cosine, 0.6 * coalesce(c, 0) + 0.4 * confidence AS score FROM live LEFT JOIN v USING (fact_id))
SELECT fact_id, round(cosine, 6) AS cosine, round(score, 6) AS score FROM s ORDER BY s.score DESC, stored_at DESC, fact_id LIMIT 50""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    ranked = facts.dense_rank(live(spark, d), e.select(F.col("vec_id").alias("fact_id"), "embedding"), e.where("vec_id = 3").select(F.col("embedding").alias("q")))
    return ranked.orderBy(F.desc("score"), F.desc("stored_at"), "fact_id").limit(50).select("fact_id", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


_FRESH = f"""f AS (SELECT *, CASE WHEN horizon IS NULL THEN 'fresh' WHEN epoch_us(TIMESTAMP '{NOW}') < epoch_us(stored_at) THEN 'unknown'
  WHEN (epoch_us(TIMESTAMP '{NOW}') - epoch_us(stored_at)) / 3.6e9 > CASE horizon WHEN 'short' THEN 24 WHEN 'medium' THEN 840 ELSE 8760 END * least(greatest(1 + 0.25 * ln(1 + accesses), 1), 4) THEN 'stale' ELSE 'fresh' END AS freshness FROM live)"""


def fresh(spark, d):
    state = decay.freshness(F.col("horizon"), F.col("stored_at"), F.lit(NOW).cast("timestamp"), F.col("accesses"))
    return live(spark, d).withColumn("freshness", state)


@query("r14_freshness", f"WITH {FACTS}, {_FRESH} SELECT horizon, freshness, count(*) AS n FROM f GROUP BY ALL")
def _(spark, d):
    return fresh(spark, d).groupBy("horizon", "freshness").agg(F.count("*").alias("n"))


@query("r15_decayed_recall", f"WITH {FACTS}, {_FRESH} SELECT fact_id, CASE WHEN freshness = 'stale' THEN confidence * 0.5 ELSE confidence END AS effective FROM f ORDER BY effective DESC, stored_at DESC, fact_id LIMIT 40")
def _(spark, d):
    return effective(spark, d).orderBy(F.desc("effective"), F.desc("stored_at"), "fact_id").limit(40).select("fact_id", "effective")


def effective(spark, d):
    return fresh(spark, d).withColumn("effective", decay.effective(F.col("confidence"), F.col("freshness")))


_MATCH = """((CASE WHEN contains(lower(entity), 'view') OR contains(lower(key), 'view') OR regexp_matches(value, '(^|[^A-Za-z0-9_])view($|[^A-Za-z0-9_])', 'i') THEN 1.0 WHEN contains(lower(value), 'view') THEN 0.5 ELSE 0 END)
  + (CASE WHEN contains(lower(entity), '12') OR contains(lower(key), '12') OR regexp_matches(value, '(^|[^A-Za-z0-9_])12($|[^A-Za-z0-9_])', 'i') THEN 1.0 WHEN contains(lower(value), '12') THEN 0.5 ELSE 0 END)) / 2"""


@query("t5_matched_ranking", f"""WITH {FACTS}, {_FRESH}, m AS (SELECT fact_id, stored_at, CASE WHEN freshness = 'stale' THEN confidence * 0.5 ELSE confidence END AS effective, {_MATCH} AS match FROM f)
SELECT fact_id, match, effective FROM m WHERE match >= 0.45 ORDER BY m.match DESC, m.effective DESC, stored_at DESC, fact_id LIMIT 60""")
def _(spark, d):
    found = facts.matched(effective(spark, d), ["view", "12"], 0.45)
    return found.orderBy(F.desc("match"), F.desc("effective"), F.desc("stored_at"), "fact_id").limit(60).select("fact_id", "match", "effective")


@query("r19_context_bundle", f"""WITH RECURSIVE {FACTS}, {_FRESH.replace("FROM live)", "FROM facts)")},
l AS (SELECT * FROM f WHERE superseded_by IS NULL AND NOT deleted AND (NOT private OR actor = '7') QUALIFY row_number() OVER (PARTITION BY entity, key ORDER BY version DESC, fact_id) = 1),
o AS (SELECT 0 AS place, 'facts' AS section, entity <> 'user:7' AS other, -(CASE WHEN freshness = 'stale' THEN confidence * 0.5 ELSE confidence END) AS weak, entity, key, CAST(fact_id AS VARCHAR) AS item, greatest((strlen(entity) + strlen(key) + strlen(value)) // 4, 1) + 8 AS cost FROM l
  UNION ALL SELECT CASE WHEN item_id % 2 = 0 THEN 1 ELSE 5 END, CASE WHEN item_id % 2 = 0 THEN 'decisions' ELSE 'notes' END, false, 0.0, '', '', CAST(item_id AS VARCHAR), greatest(strlen(left(text, 30)) // 4, 1) + 8 FROM benchmark),
n AS (SELECT *, row_number() OVER (ORDER BY place, other, weak, entity, key, item) AS rank FROM o),
b AS (SELECT rank, section, item, cost, CASE WHEN cost <= 400 THEN cost ELSE 0 END AS used, cost <= 400 AS kept FROM n WHERE rank = 1
  UNION ALL SELECT n.rank, n.section, n.item, n.cost, CASE WHEN b.used + n.cost <= 400 THEN b.used + n.cost ELSE b.used END, b.used + n.cost <= 400 FROM b JOIN n ON n.rank = b.rank + 1)
SELECT section, item, CAST(cost AS BIGINT) AS cost, CAST(used AS BIGINT) AS used FROM b WHERE kept""")
def _(spark, d):
    return _bundle(spark, d)[0]


def _bundle(spark, d):
    state = decay.freshness(F.col("horizon"), F.col("stored_at"), F.lit(NOW).cast("timestamp"), F.col("accesses"))
    rows = fact_rows(spark, d).withColumn("freshness", state).withColumn("effective", decay.effective(F.col("confidence"), F.col("freshness")))
    aux = table(spark, d, "benchmark").select(F.when(F.col("item_id") % 2 == 0, "decisions").otherwise("notes").alias("section"), F.col("item_id").alias("id"), F.substring("text", 1, 30).alias("text"))
    return facts.context_bundle(rows.withColumn("addressed", F.col("entity") == "user:7"), aux, "7", 400)


@query("r12_match_score", f"WITH {FACTS}, m AS (SELECT fact_id, {_MATCH} AS score FROM live) SELECT fact_id, score FROM m WHERE score >= 0.45")
def _(spark, d):
    return live(spark, d).select("fact_id", facts.match_score(["view", "12"]).alias("score")).where("score >= 0.45")


@query("r16_history", f"WITH {FACTS} SELECT fact_id, version, deleted, value FROM facts WHERE entity = 'user:7'")
def _(spark, d):
    return fact_rows(spark, d).where("entity = 'user:7'").select("fact_id", "version", "deleted", "value")


@query("r18_retention", f"""WITH {FACTS} SELECT fact_id FROM facts f WHERE NOT deleted AND NOT private AND stored_at < TIMESTAMP '2024-01-10' AND NOT starts_with(entity, 'user:2')
AND NOT (tenant = 't1') AND NOT (tenant = 't0' AND starts_with(entity, 'user:3'))""")
def _(spark, d):
    holds = spark.sql("SELECT 't1' AS tenant, CAST(NULL AS STRING) AS prefix, true AS active UNION ALL SELECT 't0', 'user:3', true UNION ALL SELECT 't2', NULL, false")
    return facts.retention(fact_rows(spark, d), F.lit("2024-01-10").cast("timestamp"), ["user:2"], holds).select("fact_id")


@query("t8_export_page", f"WITH {FACTS} SELECT fact_id, stored_at FROM facts WHERE (stored_at, fact_id) > (TIMESTAMP '2024-01-12', 5) ORDER BY stored_at, fact_id LIMIT 25")
def _(spark, d):
    return facts.export_page(fact_rows(spark, d), ("2024-01-12 00:00:00", 5), 25).select("fact_id", "stored_at")


@query("t9_newest_page", f"WITH {FACTS} SELECT fact_id, stored_at FROM facts WHERE (stored_at, fact_id) < (TIMESTAMP '2024-01-12', 5) ORDER BY stored_at DESC, fact_id DESC LIMIT 25")
def _(spark, d):
    return facts.newest_page(fact_rows(spark, d), ("2024-01-12 00:00:00", 5), 25).select("fact_id", "stored_at")


_PINS = "pins AS (SELECT entity FROM facts WHERE key = 'signup' GROUP BY entity HAVING arg_max(fact_id, (stored_at, fact_id)) % 3 = 0)"


def pins(spark, d):
    return facts.pinned(fact_rows(spark, d).where("key = 'signup'").withColumn("value", F.when(F.col("fact_id") % 3 == 0, "TRUE").otherwise("0")))


@query("x1_forget_plan", f"""WITH {FACTS}, {_PINS},
r AS (SELECT fact_id, tokens, row_number() OVER (ORDER BY stored_at, fact_id) AS rank, sum(tokens) OVER (ORDER BY stored_at, fact_id) AS used FROM facts WHERE NOT deleted AND NOT private AND starts_with(entity, 'user:1') AND entity NOT IN (SELECT entity FROM pins))
SELECT fact_id, CAST(rank AS INTEGER) AS rank, used::BIGINT AS used FROM r WHERE rank = 1 OR (used <= 100 AND used - tokens < 100)""")
def _(spark, d):
    rows = fact_rows(spark, d).where(facts.visible(superseded=True))
    return facts.forget_plan(rows, pins(spark, d), facts.forget_scope(entity_prefix="user:1"), 100).select("fact_id", "rank", "used")


@query("x1_forget_scopes", f"""WITH {FACTS}, {_PINS} SELECT fact_id FROM facts WHERE NOT deleted AND NOT private AND tenant = 't1' AND regexp_full_match(key, 'p.*') AND actor = entity[6:] AND stored_at < TIMESTAMP '2024-01-20' AND actor = '1'""")
def _(spark, d):
    rows = fact_rows(spark, d).where(facts.visible(superseded=True))
    scope = facts.forget_scope(key_glob="p*", passport="1", before=F.lit("2024-01-20").cast("timestamp"), tenant="t1")
    return facts.forget_plan(rows, pins(spark, d), scope, None, with_pinned=True).select("fact_id")


@query("x5_usage_rollup", f"""WITH {FACTS} SELECT key AS tool, count(*) AS calls, sum(tokens)::BIGINT AS tokens, count(*) FILTER (deleted) AS errors, round(count(*) FILTER (deleted) / count(*), 4) AS error_rate,
CAST(sum(tokens) // count(*) AS BIGINT) AS mean_tokens, list_sort(list(tokens))[CAST(count(*) // 2 + 1 AS BIGINT)] AS median_tokens FROM facts GROUP BY key""")
def _(spark, d):
    return facts.usage_rollup(fact_rows(spark, d).select(F.col("key").alias("tool"), "tokens", F.col("deleted").alias("error")))


@query("s1_stream_range", f"WITH {LOG} SELECT stream_id, seq, event_id FROM log WHERE stream_id IN (3, 4) AND seq >= greatest(5, CASE stream_id WHEN 4 THEN 12 ELSE 0 END) QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq) <= 20")
def _(spark, d):
    cuts = spark.sql("SELECT 4L AS stream_id, 12 AS cut_seq")
    return log.read_range(log_rows(spark, d).where("stream_id in (3, 4)"), 5, 20, cuts, ["stream_id"]).select("stream_id", "seq", "event_id")


@query("s2_stream_tail", f"WITH {LOG} SELECT stream_id, seq, event_id FROM log QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) <= 3")
def _(spark, d):
    return log.read_tail(log_rows(spark, d), 3, ["stream_id"]).select("stream_id", "seq", "event_id")


@query("s3_replay", f"WITH {LOG} SELECT stream_id, seq, event_id FROM log WHERE (stream_id, seq) > (5, 3) ORDER BY stream_id, seq LIMIT 100")
def _(spark, d):
    return log.replay(log_rows(spark, d), (5, 3), ["stream_id", "seq"], 100).select("stream_id", "seq", "event_id")


@query("s5_batched_fetch", f"WITH {LOG} SELECT event_id, value FROM log WHERE (stream_id, seq) IN ((1, 2), (7, 1), (9, 4))")
def _(spark, d):
    at = spark.sql("SELECT 1L AS stream_id, 2 AS seq UNION ALL SELECT 7L, 1 UNION ALL SELECT 9L, 4")
    return log_rows(spark, d).join(F.broadcast(at), ["stream_id", "seq"], "left_semi").select("event_id", "value")


@query("s9_append_status", f"""WITH {LOG}, b AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'k' || (event_id % 400) END AS event_key FROM log WHERE seq > 20),
c AS (SELECT DISTINCT stream_id, 'k' || (event_id % 400) AS event_key FROM log WHERE seq <= 20), l AS (SELECT stream_id, max(seq) AS last FROM log WHERE seq <= 20 GROUP BY 1),
s AS (SELECT b.stream_id, b.event_id, l.last, CASE WHEN b.event_key = '' THEN 'REJECTED' WHEN c.event_key IS NOT NULL THEN 'DUPLICATE_COMMITTED'
  WHEN row_number() OVER (PARTITION BY b.stream_id, b.event_key ORDER BY b.event_id) > 1 THEN 'DUPLICATE_IN_BATCH' ELSE 'APPENDED' END AS status
  FROM b LEFT JOIN c USING (stream_id, event_key) LEFT JOIN l USING (stream_id))
SELECT event_id, status, CASE WHEN status = 'APPENDED' THEN CAST(coalesce(last, 0) + sum(CASE WHEN status = 'APPENDED' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY event_id) AS BIGINT) END AS seq FROM s""")
def _(spark, d):
    rows = log_rows(spark, d)
    key = F.concat(F.lit("k"), (F.col("event_id") % 400).cast("string"))
    old = rows.where("seq <= 20").withColumn("event_key", key)
    new = rows.where("seq > 20").withColumn("event_key", F.when(F.col("event_id") % 11 == 0, "").otherwise(key)).drop("seq")
    return log.append_status(new, old, ["stream_id"], "event_id").select("event_id", "status", "seq")


@query("s17_last_record_wins", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def _(spark, d):
    rows = log_rows(spark, d).withColumnRenamed("stream_id", "user_id")
    return log.last_per_key(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("a10_current_state", f"""WITH {LOG}, a AS (SELECT stream_id, event_type, event_id, value, ts, max(ts) OVER (PARTITION BY stream_id, event_type ORDER BY event_id * 7919 % 10007, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest, event_id * 7919 % 10007 * 100000000 + event_id AS arrival FROM log),
k AS (SELECT *, lag(value) OVER (PARTITION BY stream_id, event_type ORDER BY arrival) AS previous FROM a WHERE newest IS NULL OR ts >= newest)
SELECT stream_id, event_type, value AS current, ts AS current_at, previous FROM k QUALIFY row_number() OVER (PARTITION BY stream_id, event_type ORDER BY arrival DESC) = 1""")
def _(spark, d):
    rows = log_rows(spark, d).withColumn("arrival", F.col("event_id") * 7919 % 10007 * 100000000 + F.col("event_id"))
    return log.current_state(rows, ["stream_id", "event_type"], "arrival", "ts", "value")


@query("a36_range_digests", """WITH n AS (SELECT user_id % 3 AS lane, event_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS n FROM events)
SELECT lane, n // 128 AS chunk, count(*) AS records, sha256(string_agg(sha256(CAST(event_id AS VARCHAR)), '' ORDER BY n)) AS digest FROM n GROUP BY 1, 2""")
def _(spark, d):
    rows = log_rows(spark, d).withColumn("lane", F.col("stream_id") % 3)
    return log.range_digests(rows, ["lane"], "event_id", "event_id")


@query("x10_chain_validation", f"""WITH {LOG}, h AS (SELECT stream_id, seq, event_id, sha256(CAST(event_id AS VARCHAR)) AS hash, CASE WHEN event_id % 97 = 0 THEN 'x' ELSE lag(sha256(CAST(event_id AS VARCHAR))) OVER (PARTITION BY stream_id ORDER BY seq) END AS prev_hash FROM log),
b AS (SELECT stream_id, seq, seq <> coalesce(lag(seq) OVER w + 1, 1) OR prev_hash IS DISTINCT FROM lag(hash) OVER w AS bad FROM h WHERE event_id % 101 <> 0 WINDOW w AS (PARTITION BY stream_id ORDER BY seq))
SELECT stream_id, count(*) AS rows, min(CASE WHEN bad THEN seq END) AS first_break FROM b GROUP BY stream_id""")
def _(spark, d):
    # hashes were linked when the log was whole; some links are wrong, some rows are gone
    rows = log_rows(spark, d).withColumn("hash", F.sha2(F.col("event_id").cast("string"), 256))
    before = rows.select("stream_id", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("prev_hash"))
    linked = rows.join(before, ["stream_id", "seq"], "left").withColumn("prev_hash", F.when(F.col("event_id") % 97 == 0, "x").otherwise(F.col("prev_hash")))
    return log.chain_breaks(linked.where("event_id % 101 <> 0"), ["stream_id"])


@query("s4_sealed_replay", f"WITH {LOG}, h AS (SELECT stream_id, max(seq) - 2 AS head_seq FROM log WHERE stream_id % 2 = 0 GROUP BY 1) SELECT stream_id, seq, event_id FROM log LEFT JOIN h USING (stream_id) WHERE head_seq IS NULL OR seq < head_seq")
def _(spark, d):
    rows = log_rows(spark, d)
    head = rows.where("stream_id % 2 = 0").groupBy("stream_id").agg((F.max("seq") - 2).alias("head_seq"))
    return log.sealed(rows, head, ["stream_id"]).select("stream_id", "seq", "event_id")


@query("s6_read_many", f"WITH {LOG} SELECT stream_id, seq, event_id FROM log WHERE (stream_id = 1 AND seq >= 3 AND seq < 13) OR (stream_id = 6 AND seq >= 5)")
def _(spark, d):
    wanted = spark.sql("SELECT 1L AS stream_id, 3 AS from_seq, 10 AS max_events UNION ALL SELECT 6L, 5, 0")
    return log.read_many(log_rows(spark, d), wanted, ["stream_id"]).select("stream_id", "seq", "event_id")


@query("s9_admission", f"""WITH {LOG}, b AS (SELECT stream_id, count(*) AS rows, sum(value)::BIGINT AS bytes FROM (SELECT stream_id, CAST(round(value) AS BIGINT) AS value FROM log WHERE seq > 20) GROUP BY 1), l AS (SELECT stream_id, max(seq) AS last FROM log WHERE seq <= 20 GROUP BY 1)
SELECT stream_id, rows, bytes, CASE WHEN stream_id = 3 THEN 'tombstoned' WHEN rows > 60 THEN 'too_many_events' WHEN bytes > 3000 THEN 'too_many_bytes' WHEN stream_id % 4 > 0 AND 20 + stream_id % 4 <> coalesce(last, 0) + 1 THEN 'seq_conflict' END AS refused FROM b LEFT JOIN l USING (stream_id)""")
def _(spark, d):
    rows = log_rows(spark, d)
    last = rows.where("seq <= 20").groupBy("stream_id").agg(F.max("seq").alias("last"))
    expected = rows.select("stream_id").distinct().withColumn("expected_next_seq", F.expr("if(stream_id % 4 > 0, 20 + stream_id % 4, 0)"))
    batch = rows.where("seq > 20").withColumn("size", F.round("value").cast("long"))
    return log.admission(batch, ["stream_id"], "size", expected, last, spark.sql("SELECT 3L AS stream_id"), 60, 3000)


@query("b5_tiered_budget", f"""WITH {FACTS}, r AS (SELECT fact_id, tokens, row_number() OVER w AS rank, sum(tokens) OVER w AS used FROM live WINDOW w AS (ORDER BY confidence DESC, stored_at DESC, fact_id)),
k AS (SELECT * FROM r WHERE rank = 1 OR (used <= 290 AND used - tokens < 290)), m AS (SELECT max(used) AS spent, max(rank) AS last FROM k)
SELECT fact_id, CAST(rank AS INTEGER) AS rank, used::BIGINT AS used, 'full' AS tier FROM k
UNION ALL SELECT fact_id, CAST(rank AS INTEGER), (spent + (rank - last) * 4)::BIGINT, 'pointer' FROM r, m WHERE rank > last AND rank <= last + greatest(0, 290 - spent) // 4""")
def _(spark, d):
    order = [F.desc("confidence"), F.desc("stored_at"), "fact_id"]
    return budget.tiered(live(spark, d), order, "tokens", 290, 4).select("fact_id", "rank", "used", "tier")


@query("b6_item_stop", """WITH r AS (SELECT item_id, (strlen(text) + 2) // 3 + 18 AS cost, row_number() OVER (ORDER BY item_id) AS rank, sum((strlen(text) + 2) // 3 + 18) OVER (ORDER BY item_id) + 130 AS used FROM benchmark)
SELECT item_id, CAST(cost AS BIGINT) AS cost, CAST(rank AS INTEGER) AS rank, CAST(used AS BIGINT) AS used FROM r WHERE rank = 1 OR used <= 2000""")
def _(spark, d):
    return budget.item_stop(table(spark, d, "benchmark"), ["item_id"], "text", 2000).select("item_id", "cost", "rank", "used")
