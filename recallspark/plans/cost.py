"""Cost analytics, caches and quotas over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cost
from ..sources.tables import FACTS, LOG, fact_rows, log_rows, table

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_LINES = f"""{LOG}, l AS (SELECT stream_id AS session, seq, event_id, CASE event_type WHEN 'error' THEN 'compaction' WHEN 'signup' THEN 'user' ELSE 'assistant' END AS kind, 'm' || (seq // 2) AS message_id, CAST(round(value) AS BIGINT) AS v,
  CASE WHEN event_id % 8 > 0 THEN 'model-' || (event_id % 3) END AS model, CASE WHEN event_id % 5 > 1 THEN 'e' || (event_id % 2) END AS effort, event_type || ':' || (event_id % 4) AS source FROM log),
t AS (SELECT *, v AS input, v // 2 AS output, v * 3 AS cache_read, v % 7 AS cache_creation, v * 5 AS chars, event_id % 2 = 0 AS is_prompt, row_number() OVER (PARTITION BY session, message_id ORDER BY seq) > 1 AS duplicate FROM l),
g AS (SELECT *, sum(CASE WHEN kind = 'compaction' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS segment, kind = 'assistant' AND NOT duplicate AS turn FROM t),
c AS (SELECT *, sum(turn::INT) OVER (PARTITION BY session, segment ORDER BY seq) AS so_far, sum(turn::INT) OVER (PARTITION BY session, segment) AS turns FROM g),
k AS (SELECT *, CASE WHEN kind IN ('assistant', 'user') THEN ((chars + 3) // 4) * greatest(turns - so_far, 0) ELSE 0 END AS carried FROM c)"""


def lines(spark, d):
    e, v = F.col("event_id"), F.round("value").cast("long")
    kind = F.when(F.col("event_type") == "error", "compaction").when(F.col("event_type") == "signup", "user").otherwise("assistant")
    rows = log_rows(spark, d).select(
        F.col("stream_id").alias("session"), "seq", kind.alias("kind"), F.concat(F.lit("m"), F.expr("seq div 2")).alias("message_id"), F.when(e % 8 > 0, F.concat(F.lit("model-"), e % 3)).alias("model"),
        F.when(e % 5 > 1, F.concat(F.lit("e"), e % 2)).alias("effort"), F.concat("event_type", F.lit(":"), e % 4).alias("source"), v.alias("input"), F.floor(v / 2).alias("output"), (v * 3).alias("cache_read"),
        (v % 7).alias("cache_creation"), (v * 5).alias("chars"), (e % 2 == 0).alias("is_prompt"),
    )
    return cost.api_turns(rows, ["session"], "seq")


@query("s20_transcript_turns", f"WITH {_LINES} SELECT session, seq, duplicate FROM t")
def _(spark, d):
    return lines(spark, d).select("session", "seq", "duplicate")


_REPORT = f"""{_LINES}, r AS (SELECT session, sum(CASE WHEN duplicate THEN 0 ELSE input END)::BIGINT AS input, sum(CASE WHEN duplicate THEN 0 ELSE output END)::BIGINT AS output, sum(CASE WHEN duplicate THEN 0 ELSE cache_read END)::BIGINT AS cache_read, sum(CASE WHEN duplicate THEN 0 ELSE cache_creation END)::BIGINT AS cache_creation,
  count(*) FILTER (turn) AS turns, count(*) FILTER (kind = 'user' AND is_prompt) AS tasks, count(DISTINCT CASE WHEN turns > 0 THEN segment END) AS segments, sum(carried)::BIGINT AS carried FROM k GROUP BY 1),
report AS (SELECT *, input + cache_read + cache_creation AS context, greatest(input + cache_read + cache_creation - carried, 0) AS prefix FROM r)"""


@query("a26_session_report", f"WITH {_REPORT} SELECT * FROM report")
def _(spark, d):
    return cost.session_report(lines(spark, d), ["session"], "seq")


@query("a26_carried_by_source", f"WITH {_LINES} SELECT session, split_part(source, ':', 1) AS source, sum(carried)::BIGINT AS carried FROM k WHERE kind <> 'compaction' GROUP BY 1, 2")
def _(spark, d):
    return cost.carried_by_source(lines(spark, d), ["session"], "seq")


@query("a27_models", f"""WITH {_LINES}, o AS (SELECT * FROM t WHERE NOT duplicate AND kind = 'assistant')
SELECT model, NULL AS effort, count(*) AS turns, sum(input + cache_read + cache_creation)::BIGINT AS context, sum(output)::BIGINT AS output, round(count(effort) * 100 / count(*), 1) AS coverage FROM o GROUP BY 1
UNION ALL SELECT model, effort, count(*), sum(input + cache_read + cache_creation)::BIGINT, sum(output)::BIGINT, NULL FROM o WHERE model IS NOT NULL AND effort IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return cost.models(lines(spark, d))


@query("a29_levers", f"""WITH {_REPORT} SELECT session, 'long_segments' AS lever, carried * 0.5 AS saving FROM report WHERE turns > 8 * segments UNION ALL SELECT session, 'cold_cache', cache_creation::DOUBLE FROM report WHERE cache_creation * 40 > cache_read
UNION ALL SELECT session, 'prefix', prefix * 0.1 FROM report WHERE prefix > carried""")
def _(spark, d):
    c = F.col
    rules = [("long_segments", c("turns") > 8 * c("segments"), c("carried") * 0.5), ("cold_cache", c("cache_creation") * 40 > c("cache_read"), c("cache_creation")), ("prefix", c("prefix") > c("carried"), c("prefix") * 0.1)]
    return cost.levers(cost.session_report(lines(spark, d), ["session"], "seq"), rules).select("session", "lever", "saving")


@query("a30_ranked_plans", f"""WITH {LOG}, s AS (SELECT stream_id AS session, seq, 'plan-' || (event_id % 6) AS slug, CASE event_id % 4 WHEN 0 THEN 9 WHEN 1 THEN 3 ELSE 1 END AS w, 'plan-' || (stream_id % 3) AS branch FROM log WHERE event_id % 3 = 0),
g AS (SELECT session, slug, branch, sum(w)::BIGINT AS score, max(w) AS most, min(seq) AS first FROM s GROUP BY ALL)
SELECT session, slug, score, CAST(row_number() OVER (PARTITION BY session ORDER BY score DESC, starts_with(slug, branch) DESC, first, slug) AS INTEGER) AS place FROM g WHERE most > 1 QUALIFY place <= 2""")
def _(spark, d):
    e = F.col("event_id")
    signals = log_rows(spark, d).where(e % 3 == 0).select(F.col("stream_id").alias("session"), "seq", F.concat(F.lit("plan-"), e % 6).alias("slug"), F.when(e % 4 == 0, "strong").when(e % 4 == 1, "medium").otherwise("weak").alias("strength"), F.concat(F.lit("plan-"), F.col("stream_id") % 3).alias("branch"))
    return cost.ranked_plans(signals, ["session"], "seq", "branch", 2)


@query("a38_savings", "WITH p AS (SELECT o_totalprice AS b, o_totalprice * 0.7 + o_orderkey % 11 AS t FROM orders) SELECT count(*) AS n, round(avg(b - t), 4) AS mean, round(avg(b - t) - 1.96 * stddev_samp(b - t) / sqrt(count(*)), 4) AS low, round(avg(b - t) + 1.96 * stddev_samp(b - t) / sqrt(count(*)), 4) AS high FROM p")
def _(spark, d):
    pairs = table(spark, d, "orders").select(F.col("o_totalprice").alias("baseline"), (F.col("o_totalprice") * 0.7 + F.col("o_orderkey") % 11).alias("treated"))
    return cost.savings(pairs).select("n", *(F.round(c, 4).alias(c) for c in ("mean", "low", "high")))


@query("a37_coverage_window", f"WITH {LOG}, e AS (SELECT * FROM log WHERE event_id % 6 > 0) SELECT stream_id, count(*) AS events, count(*) FILTER (event_id % 4 > 0) AS receipts, count(*) FILTER (event_id % 5 = 0) AS anchored, max(seq) - min(seq) + 1 - count(DISTINCT seq) AS gaps, min(seq) AS first, max(seq) AS last FROM e GROUP BY 1")
def _(spark, d):
    e = F.col("event_id")
    rows = log_rows(spark, d).where(e % 6 > 0).withColumns({"receipt": F.when(e % 4 > 0, e), "anchored": e % 5 == 0})
    return cost.coverage_window(rows, ["stream_id"])


@query("a39_best_matches", """WITH v AS (SELECT vec_id AS id, label AS chain, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.id AS new_id, b.id AS old_id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS c FROM v a JOIN v b ON a.chain <> b.chain WHERE a.id < 60)
SELECT new_id, arg_max(old_id, (c, -old_id)) AS old_id, round(max(c), 6) AS cosine FROM p WHERE c >= 0.2 GROUP BY 1""")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("chain"), "embedding")
    return cost.best_matches(v.where("id < 60"), v, 0.2).withColumn("cosine", F.round("cosine", 6))


@query("a14_session_plans", """WITH e AS (SELECT event_id AS line, CASE event_type WHEN 'signup' THEN 'sealed' WHEN 'error' THEN 'closed' WHEN 'click' THEN 'revoked' ELSE 'invoked' END AS kind, user_id * 7 + event_id % 7 AS session, 'u' || user_id AS principal, 'plan' || event_id AS plan, CASE WHEN event_id % 3 > 0 THEN 'r' || event_id END AS reason FROM events),
s AS (SELECT session, arg_max(principal, line) AS principal, arg_max(plan, line) AS plan, max(line) AS since FROM e WHERE kind = 'sealed' GROUP BY 1),
n AS (SELECT session, bool_or(kind = 'closed') AS closed, bool_or(kind = 'revoked') AS revoked, arg_max_null(reason, line) FILTER (kind <> 'invoked') AS reason, count(*) FILTER (kind = 'invoked') AS invocations FROM e JOIN s USING (session) WHERE kind <> 'sealed' AND line > since GROUP BY 1)
SELECT session, principal, plan, coalesce(closed, false) AS closed, coalesce(revoked, false) AS revoked, reason, coalesce(invocations, 0) AS invocations FROM s LEFT JOIN n USING (session)""")
def _(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    kind = F.when(F.col("event_type") == "signup", "sealed").when(F.col("event_type") == "error", "closed").when(F.col("event_type") == "click", "revoked").otherwise("invoked")
    return cost.session_plans(e.select(k.alias("line"), kind.alias("kind"), (F.col("user_id") * 7 + k % 7).alias("session"), F.concat(F.lit("u"), "user_id").alias("principal"), F.concat(F.lit("plan"), k).alias("plan"), F.when(k % 3 > 0, F.concat(F.lit("r"), k)).alias("reason")))


_CACHE = """e AS (SELECT event_id AS line, user_id * 3 + event_id % 3 AS key, ts AS moment, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'view' THEN 'hit' WHEN 'click' THEN 'confidence' WHEN 'purchase' THEN 'verify' ELSE CASE WHEN event_id % 4 = 0 THEN 'invalidate' ELSE 'hit' END END AS kind, CASE event_type WHEN 'click' THEN (event_id % 9 - 4) / 10 ELSE event_id % 10 / 10 END AS value FROM events),
s AS (SELECT key, max(line) AS since FROM e WHERE kind = 'insert' GROUP BY 1), v AS (SELECT e.* FROM e JOIN s USING (key) WHERE line >= since),
f AS (SELECT key, count(*) FILTER (kind = 'hit') AS hits, max(moment) FILTER (kind IN ('hit', 'insert')) AS last_hit, arg_max(value, line) FILTER (kind = 'verify') AS verifier_score, max(value) FILTER (kind = 'insert') AS start, count(*) FILTER (kind = 'confidence') AS updates, bool_or(kind = 'invalidate') AS invalidated, coalesce(list(value ORDER BY line) FILTER (kind = 'confidence'), []) AS deltas FROM v GROUP BY 1),
c AS (SELECT key, hits, last_hit, verifier_score, list_reduce(list_prepend(start, deltas), lambda a, x: least(greatest(a + x, 0), 1)) AS confidence, updates, invalidated FROM f)"""


def cache_events(spark, d):
    k, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "signup", "insert").when(t == "view", "hit").when(t == "click", "confidence").when(t == "purchase", "verify").when(k % 4 == 0, "invalidate").otherwise("hit")
    return table(spark, d, "events").select(k.alias("line"), (F.col("user_id") * 3 + k % 3).alias("key"), F.col("ts").alias("at"), kind.alias("kind"), F.when(t == "click", (k % 9 - 4) / 10).otherwise(k % 10 / 10).alias("value"))


@query("a12_cache_rows", f"WITH {_CACHE} SELECT key, hits, last_hit, verifier_score, round(confidence, 6) AS confidence, updates, invalidated FROM c")
def _(spark, d):
    return cost.cache_rows(cache_events(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("a13_cache_stats", f"WITH {_CACHE} SELECT count(*) AS rows, count(*) FILTER (invalidated) AS invalidated, count(verifier_score) AS verified, sum(hits)::BIGINT AS hits FROM c")
def _(spark, d):
    return cost.cache_stats(cost.cache_rows(cache_events(spark, d)))


@query("a19_provenance", f"WITH {FACTS} SELECT CASE WHEN fact_id % 4 = 0 THEN 'signed' WHEN fact_id % 4 = 1 THEN 'anchored' ELSE 'none' END AS state, count(*) AS n FROM live GROUP BY 1")
def _(spark, d):
    from ..operators import facts

    k = F.col("fact_id")
    state = F.when(k % 4 == 0, "signed").when(k % 4 == 1, "anchored").otherwise("none")
    return fact_rows(spark, d).where(facts.visible()).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("wn12_quota", """WITH RECURSIVE r AS (SELECT user_id, event_id AS tie, epoch_us(ts) // 3600000000 AS moment, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 3600000000, event_id) AS n FROM events),
b AS (SELECT user_id, n, tie, moment, 4000::BIGINT AS left_over, true AS allowed, 4::BIGINT AS remaining, 0::BIGINT AS retry_after FROM r WHERE n = 1
  UNION ALL SELECT user_id, n, tie, moment, CASE WHEN t >= 1000 THEN t - 1000 ELSE t END, t >= 1000, CASE WHEN t >= 1000 THEN (t - 1000) // 1000 END, CASE WHEN t >= 1000 THEN 0 ELSE greatest(1, ((1000 - t) * 60 + 1999) // 2000) END
  FROM (SELECT r.user_id, r.n, r.tie, r.moment, least(b.left_over + (r.moment - b.moment) * 2 * 1000 // 60, 5000) AS t FROM b JOIN r ON r.user_id = b.user_id AND r.n = b.n + 1))
SELECT user_id, tie, allowed, remaining, retry_after FROM b""")
def _(spark, d):
    # hours stand in for seconds, so that buckets run dry
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("tie"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("at"))
    return cost.quota(rows, ["user_id"], "at", 5, 2).select("user_id", "tie", "allowed", "remaining", "retry_after")
