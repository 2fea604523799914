"""The fact journal over the driver's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import journal
from ..sources.tables import table

Q, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        Q[name], SQL[name] = f, sql
        return f

    return add


def ops(spark, d):
    """A journal in phases: stores, supersedes, clears, deletes, validity, consolidations and undos."""
    own = table(spark, d, "events").select(
        F.col("event_id").alias("e"), F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant"), F.concat(F.lit("user:"), "user_id").alias("entity"), F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"),
    )
    e = F.col("e")
    text = lambda c: c.cast("string")
    none, no_time = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    fact = F.struct(text(e).alias("fact_id"), "tenant", "entity", "key", F.concat(F.lit("v"), e).alias("value"), F.when(e % 4 == 0, text(e - 5)).alias("supersedes"))
    no_fact, no_ids = F.lit(None).cast(journal.OP.split("fact ")[1].split(", fact_id")[0]), F.lit(None).cast("array<string>")

    def op(rows, phase, name, fact=no_fact, fact_id=none, by=none, ids=no_ids, since=no_time, until=no_time):
        return rows.select((e + phase * 100_000_000).alias("line"), F.lit(name).alias("op"), fact.alias("fact"), fact_id.alias("fact_id"), by.alias("by_fact_id"), ids.alias("ids"), since.alias("valid_from"), until.alias("valid_to"))

    pair = F.array(text(e + 1), text(e + 2))
    first = own.select((F.col("e") - 1).alias("e"), F.col("tenant").alias("first_tenant"))
    merged = own.where(e % 50 == 0).join(first, "e", "left")
    canonical = F.struct(F.concat(F.lit("c"), e).alias("fact_id"), F.col("first_tenant").alias("tenant"), F.lit("all").alias("entity"), F.lit("k").alias("key"), F.lit("merged").alias("value"), none.alias("supersedes"))
    parts = [
        op(own, 0, "store", fact), op(own, 1, "store", fact), op(own.where(e % 3 == 0), 2, "supersede", fact_id=text(e - 1), by=text(e)), op(own.where(e % 6 == 0), 3, "clear_supersede", fact_id=text(e - 1)),
        op(own.where(e % 17 == 0), 4, "delete", fact_id=text(e)), op(own.where(e % 7 == 0), 5, "set_validity", fact_id=text(e), since=F.col("ts"), until=F.col("ts") + F.expr("interval 3 days")),
        op(merged, 6, "consolidate", canonical, ids=pair), op(own.where(e % 50 == 0), 7, "delete", fact_id=text(e + 1)), op(own.where(e % 100 == 0), 8, "consolidate_undo", fact_id=F.concat(F.lit("c"), e), ids=pair),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query("s15_journal_replay", """WITH f AS (SELECT event_id AS e, 't' || (user_id % 3) AS tenant, 'user:' || user_id AS entity, event_type AS key, ts FROM events),
s AS (SELECT a.e AS e, b.e AS by FROM f a JOIN f b ON b.e = a.e + 1 AND b.e % 3 = 0 AND b.tenant = a.tenant WHERE b.e % 6 <> 0),
m AS (SELECT c.e, a.tenant FROM f c JOIN f a ON a.e = c.e + 1 JOIN f b ON b.e = c.e + 2 WHERE c.e % 50 = 0 AND a.tenant = b.tenant AND a.e % 17 <> 0 AND b.e % 17 <> 0 AND a.e NOT IN (SELECT e FROM s) AND b.e NOT IN (SELECT e FROM s)),
x AS (SELECT f.e, f.tenant, f.entity, f.key, e % 17 = 0 OR ((e - 1) % 50 = 0 AND e - 1 IN (SELECT e FROM f) AND e - 1 NOT IN (SELECT e FROM m)) AS deleted, CASE WHEN e % 7 = 0 THEN ts END AS valid_from,
  CASE WHEN s.by IS NOT NULL THEN CAST(s.by AS VARCHAR) WHEN e - 1 IN (SELECT e FROM m WHERE e % 100 <> 0) THEN 'c' || (e - 1) WHEN e - 2 IN (SELECT e FROM m WHERE e % 100 <> 0) THEN 'c' || (e - 2) END AS superseded_by, CASE WHEN e % 4 = 0 THEN e - 5 END AS p FROM f LEFT JOIN s USING (e))
SELECT CAST(x.e AS VARCHAR) AS fact_id, x.tenant, x.entity, x.key, CASE WHEN o.e IS NULL OR (o.tenant = x.tenant AND o.entity = x.entity AND o.key = x.key) THEN CAST(x.p AS VARCHAR) END AS supersedes, x.superseded_by, x.deleted, x.valid_from FROM x LEFT JOIN f o ON o.e = x.p
UNION ALL SELECT 'c' || e, tenant, 'all', 'k', NULL, NULL, e % 100 = 0, NULL FROM m""")
def _(spark, d):
    return journal.replay(ops(spark, d)).select("fact_id", "tenant", "entity", "key", "supersedes", "superseded_by", "deleted", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"))


@query("s15_simple_replay", """WITH f AS (SELECT event_id AS e, 't' || (user_id % 3) AS tenant FROM events), s AS (SELECT a.e AS e, b.e AS by FROM f a JOIN f b ON b.e = a.e + 1 AND b.e % 3 = 0 AND b.tenant = a.tenant WHERE b.e % 6 <> 0)
SELECT CAST(e AS VARCHAR) AS fact_id, e % 17 = 0 AS deleted, CAST(s.by AS VARCHAR) AS superseded_by FROM f LEFT JOIN s USING (e)""")
def _(spark, d):
    return journal.simple_replay(ops(spark, d).where("line < 500000000"))


@query("r17_consolidation_errors", """WITH f AS (SELECT * FROM (VALUES ('8', 'ok'), ('9', 'x')) t(fact_id, error)) SELECT unnest(['-4', '16', '16']) AS fact_id, unnest(['missing', 'repeated', 'prior_not_a_target']) AS error EXCEPT ALL SELECT '16', 'prior_not_a_target' UNION ALL SELECT '99999', 'prior_not_a_target'""")
def _(spark, d):
    facts = journal.simple_replay(ops(spark, d).where("line < 200000000")).withColumns({"private": F.lit(False), "tenant": F.lit("t")})
    return journal.consolidation_errors(facts, {"tenant": "t", "supersedes": "99999"}, ["-4", "16", "16", "20"])
