"""The driver's tables, and the facts, log, relations and spans that they stand in for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fact_tokens
from ..operators.facts import versioned


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from events: a user is an entity, an event type a key, the value a number as text."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    value = F.col("value").cast("decimal(12,2)").cast("string")
    entity = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    rows = e.select(
        F.col("event_id").alias("fact_id"), F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant"), entity.alias("entity"),
        F.col("event_type").alias("key"), value.alias("value"), (k / 100).alias("confidence"), F.col("ts").alias("stored_at"),
        fact_tokens(F.concat(entity, "event_type", value)).alias("tokens"), (F.col("event_id") % 17 == 0).alias("deleted"),
        (F.col("event_id") % 23 == 0).alias("private"), F.col("user_id").cast("string").alias("actor"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("valid_from"), F.when(F.col("event_id") % 7 == 0, F.col("ts") + F.expr("interval 3 days")).alias("valid_to"),
        F.when(k < 25, "short").when(k < 50, "medium").when(k < 75, "long").alias("horizon"), (k % 10).cast("int").alias("accesses"),
    )
    return versioned(rows)


#: The same facts in DuckDB.
FACTS = """facts AS (
  SELECT *, CAST(count(CASE WHEN NOT deleted THEN 1 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS INTEGER) AS version,
    lag(CASE WHEN NOT deleted THEN fact_id END IGNORE NULLS) OVER w AS supersedes, lead(CASE WHEN NOT deleted THEN fact_id END IGNORE NULLS) OVER w AS superseded_by FROM (
    SELECT event_id AS fact_id, 't' || (user_id % 3) AS tenant, 'user:' || user_id AS entity, event_type AS key,
      CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS value, k / 100 AS confidence, ts AS stored_at,
      CAST(ceil(strlen('user:' || user_id || event_type || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR)) / 4) AS BIGINT) AS tokens,
      event_id % 17 = 0 AS deleted, event_id % 23 = 0 AS private, CAST(user_id AS VARCHAR) AS actor,
      CASE WHEN event_id % 5 <> 0 THEN ts END AS valid_from, CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 3 DAY END AS valid_to,
      CASE WHEN k < 25 THEN 'short' WHEN k < 50 THEN 'medium' WHEN k < 75 THEN 'long' END AS horizon, CAST(k % 10 AS INTEGER) AS accesses
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))
  WINDOW w AS (PARTITION BY tenant, entity, key ORDER BY stored_at, fact_id)),
live AS (SELECT * FROM facts WHERE NOT deleted AND NOT private AND superseded_by IS NULL)"""


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: a user is a stream."""
    from ..operators.log import sequenced

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), "event_id", "event_type", "ts", "value")
    return sequenced(e, ["stream_id"], ["ts", "event_id"])


LOG = """log AS (SELECT user_id AS stream_id, event_id, event_type, ts, value,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq FROM events)"""


def relation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations: a customer's order of a part's supplier is an edge customer to supplier by line status."""
    from ..operators.graph import relations

    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    pairs = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst"), F.col("l_linestatus").alias("kind"), (1 - F.col("l_discount") * 5).alias("confidence"), F.col("l_shipdate").alias("at")
    )
    return relations(pairs)


RELATIONS = """relations AS (
  SELECT src, dst, kind, CAST(round(arg_max(confidence, (moment, confidence)) * 65535) AS INTEGER) AS q16, min(moment) AS created_at, max(moment) AS updated_at FROM (
    SELECT o_custkey AS src, l_suppkey + 1000000 AS dst, l_linestatus AS kind, 1 - l_discount * 5 AS confidence, l_shipdate AS moment
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY src, dst, kind)"""
