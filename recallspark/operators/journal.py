"""The fact journal: conditional operations folded to facts, consolidation and its undo.

An operation is applied or skipped by the state of the facts it names, so facts that an operation
names together must be folded together. They form groups (connected by operations); each group is
small next to the journal, is folded in line order on its own, and groups are dealt to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.steps import kept

#: The operations and the columns they read: `fact` is a struct of a stored or canonical fact.
OPS = ("store", "delete", "supersede", "clear_supersede", "set_validity", "consolidate", "consolidate_undo", "consolidation_provenance")
FACT = "fact_id string, tenant string, entity string, key string, value string, supersedes string"
OP = f"line long, op string, fact struct<{FACT.replace(' string', ':string')}>, fact_id string, by_fact_id string, ids array<string>, valid_from timestamp, valid_to timestamp"
STATE = f"{FACT}, superseded_by string, deleted boolean, valid_from timestamp, valid_to timestamp, sources array<string>, line long"


def groups(ops: DataFrame) -> DataFrame:
    """ops with grp: operations that share a fact, directly or through others, share a group.

    A fact's label is the hash of its id, or the least of the facts that operations link it to; only
    operations that name several facts are gone through for these, in turns until nothing changes.
    Rounds grow with the longest chain of operations, which consolidations keep short. Facts with
    one hash are folded together, which changes no result.
    """
    named = F.concat(F.array("fact.fact_id", "fact_id", "by_fact_id"), F.coalesce("ids", F.array().cast("array<string>")))
    facts = F.array_distinct(F.transform(F.array_compact(named), lambda i: F.xxhash64(i)))
    pairs = kept(ops.select("line", facts.alias("facts")).where(F.size("facts") > 1).select("line", F.explode("facts").alias("id")), "journal-ids")
    label = kept(pairs.groupBy("line").agg(F.min("id").alias("grp")), "journal-groups")
    while True:
        by_fact = pairs.join(label, "line").groupBy("id").agg(F.min("grp").alias("grp"))
        lower = pairs.join(by_fact, "id").groupBy("line").agg(F.min("grp").alias("low"))
        moved = kept(label.join(lower, "line").select("line", F.least("grp", "low").alias("grp"), (F.col("low") < F.col("grp")).alias("moved")), "journal-groups")
        label = moved.select("line", "grp")
        if moved.where("moved").isEmpty():
            break
    linked = pairs.join(label, "line").groupBy("id").agg(F.min("grp").alias("label"))
    own = ops.withColumn("id", F.coalesce(F.get(facts, F.lit(0)), F.xxhash64("line")))
    return own.join(linked, "id", "left").withColumn("grp", F.coalesce("label", "id")).drop("id", "label")


def _live(facts: dict, i: str | None) -> dict | None:
    f = facts.get(i)
    return f if f and not f["deleted"] else None


def _active_source(facts: dict, i: str) -> bool:
    """Whether a live canonical fact still holds `i` as one of its sources."""
    return any(f["sources"] is not None and i in f["sources"] and not f["deleted"] for f in facts.values())


def apply_op(facts: dict, op: dict) -> bool:
    """Apply one operation to facts by id; False where a precondition fails and it is skipped."""
    kind, ids = op["op"], list(op["ids"]) if op["ids"] is not None else []
    fact = dict(op["fact"]) if op["fact"] is not None else None
    if kind == "store":
        if fact is None or fact["fact_id"] is None or fact["fact_id"] in facts:
            return False
        facts[fact["fact_id"]] = _new(fact, op)
        return True
    if kind in ("consolidate", "consolidate_undo", "consolidation_provenance"):
        return _consolidation(facts, kind, fact, ids, op)
    target = facts.get(op["fact_id"])
    if target is None:
        return False
    if kind == "delete":
        if target["sources"] is not None or _active_source(facts, op["fact_id"]):
            return False
        target["deleted"] = True
    elif kind == "supersede":
        by = facts.get(op["by_fact_id"])
        if by is None or by["tenant"] != target["tenant"] or _active_source(facts, op["fact_id"]):
            return False
        target["superseded_by"] = by["fact_id"]
    elif kind == "clear_supersede":
        if _active_source(facts, op["fact_id"]):
            return False
        target["superseded_by"] = None
    elif kind == "set_validity":
        target["valid_from"], target["valid_to"] = op["valid_from"], op["valid_to"]
    else:
        return False
    return True


def _new(fact: dict, op: dict) -> dict:
    return fact | {"tenant": (fact["tenant"] or "").strip() or "default", "superseded_by": None, "deleted": False, "valid_from": None, "valid_to": None, "sources": None, "line": op["line"]}


def _consolidation(facts: dict, kind: str, fact: dict | None, ids: list[str], op: dict) -> bool:
    sources = [_live(facts, i) for i in ids]
    if kind == "consolidate":
        fresh = fact is not None and fact["fact_id"] is not None and fact["fact_id"] not in facts
        if not fresh or not ids or len(set(ids)) < len(ids) or not all(sources):
            return False
        canonical = _new(fact, op)
        if any(s["tenant"] != canonical["tenant"] or s["superseded_by"] is not None for s in sources) or (canonical["supersedes"] is not None and canonical["supersedes"] not in ids):
            return False
        for s in sources:
            s["superseded_by"] = canonical["fact_id"]
        facts[canonical["fact_id"]] = canonical | {"sources": sorted(ids)}
        return True
    canonical = _live(facts, op["fact_id"])
    points_here = canonical is not None and ids and all(facts.get(i, {}).get("superseded_by") == op["fact_id"] for i in ids)
    if kind == "consolidation_provenance":
        if points_here:
            canonical["sources"] = sorted(ids)
        return bool(points_here)
    if not points_here or canonical["superseded_by"] is not None or canonical["sources"] != sorted(ids):
        return False
    canonical["deleted"] = True
    for i in ids:
        facts[i]["superseded_by"] = None
    return True


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by group and line: a group's facts leave when the next group begins."""
    columns = [c.split()[0] for c in STATE.split(", ")]
    grp, facts = None, {}
    for rows in batches:
        done: list[dict] = []
        for op in rows.to_dict("records"):
            if op["grp"] != grp:
                done += facts.values()
                grp, facts = op["grp"], {}
            op = {k: (None if v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v else v) for k, v in op.items()}
            fact = {k[2:]: v for k, v in op.items() if k.startswith("f_")}
            apply_op(facts, op | {"fact": fact if fact["fact_id"] is not None else None})
        yield pd.DataFrame(done, columns=columns)
    yield pd.DataFrame(list(facts.values()), columns=columns)


def replay(ops: DataFrame) -> DataFrame:
    """The facts (STATE) that a journal of OP rows leaves; operations whose preconditions fail are skipped.

    In the end links into another chain or tenant are cleared: supersedes to another tenant, entity
    or key, superseded_by to another tenant. Ids that no fact has stay.
    """
    flat = groups(ops).select("grp", "line", "op", "fact_id", "by_fact_id", "ids", "valid_from", "valid_to", *(F.col(f"fact.{c.split()[0]}").alias(f"f_{c.split()[0]}") for c in FACT.split(", ")))
    grouped = flat.repartition("grp").sortWithinPartitions("grp", "line")
    facts = kept(grouped.mapInPandas(_fold, STATE), "journal-facts")
    ends = facts.select(F.col("fact_id").alias("end"), *(F.col(c).alias(f"end_{c}") for c in ("tenant", "entity", "key")))
    back = facts.join(ends, facts["supersedes"] == ends["end"], "left").withColumn("supersedes", F.when(F.col("end").isNotNull() & ~((F.col("tenant") == F.col("end_tenant")) & (F.col("entity") == F.col("end_entity")) & (F.col("key") == F.col("end_key"))), None).otherwise(F.col("supersedes"))).select(*facts.columns)
    on = back.join(ends, back["superseded_by"] == ends["end"], "left")
    return on.withColumn("superseded_by", F.when(F.col("end").isNotNull() & (F.col("tenant") != F.col("end_tenant")), None).otherwise(F.col("superseded_by"))).select(*facts.columns)


def simple_replay(ops: DataFrame) -> DataFrame:
    """fact_id, deleted, superseded_by of a journal of store, delete, supersede and clear_supersede only, without a fold.

    The last of supersede and clear of a fact counts; operations before its store are skipped.
    """
    stored = ops.where("op = 'store'").groupBy(F.col("fact.fact_id").alias("fact_id")).agg(F.min_by("fact", "line").alias("fact"), F.min("line").alias("stored"))
    known = stored.select(F.col("fact_id").alias("by_fact_id"), F.col("stored").alias("by_stored"), F.col("fact.tenant").alias("by_tenant"))
    moves = ops.where("op in ('supersede', 'clear_supersede')").select("line", "op", "fact_id", "by_fact_id").join(known, "by_fact_id", "left").join(stored.select("fact_id", "stored", F.col("fact.tenant").alias("tenant")), "fact_id")
    valid = moves.where((F.col("line") > F.col("stored")) & ((F.col("op") == "clear_supersede") | ((F.col("line") > F.col("by_stored")) & (F.col("by_tenant") == F.col("tenant")))))
    last = valid.groupBy("fact_id").agg(F.max_by(F.struct(F.when(F.col("op") == "supersede", F.col("by_fact_id")).alias("by")), "line").alias("last"))
    gone = ops.where("op = 'delete'").select("fact_id", "line").join(stored.select("fact_id", "stored"), "fact_id").where("line > stored").select("fact_id", F.lit(True).alias("deleted")).distinct()
    out = stored.join(last, "fact_id", "left").join(gone, "fact_id", "left")
    return out.select("fact_id", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.col("last.by").alias("superseded_by"))


def consolidation_errors(facts: DataFrame, canonical: dict, ids: list[str]) -> DataFrame:
    """What forbids to consolidate `ids` (one request: its ids are few) into `canonical`: rows of (fact_id, error), none if it may be done."""
    spark = facts.sparkSession
    wanted = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "fact_id string, n int")
    both = wanted.join(facts.select("fact_id", "tenant", "deleted", "superseded_by", "private", F.lit(True).alias("known")), "fact_id", "left")
    error = F.when(F.col("known").isNull(), "missing").when(F.col("deleted"), "deleted").when(F.col("tenant") != canonical["tenant"], "other_tenant").when(F.col("superseded_by").isNotNull(), "superseded").when(F.col("private"), "protected")
    repeated = wanted.groupBy("fact_id").count().where("count > 1").select("fact_id", F.lit("repeated").alias("error"))
    out = both.select("fact_id", error.alias("error")).where("error is not null").unionByName(repeated)
    if not ids:
        out = out.unionByName(spark.createDataFrame([(None, "no_sources")], "fact_id string, error string"))
    prior = canonical.get("supersedes")
    if prior is not None and prior not in ids:
        out = out.unionByName(spark.createDataFrame([(prior, "prior_not_a_target")], "fact_id string, error string"))
    return out

