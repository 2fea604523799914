"""Relations between artifacts: derived fields, expansion by hops, time ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.steps import kept

DAMPING, INCOMING, PRUNE = 0.8, 0.9, 0.01


def q16(confidence: Column) -> Column:
    """Stored confidence: rounded to 65535ths."""
    return F.round(confidence * 65535).cast("int")


def at_least(confidence_q16: Column, floor: float) -> Column:
    """The filter cuts the floor to 65535ths."""
    return confidence_q16 >= int(floor * 65535)


def relations(pairs: DataFrame) -> DataFrame:
    """src, dst, kind, q16, created_at, updated_at: the last of pairs(src, dst, kind, confidence, at) per edge."""
    return pairs.groupBy("src", "dst", "kind").agg(
        q16(F.max_by("confidence", F.struct("at", "confidence"))).alias("q16"), F.min("at").alias("created_at"), F.max("at").alias("updated_at")
    )


def dependents(seen: DataFrame) -> DataFrame:
    """artifact, kind, dependent, last_seen, weight: the latest time and largest weight of seen(artifact, kind, dependent, at, weight)."""
    return seen.groupBy("artifact", "kind", "dependent").agg(F.max("at").alias("last_seen"), F.max("weight").alias("weight"))


def living_fields(edges: DataFrame, pressure: DataFrame, depends: DataFrame | None = None) -> DataFrame:
    """artifact, out_count, in_count, pressure_level, reasons_mask of relations and unresolved pressure(artifact, level, code).

    With depends(artifact, dependent) also dependents_count.
    """
    ends = edges.select(F.col("src").alias("artifact"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    degree = ends.groupBy("artifact").agg(F.sum("o").alias("out_count"), F.sum("i").alias("in_count"))
    felt = pressure.groupBy("artifact").agg(F.max("level").alias("pressure_level"), F.expr("bit_or(shiftleft(1L, int(code & 31)))").alias("reasons_mask"))
    out, names = degree.join(felt, "artifact", "full_outer"), ["out_count", "in_count", "pressure_level", "reasons_mask"]
    if depends is not None:
        out = out.join(depends.groupBy("artifact").agg(F.count("*").alias("dependents_count")), "artifact", "full_outer")
        names.append("dependents_count")
    return out.select("artifact", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names))


#: How far a relation kind carries a score; other kinds count 1.
EDGE_BOOST = {"supports": 1.5, "contradicts": 1.5, "supersedes": 1.3, "derived_from": 1.3, "cites": 1.2, "about_same_entity": 1.4}


def _touching(edges: DataFrame, front: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges that start, and those that end, at one of front(node).

    Semi joins on the edges' own keys: with a small front Spark takes them below the grouping that
    makes the edges, so only those of the front are made.
    """
    node = front.select("node")
    return edges.join(node, edges["src"] == node["node"], "left_semi"), edges.join(node, edges["dst"] == node["node"], "left_semi")


def expand(edges: DataFrame, seeds: DataFrame, hops: int, budget: int, kinds: list[str] | None = None, floor: float = 0.0, boosts: dict[str, float] = EDGE_BOOST) -> DataFrame:
    """node, score, hop, kinds of the best nodes that `hops` (1 to 5) reach from seeds(node, score), seeds left out.

    Each hop gives a neighbour parent * confidence * boost of the kind * 0.8, against the edge's
    direction a tenth less, with parents' scores as of the hop's start; of several ways the best
    counts. Only nodes met for the first time spread on, and none under 0.01. The search ends early
    when it has met more than three times the budget. `kinds` and `floor` leave edges out.
    """
    hops, budget = min(max(hops, 1), 5), min(max(budget, 1), 200)
    own = edges.where(at_least(F.col("q16"), min(max(floor, 0.0), 1.0)))
    if kinds:
        own = own.where(F.col("kind").isin(kinds))
    boost = F.lit(1.0)
    for kind, value in boosts.items():
        boost = F.when(F.col("kind") == kind, value).otherwise(boost)
    w = F.col("q16") / 65535.0 * boost * DAMPING
    none = F.array().cast("array<string>")
    found = kept(seeds.select("node", F.col("score").cast("double").alias("score"), F.lit(0).alias("hop"), none.alias("kinds"), F.lit(True).alias("fresh")), "expand")
    for hop in range(1, hops + 1):
        front = kept(found.where(F.col("fresh") & (F.col("score") >= PRUNE)).select("node", "score"), "front")
        out, back = _touching(own, front)
        both = out.select(F.col("src").alias("node"), F.col("dst").alias("to"), "kind", w.alias("w"))
        both = both.union(back.select(F.col("dst").alias("node"), F.col("src").alias("to"), "kind", (w * INCOMING).alias("w")))
        reach = front.join(both, "node").groupBy("to").agg(F.max(F.col("score") * F.col("w")).alias("new"), F.collect_set("kind").alias("via"))
        met = found.join(reach, found["node"] == reach["to"], "full_outer")
        better = F.col("score").isNull() | (F.col("new") > F.col("score"))
        found = kept(met.select(
            F.coalesce("node", "to").alias("node"), F.when(better, F.col("new")).otherwise(F.col("score")).alias("score"),
            F.when(better, F.lit(hop)).otherwise(F.col("hop")).alias("hop"),
            F.array_union(F.coalesce("kinds", none), F.coalesce("via", none)).alias("kinds"), F.col("node").isNull().alias("fresh"),
        ), "expand")
        seen = found.agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh")).first()
        if not seen["fresh"] or seen["n"] > 3 * budget:
            break
    out = found.join(seeds.select("node"), "node", "left_anti").select("node", "score", "hop", F.array_sort("kinds").alias("kinds"))
    return out.orderBy(F.desc("score"), "node").limit(budget)


def _moved(start: Column, end: Column) -> Column:
    return ((F.col("updated_at") >= start) & (F.col("updated_at") < end)) | ((F.col("created_at") >= start) & (F.col("created_at") < end))


def changed_between(edges: DataFrame, states: DataFrame, start: Column, end: Column, limit: int) -> DataFrame:
    """artifact, state, n_edges, last_update: artifacts whose state or edges changed in [start, end), newest first.

    states(artifact, state, created_at, updated_at). An artifact without a state of its own has null,
    one whose state changed without its edges has 0 edges.
    """
    hit = edges.where(_moved(start, end))
    ends = hit.select(F.col("src").alias("artifact"), "updated_at").union(hit.select("dst", "updated_at"))
    by_edges = ends.groupBy("artifact").agg(F.count("*").alias("n_edges"), F.max("updated_at").alias("edge_update"))
    moved = states.where(_moved(start, end)).select("artifact", F.col("updated_at").alias("state_update"))
    out = moved.join(by_edges, "artifact", "full_outer").join(states.select("artifact", "state"), "artifact", "left")
    out = out.select("artifact", "state", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.greatest("state_update", "edge_update").alias("last_update"))
    return out.orderBy(F.desc("last_update"), "artifact").limit(min(max(limit, 1), 500))


def changed_edges(edges: DataFrame, artifacts: DataFrame, states: DataFrame, start: Column, end: Column) -> DataFrame:
    """artifact, src, dst, kind, src_state, dst_state: the edges changed in [start, end) of each of artifacts(artifact), at either end.

    states(artifact, state) gives the ends' states, null where unknown.
    """
    hit = edges.where(_moved(start, end)).select("src", "dst", "kind")
    sides = hit.select(F.col("src").alias("artifact"), "src", "dst", "kind").union(hit.select("dst", "src", "dst", "kind"))
    own = sides.distinct().join(artifacts.select("artifact"), "artifact", "left_semi")
    for side in ("src", "dst"):
        own = own.join(states.select(F.col("artifact").alias(side), F.col("state").alias(f"{side}_state")), side, "left")
    return own.select("artifact", "src", "dst", "kind", "src_state", "dst_state")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(node) at no end of an edge."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes.join(ends, "node", "left_anti")


def distance_boost(edges: DataFrame, seeds: DataFrame, hops: int, kinds: list[str] | None = None) -> DataFrame:
    """node, hop, boost 1 / (hop + 1): undirected breadth-first distance from seeds(node), up to `hops`, over edges of some kinds."""
    if kinds:
        edges = edges.where(F.col("kind").isin(kinds))
    found = kept(seeds.select("node", F.lit(0).alias("hop")), "hop")
    front = found
    for hop in range(1, hops + 1):
        out, back = _touching(edges, front)
        met = out.select(F.col("dst").alias("node")).union(back.select(F.col("src").alias("node"))).distinct()
        front = kept(met.join(found.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hop")), "hop")
        found = found.union(front)
    return found.select("node", "hop", (1.0 / (F.col("hop") + 1)).alias("boost"))
