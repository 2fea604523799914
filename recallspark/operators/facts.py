"""Versioned, bi-temporal facts: versions, recall, history, aggregates, retention.

A fact has fact_id, tenant, entity, key, value, confidence, stored_at, tokens, deleted, private,
version, supersedes, superseded_by, valid_from, valid_to (see sources.schemas.FACTS).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import leading_number, polarity
from .budget import first_rows, prefix_stop, skip_and_continue
from .retrieval import cosine

CHAIN = ("tenant", "entity", "key")


def versioned(rows: DataFrame) -> DataFrame:
    """version, supersedes and superseded_by from the order of stored_at and fact_id within a chain.

    Deleted rows supersede nothing: a row follows the last one before it that isn't deleted, has that
    one's version and one more, and is superseded by the next one that isn't deleted.
    """
    before = Window.partitionBy(*CHAIN).orderBy("stored_at", "fact_id").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*CHAIN).orderBy(F.desc("stored_at"), F.desc("fact_id")).rowsBetween(Window.unboundedPreceding, -1)
    alive = F.when(~F.col("deleted"), F.col("fact_id"))
    return rows.withColumns({
        "version": (F.count(alive).over(before) + 1).cast("int"),
        "supersedes": F.last(alive, ignorenulls=True).over(before),
        "superseded_by": F.last(alive, ignorenulls=True).over(after),
    })


def visible(tenant: str | None = None, superseded: bool = False, owner: str | None = None) -> Column:
    """Live rows of a tenant: private ones only to their owner."""
    seen = ~F.col("deleted") & (~F.col("private") | (F.col("actor") == owner if owner else F.lit(False)))
    if tenant is not None:
        seen = seen & (F.col("tenant") == tenant)
    return seen if superseded else seen & F.col("superseded_by").isNull()


def any_term(query: str) -> Column:
    """Any word of the query within value, key or entity, letter case aside."""
    hit = F.lit(False)
    for term in query.lower().split():
        for column in ("value", "key", "entity"):
            hit = hit | F.contains(F.lower(column), F.lit(term))
    return hit


def valid_at(at: Column) -> Column:
    """Half-open [valid_from, valid_to), nulls open."""
    return (F.col("valid_from").isNull() | (at >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))


def latest(rows: DataFrame, chain: tuple[str, ...] = CHAIN) -> DataFrame:
    """One row per chain: the highest version, the least fact_id on a tie."""
    best = F.min_by(F.struct("*"), F.struct((-F.col("version")).alias("v"), "fact_id"))
    return rows.groupBy(*(F.col(c).alias(f"k{i}") for i, c in enumerate(chain))).agg(best.alias("row")).select("row.*")


def recall(rows: DataFrame, budget: int | None) -> DataFrame:
    """Live facts by confidence, newest first, under a token budget."""
    return prefix_stop(rows, [], [F.desc("confidence"), F.desc("stored_at"), "fact_id"], "tokens", budget)


def dense_rank(rows: DataFrame, vectors: DataFrame, query: DataFrame) -> DataFrame:
    """rows with cosine and score = 0.6 cosine + 0.4 confidence; a fact without a vector has cosine 0.

    vectors(fact_id, embedding), query one row (q). Ties are for the caller to break by stored_at, newest first.
    """
    near = vectors.crossJoin(F.broadcast(query)).select("fact_id", cosine(F.col("embedding"), F.col("q")).alias("cosine"))
    both = rows.join(near, "fact_id", "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    return both.withColumn("score", 0.6 * F.col("cosine") + 0.4 * F.col("confidence"))


def matched(rows: DataFrame, terms: list[str], floor: float, keep: int = 0) -> DataFrame:
    """rows with match (match_score) at or over the floor, ranked by it, then by effective confidence and time.

    Needs effective. With none over the floor the `keep` best stay, marked as fallback.
    """
    scored = rows.withColumn("match", match_score(terms))
    over = scored.where(F.col("match") >= floor).withColumn("fallback", F.lit(False))
    if keep:
        best = scored.orderBy(F.desc("match"), F.desc("effective"), F.desc("stored_at"), "fact_id").limit(keep).withColumn("fallback", F.lit(True))
        none = over.agg((F.count("*") == 0).alias("none"))
        over = over.unionByName(best.crossJoin(F.broadcast(none)).where("none").drop("none"))
    return over


def above_floor(rows: DataFrame, floor: float) -> DataFrame:
    """One row: how many are kept and how many dropped by a confidence floor, before any budget."""
    return rows.agg(F.count_if(F.col("confidence") >= floor).alias("kept"), F.count_if(F.col("confidence") < floor).alias("dropped"))


def aggregate_scan(rows: DataFrame, by: list[str], budget: int) -> DataFrame:
    """Count, numeric sum and distinct values of the facts that a budget reaches in fact_id order, and whether it cut."""
    kept = prefix_stop(rows, by, ["fact_id"], "tokens", budget, early=False)
    total = rows.groupBy(*by).agg(F.count("*").alias("all_rows"))
    out = kept.groupBy(*by).agg(F.count("*").alias("n"), F.sum(leading_number(F.col("value"))).alias("sum_numeric"), F.countDistinct("value").alias("n_distinct"))
    return out.join(total, by).select(*by, "n", "sum_numeric", "n_distinct", (F.col("n") < F.col("all_rows")).alias("truncated"))


def contradictions(rows: DataFrame) -> DataFrame:
    """One row per fact of a chain (tenant, entity, key) whose live, public values have both polarities.

    Columns tenant, entity, key, classes, n_facts and fact_id: the facts stay rows, so a chain of any
    length is fine. Live means not deleted and not superseded.
    """
    active = rows.where(~F.col("deleted") & ~F.col("private") & F.col("superseded_by").isNull())
    marked = active.withColumn("class", polarity(F.col("value"))).where("class is not null")
    grouped = marked.groupBy(*CHAIN).agg(F.array_join(F.array_sort(F.collect_set("class")), ",").alias("classes"), F.count("*").alias("n_facts"))
    both = grouped.where(F.contains("classes", F.lit(",")))
    return marked.join(both, list(CHAIN)).select(*CHAIN, "classes", "n_facts", "fact_id")


def temporal_diff(rows: DataFrame, at: Column) -> DataFrame:
    """Current number of each chain less its number as of a time; without a time (null) the oldest's.

    The history is walked back from the current fact along supersedes links that both ends confirm
    and stops before the first private fact. No fact as old as the time, or an end that is no number,
    gives null. Adds links, the length of the history.
    """
    alive = rows.where("not deleted")
    # links of live rows join neighbours: the walk ends at the newest row that isn't public or linked
    broken = F.max(F.when(F.col("private"), F.col("version"))).over(Window.partitionBy(*CHAIN))
    walk = alive.withColumn("broken", broken).where(F.col("broken").isNull() | (F.col("version") > F.col("broken")))
    value = leading_number(F.col("value"))
    old = F.when(F.lit(at).isNull() | (F.col("stored_at") <= at), F.struct("version"))
    out = walk.groupBy(*CHAIN).agg(
        F.count("*").alias("links"),
        F.max_by(value, F.col("version")).alias("current"),
        F.max_by(value, old).alias("then"),
        F.min_by(value, F.col("version")).alias("oldest"),
    )
    out = out.withColumn("then", F.when(F.lit(at).isNull(), F.col("oldest")).otherwise(F.col("then")))
    return out.withColumn("diff", F.col("current") - F.col("then"))


def export_page(rows: DataFrame, after: tuple | None, size: int) -> DataFrame:
    """A page in the order (stored_at, fact_id) after a cursor; an unknown cursor starts over."""
    if after is not None:
        at = F.lit(after[0]).cast("timestamp")
        rows = rows.where((F.col("stored_at") > at) | ((F.col("stored_at") == at) & (F.col("fact_id") > after[1])))
    return rows.orderBy("stored_at", "fact_id").limit(size)


def newest_page(rows: DataFrame, before: tuple | None, size: int) -> DataFrame:
    """A page newest first, before the cursor (stored_at, fact_id)."""
    if before is not None:
        at = F.lit(before[0]).cast("timestamp")
        rows = rows.where((F.col("stored_at") < at) | ((F.col("stored_at") == at) & (F.col("fact_id") < before[1])))
    return rows.orderBy(F.desc("stored_at"), F.desc("fact_id")).limit(size)


def retention(rows: DataFrame, cutoff: Column, reserved: list[str], holds: DataFrame) -> DataFrame:
    """Facts to expire: live, public, older than the cutoff, not in a reserved namespace, under no active hold.

    holds(tenant, prefix, active): a null prefix holds the whole tenant.
    """
    old = rows.where(~F.col("deleted") & ~F.col("private") & (F.col("stored_at") < cutoff))
    for prefix in reserved:
        old = old.where(~F.startswith("entity", F.lit(prefix)))
    # whole tenants by an equi-join; prefixes as a list on each tenant's row, so that a hot tenant stays spread
    active = holds.where("active")
    free = old.join(F.broadcast(active.where("prefix is null").select("tenant").distinct()), "tenant", "left_anti")
    lists = active.where("prefix is not null").groupBy("tenant").agg(F.collect_set("prefix").alias("held"))
    listed = free.join(F.broadcast(lists), "tenant", "left")
    return listed.where(~F.coalesce(F.exists("held", lambda p: F.startswith("entity", p)), F.lit(False))).drop("held")


def match_score(terms: list[str]) -> Column:
    """Share of terms: 1 for one in entity, key or as a whole word of the value, half for one within a word."""
    total = F.lit(0.0)
    for t in terms:
        place = F.contains(F.lower("entity"), F.lit(t)) | F.contains(F.lower("key"), F.lit(t))
        whole = F.col("value").rlike(f"(?i)(?<![A-Za-z0-9_]){t}(?![A-Za-z0-9_])")
        total = total + F.when(place | whole, 1.0).when(F.contains(F.lower("value"), F.lit(t)), 0.5).otherwise(0.0)
    return total / max(1, len(terms))


def pinned(rows: DataFrame) -> DataFrame:
    """Entities whose latest pin fact says true or 1."""
    latest_pin = rows.groupBy("entity").agg(F.max_by("value", F.struct("stored_at", "fact_id")).alias("value"))
    return latest_pin.where(F.lower("value").isin("true", "1")).select("entity")


def forget_scope(entity_prefix: str | None = None, key_glob: str | None = None, passport: str | None = None, before: Column | None = None, tenant: str | None = None) -> Column:
    """Facts in all of the scopes given; a glob has * and ? and covers the whole key."""
    scope = F.lit(True)
    if entity_prefix is not None:
        scope = scope & F.startswith("entity", F.lit(entity_prefix))
    if key_glob is not None:
        pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in key_glob)
        scope = scope & F.col("key").rlike(f"^{pattern}$")
    if passport is not None:
        scope = scope & (F.col("actor") == passport)
    if before is not None:
        scope = scope & (F.col("stored_at") < before)
    if tenant is not None:
        scope = scope & (F.col("tenant") == tenant)
    return scope


def forget_plan(rows: DataFrame, pins: DataFrame, scope: Column, budget: int | None, reserved: tuple[str, ...] = ("__",), with_pinned: bool = False) -> DataFrame:
    """Undeleted facts in scope, superseded ones too, oldest first, under a token budget (none: all of them).

    Reserved namespaces stay, and entities with a pin unless `with_pinned`.
    """
    free = rows.where(scope)
    for prefix in reserved:
        free = free.where(~F.startswith("entity", F.lit(prefix)))
    if not with_pinned:
        free = free.join(pins, "entity", "left_anti")
    return prefix_stop(free, [], ["stored_at", "fact_id"], "tokens", budget)


def usage_rollup(calls: DataFrame) -> DataFrame:
    """Per tool: calls, tokens, errors, error rate (4 places), integer mean and upper median of calls(tool, tokens, error)."""
    # calls of one tool and size are counted first: the sizes that occur are few next to the calls
    sizes = calls.groupBy("tool", F.col("tokens").alias("size")).agg(F.count("*").alias("n"), F.count_if("error").alias("bad"))
    w = Window.partitionBy("tool")
    placed = sizes.withColumns({"upto": F.sum("n").over(w.orderBy("size")), "calls": F.sum("n").over(w)})
    median = F.min(F.when(F.expr("upto > calls div 2"), F.col("size")))
    out = placed.groupBy("tool").agg(F.max("calls").alias("calls"), F.sum(F.col("size") * F.col("n")).alias("tokens"), F.sum("bad").alias("errors"), median.alias("median_tokens"))
    rate = F.round(F.col("errors") / F.col("calls"), 4)
    return out.select("tool", "calls", "tokens", "errors", rate.alias("error_rate"), F.expr("tokens div calls").alias("mean_tokens"), "median_tokens")


def bundle_tokens() -> Column:
    """Estimated tokens of a fact in a context bundle: a quarter of its bytes, one at least, and eight."""
    size = F.octet_length("entity") + F.octet_length("key") + F.octet_length("value")
    return F.greatest(F.floor(size / 4), F.lit(1)).cast("long") + 8


#: The order of a bundle's other sections.
SECTIONS = ("decisions", "constraints", "work", "sessions", "notes")


def context_bundle(rows: DataFrame, aux: DataFrame, actor: str, budget: int) -> tuple[DataFrame, DataFrame]:
    """(section, item, cost, used of what a budget holds; section, dropped of what it doesn't): facts, then aux(section, id, text).

    rows need effective (confidence) and addressed. Of each (entity, key) the highest version counts
    that isn't superseded and is public or the actor's own. Order: addressed first, then effective
    confidence, then entity, key and fact_id; sections in SECTIONS' order, items by id. Whatever
    doesn't fit what is left is skipped, the first row too.
    """
    own = rows.where(F.col("superseded_by").isNull() & (~F.col("private") | (F.col("actor") == actor)) & ~F.col("deleted"))
    newest = latest(own, ("entity", "key"))
    facts = newest.select(F.lit(0).alias("place"), F.lit("facts").alias("section"), (~F.col("addressed")).alias("other"), (-F.col("effective")).alias("weak"), "entity", "key", F.col("fact_id").cast("string").alias("item"), bundle_tokens().alias("cost"))
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")).cast("int")
    cost = F.greatest(F.floor(F.octet_length("text") / 4), F.lit(1)).cast("long") + 8
    items = aux.where(F.col("section").isin(*SECTIONS)).select(place.alias("place"), "section", F.lit(False).alias("other"), F.lit(0.0).alias("weak"), F.lit("").alias("entity"), F.lit("").alias("key"), F.col("id").cast("string").alias("item"), cost.alias("cost"))
    offered = facts.unionByName(items)
    order = ["place", "other", "weak", "entity", "key", "item"]
    # once a row of a cost doesn't fit no later one of that cost does, so few rows of each cost matter
    few = first_rows(offered, ["cost"], order, budget // 9 + 1).where(F.col("rank") * F.col("cost") <= budget).drop("rank")
    kept = skip_and_continue(few, [], order, "cost", budget, 2**31 - 1, exempt_first=False, early=False).select("section", "item", "cost", "used")
    counts = offered.groupBy("section").agg(F.count("*").alias("offered")).join(kept.groupBy("section").agg(F.count("*").alias("held")), "section", "left")
    return kept, counts.select("section", (F.col("offered") - F.coalesce("held", F.lit(0))).alias("dropped")).where("dropped > 0")
