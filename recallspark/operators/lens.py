"""Capabilities, code graphs, storylines, context graphs, dossiers and stores of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.steps import kept


def gaps(capabilities: DataFrame) -> DataFrame:
    """id, system, type, severity of what capabilities(id, system, maturity, unit, integration, other, audit, dod) lack.

    unit, integration and other are numbers of tests, dod of assertions; a null maturity is planned.
    """
    shipped = F.coalesce("maturity", F.lit("planned")) == "shipped"
    some = (F.col("unit") + F.col("integration") + F.col("other")) > 0
    gap = lambda kind, severity: F.struct(F.lit(kind).alias("type"), severity.alias("severity"))
    grave, high = F.when(shipped, "critical").otherwise("high"), F.lit("high")
    tests = F.when(~some, gap("no_tests", grave)).when(F.col("unit") == 0, gap("no_unit_tests", F.lit("medium"))).when((F.col("integration") == 0) & shipped, gap("no_integration_tests", high))
    found = F.array_compact(F.array(tests, F.when(F.col("audit") == "gap", gap("audit_gap", grave)), F.when(F.col("dod") == 0, gap("no_dod", high))))
    return capabilities.select("id", "system", F.explode(found).alias("g")).select("id", "system", "g.type", "g.severity")


def coverage_report(capabilities: DataFrame) -> DataFrame:
    """system, total, tested, audited, shipped."""
    some = (F.col("unit") + F.col("integration") + F.col("other")) > 0
    return capabilities.groupBy("system").agg(F.count("*").alias("total"), F.count_if(some).alias("tested"), F.count_if(F.col("audit") == "audited").alias("audited"), F.count_if(F.col("maturity") == "shipped").alias("shipped"))


def promise_coverage(capabilities: DataFrame) -> DataFrame:
    """promise and how many of its capabilities (promises: an array) there are, by maturity, tested and audited."""
    some = (F.col("unit") + F.col("integration") + F.col("other")) > 0
    each = capabilities.withColumn("promise", F.explode(F.array_distinct("promises")))
    stage = F.coalesce("maturity", F.lit("planned"))
    return each.groupBy("promise").agg(F.count("*").alias("total"), *(F.count_if(stage == m).alias(m) for m in ("shipped", "built", "building", "planned")), F.count_if(some).alias("tested"), F.count_if(F.col("audit") == "audited").alias("audited"))


def capability_status(catalog: DataFrame, passport: dict, flags: list[str], budget: int | None, heavy: int, tiers: list[str]) -> DataFrame:
    """cap, affinity and status of catalog(cap, affinity, min_tier, flag, cost): the first that holds of

    denied, other_affinity, tier_insufficient, feature_disabled, budget_exhausted, else granted.
    passport: denied, affinities ('*' is all), tier; a heavy capability needs a budget of `heavy`.
    """
    rank = lambda c: F.array_position(F.array(*map(F.lit, tiers)), c)
    status = F.when(F.col("cap").isin(passport.get("denied", [])), "denied")
    if "*" not in passport["affinities"]:
        status = status.when(~F.col("affinity").isin(passport["affinities"]), "other_affinity")
    status = status.when(F.col("min_tier").isNotNull() & (rank(F.col("min_tier")) > tiers.index(passport["tier"]) + 1), "tier_insufficient")
    status = status.when(F.col("flag").isNotNull() & ~F.col("flag").isin(flags), "feature_disabled")
    if budget is not None and budget < heavy:
        status = status.when(F.col("cost") == "heavy", "budget_exhausted")
    return catalog.select("cap", "affinity", status.otherwise("granted").alias("status"))


def surviving_edges(edges: DataFrame, statuses: DataFrame) -> DataFrame:
    """edges(src, dst, ...) between granted capabilities."""
    granted = statuses.where("status = 'granted'").select("cap")
    return edges.join(granted.withColumnRenamed("cap", "src"), "src", "left_semi").join(granted.withColumnRenamed("cap", "dst"), "dst", "left_semi")


def storyline(refs: DataFrame, root: str, depth: int = 5, most: int = 200) -> DataFrame:
    """node, parent, level, cycle: the tree of refs(file, to_file) from a root, level by level.

    A file met before on its own path is a leaf and marked; each level's nodes come by parent and
    name, and the tree has `most` nodes at most.
    """
    own = refs.select("file", "to_file").where("file <> to_file").distinct()
    spark = refs.sparkSession
    front = spark.createDataFrame([([root], root)], "path array<string>, node string")
    tree = spark.createDataFrame([(root, None, 0, False)], "node string, parent string, level int, cycle boolean")
    room = most - 1
    for level in range(1, depth + 1):
        met = front.join(own, front["node"] == own["file"]).select(F.col("path"), "to_file", F.array_contains("path", F.col("to_file")).alias("cycle"))
        nth = met.orderBy(F.array_join("path", "\u0000"), "to_file").limit(room)
        nth = kept(nth, "storyline")
        tree = tree.union(nth.select("to_file", F.element_at("path", -1), F.lit(level), "cycle"))
        found = nth.count()
        room -= found
        if not found or not room:
            break
        front = nth.where("not cycle").select(F.concat("path", F.array("to_file")).alias("path"), F.col("to_file").alias("node"))
    return tree


def call_edges(refs: DataFrame) -> DataFrame:
    """src, dst, kind, confidence of refs(file, to_file, calls) between files: 6000 basis points and 1000 a call, 10000 at most."""
    by = refs.where("file <> to_file").groupBy(F.col("file").alias("src"), F.col("to_file").alias("dst")).agg(F.sum("calls").alias("calls"))
    return by.select("src", "dst", F.lit("calls").alias("kind"), F.least(F.lit(6000) + F.col("calls") * 1000, F.lit(10000)).cast("int").alias("confidence"))


def import_edges(deps: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst, kind, confidence of deps(file, module): the file whose module or path it is, else whose path ends with it."""
    named = files.select(F.col("path").alias("dst"), F.explode(F.array_distinct(F.array("module", "path"))).alias("module"))
    exact = deps.join(named, "module").groupBy("file", "module").agg(F.min("dst").alias("dst"))
    # a path ends with a module: each of a path's ends is a row, so this is an equality join too
    bare = F.regexp_replace("path", r"\.[A-Za-z0-9]+$", "")
    parts = F.split(bare, "/")
    ends = files.select(F.col("path").alias("dst"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("tail"))
    rest = deps.join(exact, ["file", "module"], "left_anti").withColumn("tail", F.replace(F.replace("module", F.lit("::"), F.lit("/")), F.lit("."), F.lit("/")))
    loose = rest.join(ends, "tail").groupBy("file", "module").agg(F.min("dst").alias("dst"))
    both = exact.select("file", "dst").union(loose.select("file", "dst")).where("file <> dst").distinct()
    return both.select(F.col("file").alias("src"), "dst", F.lit("imports").alias("kind"), F.lit(10000).alias("confidence"))


def topic(entity: Column) -> Column:
    """The last part of an entity without dashes around it and without a trailing ISO date."""
    tail = F.regexp_replace(F.substring_index(entity, ":", -1), r"^-+|-+$", "")
    return F.regexp_replace(tail, r"(?<=.)-\d{4}-\d{2}-\d{2}$", "")


def recurring(facts: DataFrame, prefix: str, least: int) -> DataFrame:
    """topic, n, first, last: topics of a prefix's facts(entity, stored_at) that come `least` times or more."""
    own = facts.where(F.startswith("entity", F.lit(prefix)))
    return own.groupBy(topic(F.col("entity")).alias("topic")).agg(F.count("*").alias("n"), F.min("stored_at").alias("first"), F.max("stored_at").alias("last")).where(F.col("n") >= least)


def context_graph(facts: DataFrame, kinds: dict[str, str], refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(node, kind), edges(src, dst, kind)): an entity of a known prefix is a node of its kind, its keys' values that name one are edges; refs(file, to_file) add files."""
    kind = F.lit(None).cast("string")
    for prefix, name in kinds.items():
        kind = F.when(F.startswith("entity", F.lit(prefix)), name).otherwise(kind)
    own = facts.select("entity", "key", "value", kind.alias("kind")).where("kind is not null")
    entities = own.select(F.col("entity").alias("node"), "kind").distinct()
    files = refs.select(F.col("file").alias("node")).union(refs.select("to_file")).distinct().select("node", F.lit("file").alias("kind"))
    links = own.join(entities.select(F.col("node").alias("value")), "value").select(F.col("entity").alias("src"), F.col("value").alias("dst"), F.col("key").alias("kind")).distinct()
    return entities.union(files), links.union(refs.select("file", "to_file", F.lit("references")).distinct())


def last_state(ops: DataFrame, key: list[str], order: str) -> DataFrame:
    """What a store's journal leaves: of each key the last record, none where that is a delete. Null keys are bad lines and skipped."""
    good = ops
    for k in key:
        good = good.where(F.col(k).isNotNull())
    last = good.groupBy(*(F.col(k).alias(f"k{i}") for i, k in enumerate(key))).agg(F.max_by(F.struct("*"), order).alias("row"))
    return last.select("row.*").where("op <> 'delete'")


def retained_traces(spans: DataFrame, now: Column, ttl: str, newest: int) -> DataFrame:
    """Spans stored within `ttl`, of the `newest` traces by their last span."""
    live = spans.where(F.col("stored_at") >= now - F.expr(f"interval {ttl}"))
    keep = live.groupBy("trace_id").agg(F.max("stored_at").alias("last")).orderBy(F.desc("last"), F.desc("trace_id")).limit(newest)
    return live.join(keep.select("trace_id"), "trace_id", "left_semi")


def releases(spans: DataFrame) -> DataFrame:
    """release, first, spans, traces."""
    return spans.groupBy("release").agg(F.min("stored_at").alias("first"), F.count("*").alias("spans"), F.countDistinct("trace_id").alias("traces"))


def volume(spans: DataFrame, ceiling: int) -> DataFrame:
    """One row: spans, percent of the ceiling (whole), and whether more are refused."""
    return spans.agg(F.count("*").alias("spans")).select("spans", F.expr(f"spans * 100 div {ceiling}").alias("percent"), (F.col("spans") >= ceiling).alias("refused"))


def pack_sections(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """section, rows, digest of an export: live public facts, and sessions; the digest adds up row hashes, so order and parts don't matter."""
    own = facts.where(~F.col("deleted") & ~F.col("private")).select(F.lit("facts").alias("section"), F.to_json(F.struct("fact_id", "entity", "key", "value")).alias("line"))
    other = sessions.select(F.lit("sessions").alias("section"), F.to_json(F.struct(*sessions.columns)).alias("line"))
    part = F.conv(F.substring(F.sha2(F.col("line").cast("binary"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return own.union(other).groupBy("section").agg(F.count("*").alias("rows"), F.sum(part).cast("decimal(38,0)").cast("string").alias("digest"))


def dossier(facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """kind, subject, object, confidence: claims from decisions and constraints among facts and from dead-code verdicts."""
    kind = F.when(F.startswith("entity", F.lit("decision:")), "decision").when(F.startswith("entity", F.lit("constraint:")), "constraint")
    own = facts.select(kind.alias("kind"), F.col("entity").alias("subject"), F.concat_ws("=", "key", "value").alias("object"), "confidence").where("kind is not null")
    dead = verdicts.select(F.lit("dead_code").alias("kind"), F.col("name").alias("subject"), F.col("verdict").alias("object"), F.when(F.col("actionable"), 0.9).otherwise(0.5).alias("confidence"))
    return own.union(dead)


#: How grave an action of a tool is.
CONSEQUENCE = {"delete": "irreversible", "deploy": "external", "send": "external", "write": "reversible", "read": "none"}


def enriched_actions(actions: DataFrame, facts: DataFrame) -> DataFrame:
    """actions(id, tool, verb, target) with consequence (by verb, unknown otherwise) and related: live facts about the target."""
    about = facts.where(~F.col("deleted") & F.col("superseded_by").isNull()).groupBy(F.col("entity").alias("target")).agg(F.count("*").alias("related"))
    grave = F.lit("unknown")
    for verb, value in CONSEQUENCE.items():
        grave = F.when(F.col("verb") == verb, value).otherwise(grave)
    return actions.join(about, "target", "left").select("id", "tool", grave.alias("consequence"), F.coalesce("related", F.lit(0)).alias("related"))


def newest_binding(rows: DataFrame, by: str, at: str, tie: str) -> DataFrame:
    """rows with newest: whether it is its group's latest."""
    return rows.withColumn("newest", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), F.desc(tie))) == 1)
