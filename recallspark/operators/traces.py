"""Spans, claims, ledgers and cost: analytics over traces and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def code_path(spans: DataFrame, needle: str) -> DataFrame:
    """depth, name, calls, duration, had_error over the traces that hold a span named `needle`."""
    traces = spans.where(F.col("name") == needle).select("trace_id").distinct()
    own = spans.join(traces, "trace_id", "left_semi")
    return own.groupBy("depth", "name").agg(F.count("*").alias("calls"), F.sum("duration").alias("duration"), F.bool_or("had_error").alias("had_error"))


def callers(spans: DataFrame) -> DataFrame:
    """caller, callee, calls: spans joined to their parents; a root's caller is null."""
    parents = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.col("name").alias("caller"))
    both = spans.join(parents, ["trace_id", "parent_id"], "left")
    return both.groupBy("caller", F.col("name").alias("callee")).agg(F.count("*").alias("calls"))


def liveness(symbols: DataFrame, spans: DataFrame) -> DataFrame:
    """What two tiers say of each of symbols(name, file, in_scan, flagged_dead, test_only).

    spans(name, file, duration, outcome): outcome is 'empty', 'non_empty' or null (unrecorded). Adds
    executions, duration, empties, unrecorded, always_empty, file_ran (a span of the symbol's own
    file was seen, so that silence means something) and verdict.
    """
    ran = spans.groupBy("name").agg(
        F.count("*").alias("executions"), F.sum("duration").alias("duration"),
        F.count_if(F.col("outcome") == "empty").alias("empties"), F.count_if(F.col("outcome").isNull()).alias("unrecorded"),
    )
    files = spans.where("file is not null").select("file", F.lit(True).alias("file_ran")).distinct()
    out = symbols.join(ran, "name", "left").join(files, "file", "left")
    zero = F.lit(0)
    out = out.withColumns({
        "executions": F.coalesce("executions", zero), "duration": F.coalesce("duration", zero), "empties": F.coalesce("empties", zero),
        "unrecorded": F.coalesce("unrecorded", zero), "file_ran": F.coalesce("file_ran", F.lit(False)),
    })
    ever, dead = F.col("executions") > 0, F.col("flagged_dead")
    verdict = (
        F.when(~F.col("in_scan"), "unknown_symbol")
        .when(dead & ever, "static_dead_but_executed__extractor_false_positive")
        .when(dead & F.col("file_ran"), "dead_candidate__static_and_runtime_agree")
        .when(dead, "dead_candidate__static_only__runtime_window_never_reached_it")
        .when(ever, "live")
        .when(F.col("test_only"), "test_only__referenced_only_by_tests")
        .otherwise("reachable_but_unobserved__widen_the_window")
    )
    always = ever & (F.col("unrecorded") == 0) & (F.col("empties") == F.col("executions"))
    return out.withColumns({"always_empty": always, "verdict": verdict})


def dead_code(dead: DataFrame, spans: DataFrame) -> DataFrame:
    """Verdict on each of dead(name, file, line): runs, verdict, agreeing (tiers), single_signal, actionable, finding_id.

    Silence is evidence only in a window with spans, and actionable only where the own file ran.
    """
    runs = spans.groupBy("name").agg(F.count("*").alias("runs"))
    files = spans.where("file is not null").select("file", F.lit(True).alias("ran")).distinct()
    window = spans.limit(1).agg((F.count("*") == 0).alias("empty"))
    out = dead.join(runs, "name", "left").join(files, "file", "left").crossJoin(F.broadcast(window)).withColumn("runs", F.coalesce("runs", F.lit(0)))
    ran = F.col("runs") > 0
    verdict = F.when(ran, "extractor_false_positive__static_dead_but_executed").when(F.col("empty"), "dead_candidate__static_only").otherwise("dead_candidate__static_and_runtime_agree")
    agreeing = F.when(ran | F.col("empty"), 1).otherwise(2)
    actionable = (agreeing == 2) & F.coalesce("ran", F.lit(False))
    return out.select("name", "file", "line", "runs", verdict.alias("verdict"), agreeing.alias("agreeing"), (~ran & F.col("empty")).alias("single_signal"), actionable.alias("actionable"), F.concat_ws(":", F.lit("dead"), "file", "line").alias("finding_id"))


def dead_code_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"), F.count_if("actionable").alias("actionable"))


def dependents(refs: DataFrame, spans: DataFrame, symbol: str) -> DataFrame:
    """caller, calls, evidence ('static', 'runtime' or 'both') of a symbol: refs(caller, callee, calls) and parents of its spans."""
    static = refs.where(F.col("callee") == symbol).groupBy("caller").agg(F.sum("calls").alias("static"))
    runtime = callers(spans.select("trace_id", "span_id", "parent_id", "name")).where((F.col("callee") == symbol) & F.col("caller").isNotNull()).select("caller", F.col("calls").alias("runtime"))
    both = static.join(runtime, "caller", "full_outer")
    evidence = F.when(F.col("runtime").isNull(), "static").when(F.col("static").isNull(), "runtime").otherwise("both")
    return both.select("caller", (F.coalesce("static", F.lit(0)) + F.coalesce("runtime", F.lit(0))).alias("calls"), evidence.alias("evidence"))


def resolved_symbols(spans: DataFrame, symbols: DataFrame, margin: int = 4) -> DataFrame:
    """Each of spans(span_id, file, name, line) with the symbol of symbols(symbol_id, file, name, at) nearest to its line.

    how: 'extracted' (the only candidate), 'inferred' (nearest by a margin over the runner-up),
    'ambiguous' (no line, or none by the margin; symbol_id is null) or 'unknown'. score falls with
    the distance and rises with the margin.
    """
    many = symbols.groupBy("file", "name").agg(F.count("*").alias("candidates"))
    near = spans.join(symbols, ["file", "name"]).withColumn("distance", F.abs(F.col("line") - F.col("at")))
    placed = near.withColumn("place", F.row_number().over(Window.partitionBy("span_id").orderBy("distance", "symbol_id"))).where("place <= 2")
    first, second = (F.when(F.col("place") == n, F.struct("symbol_id", "distance")) for n in (1, 2))
    two = placed.groupBy("span_id").agg(F.min(first).alias("best"), F.min(second)["distance"].alias("second"))
    out = spans.join(many, ["file", "name"], "left").join(two, "span_id", "left")
    apart = F.col("second") - F.col("best.distance")
    how = F.when(F.col("candidates").isNull(), "unknown").when(F.col("candidates") == 1, "extracted").when(F.col("line").isNull() | (apart < margin), "ambiguous").otherwise("inferred")
    score = F.when(how == "inferred", F.least(F.greatest(apart / (apart + F.col("best.distance") + 1.0), F.lit(0.01)), F.lit(1.0)))
    return out.select("span_id", how.alias("how"), F.when(how.isin("extracted", "inferred"), F.col("best.symbol_id")).alias("symbol_id"), score.alias("score"))


def trace_list(spans: DataFrame) -> DataFrame:
    """trace_id, spans, duration, had_error."""
    return spans.groupBy("trace_id").agg(F.count("*").alias("spans"), F.sum("duration").alias("duration"), F.bool_or("had_error").alias("had_error"))


def trace_diff(spans: DataFrame, a: int, b: int, slower_by: float = 1.0) -> DataFrame:
    """name, side (only_a, only_b or both), slower, first_divergence of two traces' steps.

    slower: a step of b takes over twice as long as in a and over `slower_by` more (of repeated steps
    the last in order counts in a, any in b). first_divergence marks the earliest step, by depth and
    name, of a that b lacks, else of b that a lacks.
    """
    def side(trace: int, columns: list) -> DataFrame:
        return spans.where(F.col("trace_id") == trace).groupBy("name").agg(F.min("depth").alias(f"at_{columns[0]}"), *columns[1:])

    own = side(a, ["a", F.max_by("duration", F.struct("depth", "duration")).alias("a")])
    other = side(b, ["b", F.max("duration").alias("b")])
    both = own.join(other, "name", "full_outer")
    where = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("both")
    slower = F.coalesce((F.col("b") > 2 * F.col("a")) & (F.col("b") - F.col("a") > slower_by), F.lit(False))
    rows = both.select("name", where.alias("side"), slower.alias("slower"), F.coalesce("at_a", "at_b").alias("at"))
    first = rows.where("side <> 'both'").agg(F.min(F.struct(F.when(F.col("side") == "only_a", 0).otherwise(1).alias("s"), "at", "name"))["name"].alias("first"))
    return rows.crossJoin(F.broadcast(first)).select("name", "side", "slower", F.coalesce(F.col("name") == F.col("first"), F.lit(False)).alias("first_divergence"))


def reconcile(log: DataFrame, other: DataFrame) -> DataFrame:
    """One row: matched, missing on either side and differing digests of two tables (key, digest)."""
    both = log.withColumnRenamed("digest", "a").join(other.withColumnRenamed("digest", "b"), "key", "full_outer")
    count = lambda c: F.count_if(c)
    return both.agg(
        count(F.col("a") == F.col("b")).alias("matched"), count(F.col("b").isNull()).alias("missing_in_other"),
        count(F.col("a").isNull()).alias("missing_in_log"), count(F.col("a") != F.col("b")).alias("mismatched"),
    )


def claims_diff(old: DataFrame, new: DataFrame, least: float = 0.001) -> DataFrame:
    """kind, subject, object, change (added, removed, changed) of claims(kind, subject, object, confidence); null objects are equal."""
    a, b = old.alias("a"), new.alias("b")
    same = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.subject") == F.col("b.subject")) & F.col("a.object").eqNullSafe(F.col("b.object"))
    both = a.join(b, same, "full_outer")
    change = F.when(F.col("a.kind").isNull(), "added").when(F.col("b.kind").isNull(), "removed").when(F.abs(F.col("a.confidence") - F.col("b.confidence")) > least, "changed")
    out = both.select(F.coalesce("a.kind", "b.kind").alias("kind"), F.coalesce("a.subject", "b.subject").alias("subject"), F.coalesce("a.object", "b.object").alias("object"), change.alias("change"))
    return out.where("change is not null")


def agreement(claims: DataFrame) -> DataFrame:
    """kind, subject, object, agents, status: agreed by two agents or more, else unique."""
    out = claims.groupBy("kind", "subject", "object").agg(F.countDistinct("agent").alias("agents"))
    return out.withColumn("status", F.when(F.col("agents") >= 2, "agreed").otherwise("unique"))


def burn_attribution(burns: DataFrame, plans: DataFrame, most_plans: int = 100_000) -> DataFrame:
    """plan, sessions, context, output, method: what each plan's sessions burnt.

    burns(session, start, end, passport, slugs, context, output), plans(plan, window_start,
    window_end, agents). A session with slugs shares its tokens evenly (whole numbers, by the number
    of slugs) among those that are plans; one without counts in full for every plan whose window
    meets its own, ends included. method: link, window, passport+window (every window confirmed by
    an agent) or mixed. The interval join broadcasts plans, which must be `most_plans` at most; it is
    refused beyond.
    """
    if plans.count() > most_plans:
        raise ValueError("too many plans for a broadcast interval join")
    n = F.size("slugs")
    linked = burns.where(n > 0).select("session", F.explode("slugs").alias("plan"), F.floor(F.col("context") / n).alias("context"), F.floor(F.col("output") / n).alias("output"))
    linked = linked.join(F.broadcast(plans.select("plan")), "plan", "left_semi").select("plan", "context", "output", F.lit(True).alias("link"), F.lit(False).alias("confirmed"))
    alone = burns.where(F.coalesce(n, F.lit(0)) <= 0)
    meets = (alone["start"] <= plans["window_end"]) & (plans["window_start"] <= alone["end"])
    confirmed = F.coalesce(F.array_contains("agents", F.col("passport")), F.lit(False))
    met = alone.join(F.broadcast(plans), meets).select("plan", "context", "output", F.lit(False).alias("link"), confirmed.alias("confirmed"))
    by = linked.unionByName(met).groupBy("plan").agg(
        F.count("*").alias("sessions"), F.sum("context").alias("context"), F.sum("output").alias("output"),
        F.count_if("link").alias("links"), F.count_if("confirmed").alias("sure"),
    )
    windows = F.col("sessions") - F.col("links")
    method = F.when(windows == 0, "link").when(F.col("links") > 0, "mixed").when(F.col("sure") == 0, "window").when(F.col("sure") == windows, "passport+window").otherwise("mixed")
    return by.select("plan", "sessions", "context", "output", method.alias("method"))


def segments(turns: DataFrame, by: list[str], order: list[str], cut: str) -> DataFrame:
    """turns with segment (cuts so far) and turn_in_segment (from 1)."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = turns.withColumn("segment", F.sum(F.col(cut).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("turn_in_segment", F.row_number().over(Window.partitionBy(*by, "segment").orderBy(*order)))


#: A rewrite reads less than READ of the context before, writes more than WRITE of it, which is LEAST at least.
READ, WRITE, LEAST = 0.5, 0.4, 5000
#: Minutes after which a cache has certainly expired, and bands of longer gaps.
TTL = 60.0
BANDS = ((65.0, "60-65m"), (120.0, "65-120m"), (480.0, "120-480m"))


def cache_ledger(events: DataFrame, by: list[str], order: str) -> DataFrame:
    """Turns whose cache was rewritten, with cause: by, turn (from 0), tokens, gap (minutes), cause and band.

    events(kind, at, cache_read, cache_creation, input, attachment, removed_names): kind is
    'assistant' (a turn where cache_read is not null), 'compaction' or other. A turn after a
    compaction is none. The cause is the first that holds of: a gap of TTL, an effort change, a date
    change, a tool delta, an instructions delta, a hook, each met between the two turns.
    """
    turn = (F.col("kind") == "assistant") & F.col("cache_read").isNotNull()
    w = Window.partitionBy(*by).orderBy(order)
    # rows up to a turn belong to it: the number of turns before each row
    parts = events.withColumns({"is_turn": turn, "turn": F.sum(turn.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - turn.cast("int")})
    a = F.col("attachment")
    has = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    turns = parts.groupBy(*by, "turn").agg(
        has(F.col("is_turn")).alias("real"), has(F.col("kind") == "compaction").alias("compacted"),
        *(F.max(F.when(F.col("is_turn"), F.col(c))).alias(c) for c in ("cache_read", "cache_creation", "input", "at")),
        has(a.isin("ultra_effort_enter", "ultra_effort_exit")).alias("effort"), has(a == "date_change").alias("date"),
        has(a == "deferred_tools_delta").alias("tools"), has((a == "deferred_tools_delta") & (F.size("removed_names") > 0)).alias("removed"),
        has(a == "mcp_instructions_delta").alias("instructions"), has(F.startswith(a, F.lit("hook_"))).alias("hook"),
    ).where("real")
    pair = Window.partitionBy(*by).orderBy("turn")
    context = F.col("input") + F.col("cache_read") + F.col("cache_creation")
    pairs = turns.withColumns({"before": F.lag(context).over(pair), "gap": (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.lag("at").over(pair).cast("timestamp"))) / 6e7})
    rewritten = pairs.where(~F.col("compacted") & (F.col("before") >= LEAST) & (F.col("cache_read") < READ * F.col("before")) & (F.col("cache_creation") > WRITE * F.col("before")))
    cause = F.when(F.col("gap") >= TTL, "ttl_expiry").when(F.col("effort"), "effort_change").when(F.col("date"), "date_change")
    cause = cause.when(F.col("tools") & F.col("removed"), "tool_delta_with_removals").when(F.col("tools"), "tool_delta_add_only")
    cause = cause.when(F.col("instructions"), "mcp_instructions_delta").when(F.col("hook"), "hook_block").otherwise("unattributed")
    band = F.lit("480m+")
    for below, name in reversed(BANDS):
        band = F.when(F.col("gap") < below, name).otherwise(band)
    return rewritten.select(*by, "turn", F.col("cache_creation").alias("tokens"), F.round("gap", 1).alias("gap"), cause.alias("cause"), F.when(cause == "ttl_expiry", band).alias("band"))


def idle_ledger(turns: DataFrame, by: list[str], order: list[str], at: str) -> DataFrame:
    """by, band, n: minutes since the turn before, in bands under5, under60 and over60; first turns have none."""
    w = Window.partitionBy(*by).orderBy(*order)
    idle = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))) / 6e7
    band = F.when(F.col("idle") < 5, "under5").when(F.col("idle") < 60, "under60").otherwise("over60")
    return turns.withColumn("idle", idle).where("idle is not null").groupBy(*by, band.alias("band")).agg(F.count("*").alias("n"))
