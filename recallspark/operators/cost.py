"""Cost of sessions from transcripts: segments, carried context, models, levers, plans, savings; quotas and cache folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def api_turns(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """Transcript lines with `duplicate`: a later line of an API message already met, whose usage must not count again."""
    nth = F.row_number().over(Window.partitionBy(*by, "message_id").orderBy(order))
    return lines.withColumn("duplicate", F.col("message_id").isNotNull() & (nth > 1))


def segmented(events: DataFrame, by: list[str], order: str) -> DataFrame:
    """Events with segment (compactions before), turn_in_segment (assistant turns so far) and turns_of_segment."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turn = (F.col("kind") == "assistant") & ~F.col("duplicate")
    out = events.withColumn("segment", F.sum((F.col("kind") == "compaction").cast("int")).over(w))
    inside = Window.partitionBy(*by, "segment")
    so_far = F.sum(turn.cast("int")).over(inside.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumns({"turn_in_segment": so_far, "turns_of_segment": F.sum(turn.cast("int")).over(inside)})


def session_report(events: DataFrame, by: list[str], order: str) -> DataFrame:
    """One row a session: measured tokens, assistant turns, tasks, segments with turns, content carried and the prefix left over.

    events(kind, duplicate, input, output, cache_read, cache_creation, chars, is_prompt): usage counts
    once a message. A line's content is a quarter of its chars in tokens and is read again by every
    later turn of its segment.
    """
    rows = segmented(events, by, order)
    usage = lambda c: F.sum(F.when(~F.col("duplicate"), F.coalesce(c, F.lit(0))).otherwise(0))
    carried = F.ceil(F.coalesce("chars", F.lit(0)) / 4) * F.greatest(F.col("turns_of_segment") - F.col("turn_in_segment"), F.lit(0))
    out = rows.groupBy(*by).agg(
        *(usage(c).alias(c) for c in ("input", "output", "cache_read", "cache_creation")),
        F.count_if((F.col("kind") == "assistant") & ~F.col("duplicate")).alias("turns"),
        F.count_if((F.col("kind") == "user") & F.col("is_prompt")).alias("tasks"),
        F.countDistinct(F.when(F.col("turns_of_segment") > 0, F.col("segment"))).alias("segments"),
        F.sum(F.when(F.col("kind").isin("assistant", "user"), carried).otherwise(0)).cast("long").alias("carried"),
    )
    context = F.col("input") + F.col("cache_read") + F.col("cache_creation")
    return out.withColumns({"context": context, "prefix": F.greatest(context - F.col("carried"), F.lit(0))})


def carried_by_source(events: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, source (before a colon), carried: what each kind of content costs by being read again."""
    rows = segmented(events, by, order).where(F.col("kind").isin("assistant", "user"))
    carried = F.ceil(F.coalesce("chars", F.lit(0)) / 4) * F.greatest(F.col("turns_of_segment") - F.col("turn_in_segment"), F.lit(0))
    return rows.groupBy(*by, F.substring_index("source", ":", 1).alias("source")).agg(F.sum(carried).cast("long").alias("carried"))


def models(events: DataFrame) -> DataFrame:
    """model, effort, turns, context, output, coverage: per model (effort null) and per model and effort.

    Duplicate lines don't count; usage without a model is a row of a null model. coverage: percent of
    a model's turns that have an effort, one decimal.
    """
    own = events.where(~F.col("duplicate") & (F.col("kind") == "assistant"))
    context = F.coalesce(F.col("input") + F.col("cache_read") + F.col("cache_creation"), F.lit(0))
    sums = [F.count("*").alias("turns"), F.sum(context).alias("context"), F.sum(F.coalesce("output", F.lit(0))).alias("output")]
    whole = own.groupBy("model").agg(*sums, F.round(F.count("effort") * 100 / F.count("*"), 1).alias("coverage")).withColumn("effort", F.lit(None).cast("string"))
    split = own.where("effort is not null and model is not null").groupBy("model", "effort").agg(*sums).withColumn("coverage", F.lit(None).cast("double"))
    return whole.unionByName(split)


def levers(report: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """The rules (name, condition, saving) that hold for each row of a report: its columns, lever and saving."""
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("lever"), s.cast("double").alias("saving"))) for n, c, s in rules)))
    return report.withColumn("l", F.explode(found)).select(*report.columns, "l.lever", "l.saving")


#: How much a signal of a strength counts.
STRENGTHS = {"weak": 1, "medium": 3, "strong": 9}


def ranked_plans(signals: DataFrame, by: list[str], order: str, branch: str, k: int) -> DataFrame:
    """by, slug, score, place: plans by the weights of their signals(slug, strength), k of each session.

    Plans of weak signals only are left out; ties go to slugs that begin with the branch, then to the
    first met, then by name.
    """
    weight = F.lit(0)
    for name, value in STRENGTHS.items():
        weight = F.when(F.col("strength") == name, value).otherwise(weight)
    sums = signals.groupBy(*by, "slug", branch).agg(F.sum(weight).alias("score"), F.max(weight).alias("most"), F.min(order).alias("first"))
    near = (F.length(branch) > 0) & F.startswith(F.col("slug"), F.col(branch))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc(F.coalesce(near, F.lit(False))), "first", "slug")
    return sums.where(F.col("most") > STRENGTHS["weak"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(*by, "slug", "score", "place")


def savings(pairs: DataFrame) -> DataFrame:
    """One row: n, mean saving of pairs(baseline, treated), and its 95 % interval by the normal approximation."""
    d = F.col("baseline") - F.col("treated")
    out = pairs.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt("n")
    return out.select("n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def coverage_window(events: DataFrame, by: list[str]) -> DataFrame:
    """by, events, receipts, anchored, gaps (missing seq numbers within the window), first, last."""
    out = events.groupBy(*by).agg(F.count("*").alias("events"), F.count("receipt").alias("receipts"), F.count_if("anchored").alias("anchored"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.countDistinct("seq").alias("seqs"))
    return out.select(*by, "events", "receipts", "anchored", (F.col("last") - F.col("first") + 1 - F.col("seqs")).alias("gaps"), "first", "last")


def best_matches(new: DataFrame, old: DataFrame, floor: float, most: int = 1000) -> DataFrame:
    """new_id, old_id, cosine: of each of new(id, chain, embedding) the nearest of old at or over the floor, not of its own chain.

    `new` is a batch to be stored: `most` rows at most (refused beyond), compared with all rows of old in place.
    """
    from .retrieval import cosine

    if new.count() > most:
        raise ValueError("compare a batch of at most %d" % most)
    a = new.select(F.col("id").alias("new_id"), F.col("chain").alias("new_chain"), F.col("embedding").alias("a"))
    near = old.join(F.broadcast(a), F.col("chain") != F.col("new_chain")).select("new_id", F.col("id").alias("old_id"), cosine(F.col("a"), F.col("embedding")).alias("cosine")).where(F.col("cosine") >= floor)
    return near.groupBy("new_id").agg(F.max(F.struct("cosine", (-F.col("old_id")).alias("o"))).alias("best")).select("new_id", (-F.col("best.o")).alias("old_id"), "best.cosine")


def session_plans(events: DataFrame) -> DataFrame:
    """session, principal, plan, closed, revoked, reason, invocations: the state of the last plan sealed in each session.

    events(line, kind sealed|closed|revoked|invoked, session, principal, plan, reason): what comes
    before the seal doesn't count.
    """
    sealed = events.where("kind = 'sealed'").groupBy("session").agg(F.max_by(F.struct("principal", "plan"), "line").alias("p"), F.max("line").alias("sealed_at"))
    later = events.where("kind <> 'sealed'").join(sealed.select("session", "sealed_at"), "session").where("line > sealed_at")
    by = later.groupBy("session").agg(F.bool_or(F.col("kind") == "closed").alias("closed"), F.bool_or(F.col("kind") == "revoked").alias("revoked"), F.max_by("reason", F.when(F.col("kind").isin("closed", "revoked"), F.col("line"))).alias("reason"), F.count_if(F.col("kind") == "invoked").alias("invocations"))
    no = F.lit(False)
    return sealed.join(by, "session", "left").select("session", "p.principal", "p.plan", F.coalesce("closed", no).alias("closed"), F.coalesce("revoked", no).alias("revoked"), "reason", F.coalesce("invocations", F.lit(0)).alias("invocations"))


def cache_rows(events: DataFrame) -> DataFrame:
    """The extraction cache: key, hits, last_hit, verifier_score, confidence, updates, invalidated.

    events(line, key, kind insert|hit|verify|confidence|invalidate, at, value). An insert starts the
    key anew; what comes before the first one is left out. Confidence deltas are clamped one by one,
    so a key's events since its last insert are folded in order.
    """
    last = events.where("kind = 'insert'").groupBy("key").agg(F.max("line").alias("since"))
    live = events.join(last, "key").where("line >= since")
    flat = live.groupBy("key").agg(
        F.count_if(F.col("kind") == "hit").alias("hits"), F.max(F.when(F.col("kind").isin("hit", "insert"), F.col("at"))).alias("last_hit"),
        F.max_by("value", F.when(F.col("kind") == "verify", F.col("line"))).alias("verifier_score"),
        F.max(F.when(F.col("kind") == "insert", F.col("value"))).alias("start"), F.count_if(F.col("kind") == "confidence").alias("updates"),
        F.bool_or(F.col("kind") == "invalidate").alias("invalidated"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "confidence", F.struct("line", "value")))).alias("deltas"),
    )
    confidence = F.aggregate("deltas", F.col("start"), lambda acc, x: F.least(F.greatest(acc + x["value"], F.lit(0.0)), F.lit(1.0)))
    return flat.select("key", "hits", "last_hit", "verifier_score", confidence.alias("confidence"), "updates", "invalidated")


def cache_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.count_if("invalidated").alias("invalidated"), F.count("verifier_score").alias("verified"), F.sum("hits").alias("hits"))


MILLI = 1000


def refilled(tokens: int, elapsed: int, capacity: int, per_minute: int) -> int:
    """Thousandths of tokens after some seconds."""
    return min(tokens + elapsed * per_minute * MILLI // 60, capacity * MILLI)


def quota(requests: DataFrame, keys: list[str], at: str, capacity: int, per_minute: int) -> DataFrame:
    """Each request with allowed, remaining and retry_after (seconds), by a token bucket for each key in time order.

    at: whole seconds; ties in the order of `tie`, a column that tells requests apart. Rows stream
    through a task sorted by key, so a key's requests are never held together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tokens, last = None, 0, 0
        for rows in batches:
            out = []
            for k, now in zip(rows[keys].itertuples(index=False, name=None), rows[at].tolist(), strict=True):
                if k != key:
                    key, tokens, last = k, capacity * MILLI, now
                tokens, last = refilled(tokens, max(now - last, 0), capacity, per_minute), now
                ok = tokens >= MILLI
                tokens -= MILLI if ok else 0
                wait = 0 if ok else max(1, -(-(MILLI - tokens) * 60 // (per_minute * MILLI)))
                out.append((ok, tokens // MILLI if ok else None, wait))
            yield rows.assign(allowed=[o[0] for o in out], remaining=pd.array([o[1] for o in out], "Int64"), retry_after=[o[2] for o in out])

    dealt = requests.repartition(*keys).sortWithinPartitions(*keys, at, "tie")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return dealt.mapInPandas(run, f"{fields}, allowed boolean, remaining long, retry_after long")
