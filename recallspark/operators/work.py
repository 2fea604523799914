"""Work, sessions and coordination: attention, overlaps, boards, checks, queues, lists, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zone(gated: Column, state: Column) -> Column:
    """'needs_you', 'running', 'done_review' or null: a pending gate or a block comes first."""
    return F.when(gated | (state == "blocked"), "needs_you").when(state == "in_progress", "running").when(state == "complete", "done_review")


def attention(work: DataFrame, gates: DataFrame, sessions: DataFrame, now: int, stale: int) -> DataFrame:
    """One row: needs_you, running, done_review, gate_pending.

    work(id, state, superseded), pending gates(work_id), sessions(last_seen). Superseded work doesn't
    count; gates without live work count once for each work id; sessions run while their heartbeat is
    not older than `stale` nor from the future.
    """
    gated = gates.select(F.col("work_id").alias("id"), F.lit(True).alias("gated")).distinct()
    live = work.where(~F.col("superseded"))
    zones = live.join(gated, "id", "left").select(zone(F.coalesce("gated", F.lit(False)), F.col("state")).alias("zone"))
    unjoined = gated.join(live, "id", "left_anti").select(F.lit("needs_you").alias("zone"))
    age = F.lit(now) - F.col("last_seen")
    fresh = sessions.where((age >= 0) & (age <= stale)).select(F.lit("running").alias("zone"))
    counts = zones.union(unjoined).union(fresh).agg(*(F.count_if(F.col("zone") == z).alias(z) for z in ("needs_you", "running", "done_review")))
    return counts.crossJoin(gates.agg(F.count("*").alias("gate_pending")))


def trimmed(path: Column) -> Column:
    return F.regexp_replace(path, r"/+$", "")


def prefixes(path: Column) -> Column:
    """A path and all folders it lies in, without trailing slashes."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def path_overlaps(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Pairs of mine(session, path) and theirs(peer, path) that are equal or hold one another: session, peer, yours, theirs.

    Equality joins of a path with the other's folders, not a comparison of all with all.
    """
    a = mine.select("session", F.col("path").alias("yours"), trimmed(F.col("path")).alias("a")).where("a <> ''")
    b = theirs.select("peer", F.col("path").alias("theirs"), trimmed(F.col("path")).alias("b")).where("b <> ''")
    above = a.join(b.withColumn("a", F.explode(prefixes(F.col("b")))), "a")
    below = a.withColumn("b", F.explode(prefixes(F.col("a")))).join(b, "b")
    return above.select("session", "peer", "yours", "theirs").union(below.select("session", "peer", "yours", "theirs")).distinct()


def overlaps(announced: DataFrame, peers: DataFrame, leases: DataFrame) -> DataFrame:
    """session, peer, kind, theirs, yours: what an announcement meets.

    announced and peers(session, passport, slug, target, paths, live); leases(holder, path). Kinds:
    execplan and deploy_target (equal), intent_path and lease (overlapping paths). Own sessions and
    passports and peers that aren't live are left out.
    """
    live = peers.where("live").select(F.col("session").alias("peer"), "slug", "target", "paths")
    equal = None
    for kind, column in (("execplan", "slug"), ("deploy_target", "target")):
        both = announced.select("session", column).join(live.select("peer", column), column).where("session <> peer")
        rows = both.select("session", F.col("peer").cast("string").alias("peer"), F.lit(kind).alias("kind"), F.col(column).alias("theirs"), F.col(column).alias("yours"))
        equal = rows if equal is None else equal.union(rows)
    own = announced.select("session", "passport", F.explode("paths").alias("path"))
    met = path_overlaps(own, live.select("peer", F.explode("paths").alias("path"))).where("session <> peer")
    held = path_overlaps(own.select("session", F.regexp_replace("path", "^/+", "").alias("path")), leases.select(F.col("holder").alias("peer"), "path"))
    mine = announced.select("session", F.col("passport").alias("peer"))
    held = held.join(mine, ["session", "peer"], "left_anti")
    paths = met.select("session", F.col("peer").cast("string").alias("peer"), F.lit("intent_path").alias("kind"), "theirs", "yours")
    return equal.union(paths).union(held.select("session", "peer", F.lit("lease").alias("kind"), "theirs", "yours"))


def board(sessions: DataFrame, intents: DataFrame, leases: DataFrame) -> DataFrame:
    """session, passport, last_seen, slug (of the newest intent), intents, leases for each of sessions(session, passport, last_seen)."""
    newest = intents.groupBy("session").agg(F.max_by("slug", F.struct("at", "slug")).alias("slug"), F.count("*").alias("intents"))
    held = leases.groupBy(F.col("holder").alias("passport")).agg(F.count("*").alias("leases"))
    both = sessions.join(newest, "session", "left").join(held, "passport", "left")
    return both.select("session", "passport", "last_seen", "slug", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("intents", "leases")))


def fleet_rollup(catalog: DataFrame, calls: DataFrame, offered: DataFrame) -> DataFrame:
    """Every tool of catalog(tool) and calls(tool, passport, tokens, error, latency), with how often it was offered(tool, passport).

    Columns tool, in_catalog, calls, errors, error_rate, passports, avg_tokens, p50 (upper median),
    offered_passports, classification.
    """
    by = calls.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if("error").alias("errors"), F.sum("tokens").alias("tokens"), F.countDistinct("passport").alias("passports"))
    sizes = calls.where("latency is not null").groupBy("tool", "latency").agg(F.count("*").alias("n"))
    w = Window.partitionBy("tool")
    placed = sizes.withColumns({"upto": F.sum("n").over(w.orderBy("latency")), "all": F.sum("n").over(w)})
    middle = placed.groupBy("tool").agg(F.min(F.when(F.expr("upto > `all` div 2"), F.col("latency"))).alias("p50"))
    reach = offered.groupBy("tool").agg(F.countDistinct("passport").alias("offered_passports"))
    some = offered.limit(1).agg((F.count("*") > 0).alias("some"))
    out = catalog.select("tool", F.lit(True).alias("in_catalog")).distinct().join(by, "tool", "full_outer").join(middle, "tool", "left").join(reach, "tool", "left").crossJoin(F.broadcast(some))
    n = F.coalesce("calls", F.lit(0))
    reached = F.coalesce("offered_passports", F.lit(0))
    kind = F.when(n > 0, "active").when(~F.col("some"), "no_offered_data").when(reached > 0, "offered_never_called").otherwise("never_offered")
    return out.select(
        "tool", F.coalesce("in_catalog", F.lit(False)).alias("in_catalog"), n.alias("calls"), F.coalesce("errors", F.lit(0)).alias("errors"),
        F.coalesce(F.round(F.col("errors") / F.col("calls"), 4), F.lit(0.0)).alias("error_rate"), F.coalesce("passports", F.lit(0)).alias("passports"),
        F.coalesce(F.expr("tokens div calls"), F.lit(0)).alias("avg_tokens"), "p50", reached.alias("offered_passports"), kind.alias("classification"),
    )


def constraint_check(actions: DataFrame, constraints: list[dict]) -> DataFrame:
    """actions(id, text) with hits (constraint ids, sorted) and verdict: block (a critical one hit), warn (a high one), else pass.

    constraints, few and given: id, severity, active and either pattern (a regular expression) or
    terms, of which `least` words must be in the text.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    out = actions.withColumn("words", words)
    hits = []
    for c in (c for c in constraints if c.get("active", True)):
        if c.get("pattern"):
            hit = F.col("text").rlike(c["pattern"])
        else:
            hit = F.size(F.array_intersect("words", F.array(*map(F.lit, c["terms"])))) >= c.get("least", 1)
        hits.append(F.when(hit, F.struct(F.lit(c["id"]).alias("id"), F.lit(c["severity"]).alias("severity"))))
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<struct<id:string,severity:string>>")
    out = out.withColumn("found", found).drop("words")
    has = lambda s: F.exists("found", lambda h: h["severity"] == s)
    return out.select("id", F.array_join(F.array_sort(F.transform("found", lambda h: h["id"])), ",").alias("hits"), F.when(has("critical"), "block").when(has("high"), "warn").otherwise("pass").alias("verdict"))


def reuse_check(capabilities: DataFrame, terms: list[str], least: int, hits: DataFrame, k: int) -> DataFrame:
    """source, id, score: capabilities(id, name) that share `least` terms or more, by their number, then the k best hits(doc_id, score)."""
    words = F.array_distinct(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"))
    near = capabilities.select(F.lit(0).alias("source"), F.col("id").cast("string").alias("id"), F.size(F.array_intersect(words, F.array(*map(F.lit, terms)))).cast("double").alias("score")).where(F.col("score") >= least)
    docs = hits.orderBy(F.desc("score"), "doc_id").limit(k).select(F.lit(1).alias("source"), F.col("doc_id").cast("string").alias("id"), "score")
    return near.union(docs)


def feature_files(features: DataFrame, needle: str) -> DataFrame:
    """feature and file of features(feature, files) whose file holds `needle`, letter case aside."""
    return features.select("feature", F.explode("files").alias("file")).where(F.contains(F.lower("file"), F.lit(needle.lower())))


def classified(plans: DataFrame, keywords: DataFrame, fallback: str, cap: int = 3, weights: tuple[int, int, int] = (3, 2, 1)) -> DataFrame:
    """id, class, score: the class of keywords(class, place, word) that scores most in plans(id, slug, title, body).

    A keyword counts for its field's weight, in the body at most `cap` times; of equal classes the
    first in place stays; without any keyword it is `fallback`.
    """
    words = lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+")
    each = None
    for field, weight in zip(("slug", "title", "body"), weights, strict=True):
        rows = plans.select("id", F.lit(field).alias("field"), F.lit(weight).alias("weight"), F.explode(words(F.col(field))).alias("word")).groupBy("id", "field", "weight", "word").agg(F.count("*").alias("n"))
        each = rows if each is None else each.union(rows)
    met = each.join(keywords, "word").withColumn("points", F.col("weight") * F.when(F.col("field") == "body", F.least("n", F.lit(cap))).otherwise(F.col("n")))
    scores = met.groupBy("id", "class", "place").agg(F.sum("points").alias("score"))
    best = scores.groupBy("id").agg(F.max(F.struct("score", (-F.col("place")).alias("early"), "class")).alias("best"))
    out = plans.select("id").join(best, "id", "left")
    return out.select("id", F.coalesce("best.class", F.lit(fallback)).alias("class"), F.coalesce("best.score", F.lit(0)).alias("score"))


def ephemeral(rows: DataFrame, now: Column, retain: str, least_age: str, keep: int) -> DataFrame:
    """fact_id of bookkeeping facts to collect: old receipts, and session bindings beyond the newest `keep` of a passport that are old enough.

    rows(fact_id, entity, passport, stored_at, deleted); a binding without a passport stays.
    """
    alive = rows.where(~F.col("deleted"))
    receipts = alive.where(F.startswith("entity", F.lit("__reverify_receipts__::")) & (now - F.col("stored_at") > F.expr(f"interval {retain}"))).select("fact_id")
    bindings = alive.where(F.startswith("entity", F.lit("__session_binding__::")) & F.col("passport").isNotNull())
    nth = bindings.withColumn("nth", F.row_number().over(Window.partitionBy("passport").orderBy(F.desc("stored_at"), F.desc("fact_id"))))
    return receipts.union(nth.where((F.col("nth") > keep) & (now - F.col("stored_at") > F.expr(f"interval {least_age}"))).select("fact_id"))


def import_plan(pack: DataFrame, store: DataFrame, receipt: str) -> DataFrame:
    """Each fact of a pack with its action: 'skip' (this pack has delivered it), 'collide' (a live fact has its entity and key) or 'add'.

    pack(fact_id, entity, key, value, deleted), store(entity, key, value, source_receipt, deleted).
    """
    live = store.where(~F.col("deleted"))
    done = live.where(F.col("source_receipt") == receipt).select("entity", "key", "value", F.lit(True).alias("done")).distinct()
    taken = live.select("entity", "key", F.lit(True).alias("taken")).distinct()
    out = pack.where(~F.col("deleted")).join(done, ["entity", "key", "value"], "left").join(taken, ["entity", "key"], "left")
    return out.select("fact_id", F.when(F.col("done"), "skip").when(F.col("taken"), "collide").otherwise("add").alias("action"))


def collection(entity: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The collection of a fact: that of the first prefix that its entity has."""
    out = F.lit(otherwise)
    for prefix, name in reversed(rules):
        out = F.when(F.startswith(entity, F.lit(prefix)), name).otherwise(out)
    return out


def collection_page(rows: DataFrame, name: str, after: tuple | None, size: int) -> DataFrame:
    """A page (1 to 1000 rows) of a collection by (stored_at, fact_id) after a cursor, tombstones with a null value."""
    own = rows.where(F.col("collection") == name).withColumn("value", F.when(~F.col("deleted"), F.col("value")))
    if after is not None:
        at = F.lit(after[0]).cast("timestamp")
        own = own.where((F.col("stored_at") > at) | ((F.col("stored_at") == at) & (F.col("fact_id") > after[1])))
    return own.orderBy("stored_at", "fact_id").limit(min(max(size, 1), 1000))


def manifest(rows: DataFrame) -> DataFrame:
    """collection, facts, tombstones, newest."""
    return rows.groupBy("collection").agg(F.count_if(~F.col("deleted")).alias("facts"), F.count_if("deleted").alias("tombstones"), F.max("stored_at").alias("newest"))


def before(rows: DataFrame, at: str, limit_at: Column, n: int, tie: str) -> DataFrame:
    """The newest n rows older than a time."""
    return rows.where(F.col(at) < limit_at).orderBy(F.desc(at), F.desc(tie)).limit(n)


def page(rows: DataFrame, order: list, offset: int, limit: int) -> tuple[DataFrame, int]:
    """(rows offset+1 to offset+limit in order, the next offset)."""
    return rows.orderBy(*order).offset(offset).limit(limit), offset + limit


def expiring(rows: DataFrame, cutoff: Column, k: int) -> DataFrame:
    """The k (500 at most) oldest rows of before a cutoff."""
    return rows.where(F.col("stored_at") < cutoff).orderBy("stored_at", "fact_id").limit(min(k, 500))


def review_queue(receipts: DataFrame, conflicts: DataFrame) -> DataFrame:
    """kind, subject, at: stored review receipts(subject, at) and live conflicts(subject); the caller sorts receipts newest first."""
    return receipts.select(F.lit("receipt").alias("kind"), "subject", "at").union(conflicts.select(F.lit("contradiction"), "subject", F.lit(None)))


def of_tenant(spans: DataFrame, tenant: str, capture: str) -> DataFrame:
    """Spans of a tenant; rows without one are those of the capture tenant."""
    return spans.where(F.coalesce(F.nullif("tenant_id", F.lit("")), F.lit(capture)) == tenant)


def invalid_fields(rows: DataFrame, schema: list[dict]) -> DataFrame:
    """id and errors (sorted, as text) of rows(id, payload JSON) that break a kind's schema.

    schema: name, type ('string', 'number' or 'boolean'), required, enum.
    """
    shape = {"string": r'^".*"$', "number": r"^-?[0-9.eE+-]+$", "boolean": r"^(true|false)$"}
    errors = []
    for f in schema:
        value = F.try_variant_get(F.try_parse_json("payload"), f"$.{f['name']}", "variant")
        text = F.to_json(value)
        missing = value.isNull() | (text == "null")
        if f.get("required"):
            errors.append(F.when(missing, F.lit(f"{f['name']}:missing")))
        errors.append(F.when(~missing & ~text.rlike(shape[f["type"]]), F.lit(f"{f['name']}:type")))
        if f.get("enum"):
            errors.append(F.when(~missing & ~text.isin(*(f'"{v}"' for v in f["enum"])), F.lit(f"{f['name']}:enum")))
    found = F.array_sort(F.array_compact(F.array(*errors)))
    return rows.select("id", F.array_join(found, ",").alias("errors")).where("errors <> ''")


def patched(events: DataFrame, key: list[str], order: str, fields: list[str]) -> DataFrame:
    """The state of each key after events(mask array of field names, fields): a field is that of the last event that masks it."""
    return events.groupBy(*key).agg(*(F.max_by(F.struct(f), F.when(F.array_contains("mask", f), F.col(order))).alias(f) for f in fields)).select(*key, *(F.col(f"{f}.{f}").alias(f) for f in fields))


def evidence_status(evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """evidence(answer, record_id, text_hash) with status: missing, superseded, current or changed, and the latest fact of its chain.

    facts(fact_id, tenant, entity, key, value, version, deleted). Deleted facts are missing.
    """
    own = facts.where(~F.col("deleted")).select("fact_id", "tenant", "entity", "key", F.sha2(F.col("value").cast("binary"), 256).alias("now_hash"), "version")
    newest = own.groupBy("tenant", "entity", "key").agg(F.max_by("fact_id", F.struct("version", "fact_id")).alias("latest"))
    both = evidence.join(own, evidence["record_id"] == own["fact_id"], "left").join(newest, ["tenant", "entity", "key"], "left")
    status = F.when(F.col("fact_id").isNull(), "missing").when(F.col("latest") != F.col("record_id"), "superseded").when(F.col("text_hash") == F.col("now_hash"), "current").otherwise("changed")
    return both.select("answer", "record_id", status.alias("status"), "latest")


def answer_validity(statuses: DataFrame) -> DataFrame:
    """answer, evidence, valid, drift (sorted categories as text)."""
    drift = F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") != "current", F.concat(F.lit("fact_"), "status")))), ",")
    return statuses.groupBy("answer").agg(F.count("*").alias("evidence"), F.count_if(F.col("status") == "current").alias("current"), drift.alias("drift")).withColumn("valid", F.col("drift") == "")


def sections_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """section and change (added, removed or changed) of old and new(section, digest)."""
    both = old.withColumnRenamed("digest", "a").join(new.withColumnRenamed("digest", "b"), "section", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("section", change.alias("change")).where("change is not null")


LINK = r"\[\[([^\]|#]+)"


def memories(files: DataFrame) -> DataFrame:
    """slug, root, text: of files(root, slug, text) with a slug the first root's."""
    return files.where("slug is not null and slug <> ''").groupBy("slug").agg(F.min_by(F.struct("root", "text"), F.struct("root", "text")).alias("m")).select("slug", "m.root", "m.text")


def memory_links(entries: DataFrame) -> DataFrame:
    """slug, target, dangling: the distinct [[links]] of memories to others; dangling ones have no memory."""
    links = entries.select("slug", F.explode(F.regexp_extract_all("text", F.lit(LINK), F.lit(1))).alias("target")).select("slug", F.trim("target").alias("target")).distinct().where("slug <> target")
    known = entries.select(F.col("slug").alias("target"), F.lit(False).alias("dangling"))
    return links.join(known, "target", "left").select("slug", "target", F.coalesce("dangling", F.lit(True)).alias("dangling"))


def memory_search(entries: DataFrame, terms: list[str], floor: float, k: int) -> DataFrame:
    """slug, score: the share of terms that slug and text hold, at or over the floor; the best k, ties by slug."""
    hay = F.lower(F.concat_ws(" ", "slug", "text"))
    score = sum((F.contains(hay, F.lit(t)).cast("int") for t in terms), F.lit(0)) / len(terms)
    return entries.select("slug", score.alias("score")).where((F.col("score") > 0) & (F.col("score") >= floor)).orderBy(F.desc("score"), "slug").limit(k)


def routed(rows: DataFrame, key: str, ring: list[tuple[int, str]]) -> DataFrame:
    """rows with shard: the owner of the first ring position at or after the key's place, the first one after the last.

    ring, given and sorted: (position, shard). One expression, no join.
    """
    ring = sorted(ring)
    at = F.array(*(F.lit(p) for p, _ in ring))
    place = F.size(F.filter(at, lambda p: p < F.col(key)))
    return rows.withColumn("shard", F.get(F.array(*(F.lit(s) for _, s in ring)), place % len(ring)))


def sampled(rows: DataFrame, key: str, rate: float) -> DataFrame:
    """The rows whose key's SHA-256, as a fraction, is below a rate: the same on every run."""
    return rows.where(F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 12), 16, 10).cast("double") / float(1 << 48) < rate)


def repositories(parts: dict[str, DataFrame]) -> DataFrame:
    """The rows of several repositories, their `path` qualified by the repository's name."""
    out = None
    for name, df in parts.items():
        own = df.withColumn("path", F.concat(F.lit(name + ":"), "path"))
        out = own if out is None else out.unionByName(own)
    return out


def bundles(refs: DataFrame, crates: DataFrame) -> DataFrame:
    """from_crate, to_crate, refs: references(file, to_file, calls) between different crates(file, crate)."""
    a = refs.join(crates.withColumnRenamed("crate", "from_crate"), "file")
    b = a.join(crates.select(F.col("file").alias("to_file"), F.col("crate").alias("to_crate")), "to_file").where("from_crate <> to_crate")
    return b.groupBy("from_crate", "to_crate").agg(F.sum("calls").alias("refs"))


def spatial_map(files: DataFrame) -> DataFrame:
    """crate, loc, files, place, x, y: crates(crate, loc) by size on a square spiral, the largest in the middle; crates are few."""
    by = files.groupBy("crate").agg(F.sum("loc").alias("loc"), F.count("*").alias("files"))
    n = by.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("loc"), "crate")) - 1)
    ring = F.ceil((F.sqrt(F.col("place") + 1) - 1) / 2).cast("int")
    side = F.greatest(2 * ring, F.lit(1))
    step = F.col("place") - (2 * ring - 1) * (2 * ring - 1)
    leg, along = F.floor(step / side).cast("int"), (step % side).cast("int") + 1
    x = F.when(ring == 0, 0).when(leg == 0, ring).when(leg == 1, ring - along).when(leg == 2, -ring).otherwise(-ring + along)
    y = F.when(ring == 0, 0).when(leg == 0, -ring + along).when(leg == 1, ring).when(leg == 2, ring - along).otherwise(-ring)
    return n.select("crate", "loc", "files", F.col("place").cast("int").alias("place"), x.cast("int").alias("x"), y.cast("int").alias("y"))
