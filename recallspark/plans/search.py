"""Retrieval over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import case_terms, jaccard, redacted, tokens, tokens_sql
from ..operators import retrieval as r
from ..operators.ranked import numbered
from ..sources.steps import kept, new_folder
from ..sources.tables import table

Q, SQL = {}, {}
TERMS = ["the", "ertion", "with", "the"]


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


DOCS = f"docs AS (SELECT doc_id, source AS tenant, doc_id % 50 AS segment, {tokens_sql('text')} AS tokens FROM documents)"
_TF = ", ".join(f"len(list_filter(tokens, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(TERMS))


def bm25_sql(by: str = "") -> str:
    """bm25(doc_id, tenant, segment, doc_len, score, matched) of TERMS; statistics of the whole corpus, or by a column."""
    part = " + ".join(f"CASE WHEN f{i} > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * doc_len / avgdl)) ELSE 0 END" for i in range(len(TERMS)))
    own, join = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    return f"""{DOCS}, tf AS (SELECT doc_id, tenant, segment, len(tokens) AS doc_len, {_TF} FROM docs),
st AS (SELECT {own}count(*) AS n, avg(doc_len) AS avgdl, {", ".join(f"count(*) FILTER (f{i} > 0) AS df{i}" for i in range(len(TERMS)))} FROM tf {"GROUP BY " + by if by else ""}),
bm25 AS (SELECT doc_id, tenant, segment, doc_len, {part} AS score FROM tf JOIN st {join} WHERE {" OR ".join(f"f{i} > 0" for i in range(len(TERMS)))})"""


BM25 = bm25_sql()


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("tenant"), (F.col("doc_id") % 50).alias("segment"))


def index(spark, d):
    return r.build_index(documents(spark, d))


@query("s14_tokenized_documents", f"WITH {DOCS} SELECT doc_id, len(tokens) AS doc_len, md5(array_to_string(tokens, ' ')) AS digest FROM docs")
def _(spark, d):
    own = r.tokenized(table(spark, d, "documents"))
    return own.select("doc_id", "doc_len", F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


@query("j1_postings", f"WITH {DOCS} SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM docs) GROUP BY ALL")
def _(spark, d):
    return r.postings(table(spark, d, "documents"))


@query("a15_corpus_stats", f"WITH {DOCS} SELECT count(*) AS n_docs, sum(len(tokens))::BIGINT AS total_len, round(avg(len(tokens)), 6) AS avgdl FROM docs")
def _(spark, d):
    return r.corpus_stats(index(spark, d).docs).withColumn("avgdl", F.round("avgdl", 6))


@query("r1_bm25_scores", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm25")
def _(spark, d):
    return r.bm25_scores(index(spark, d), TERMS).select("doc_id", F.round("score", 6).alias("score"))


@query("r1_segment_statistics", f"WITH {bm25_sql('segment')} SELECT doc_id, round(score, 6) AS score FROM bm25")
def _(spark, d):
    return r.bm25_scores(index(spark, d), TERMS, per_segment=True).select("doc_id", F.round("score", 6).alias("score"))


@query("j2_written_index", f"WITH {BM25} SELECT doc_id, tenant, doc_len, round(score, 6) AS score FROM bm25")
def _(spark, d):
    own = r.write_index(index(spark, d), new_folder(spark, "index"))
    scores = r.bm25_scores(own, TERMS)
    return scores.join(own.docs.select("doc_id", "tenant"), "doc_id").select("doc_id", "tenant", "doc_len", F.round("score", 6).alias("score"))


@query("p8_tenant_search", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm25 WHERE tenant = 'src1'")
def _(spark, d):
    return r.bm25_scores(index(spark, d), TERMS, tenant="src1").select("doc_id", F.round("score", 6).alias("score"))


def forgotten(spark):
    return spark.sql("SELECT 'src0' AS tenant, 20L AS watermark UNION ALL SELECT 'src3', 40L UNION ALL SELECT 'src3', 10L")


_SEEN = "segment > CASE tenant WHEN 'src0' THEN 20 WHEN 'src3' THEN 40 ELSE -1 END"


@query("j21_erased_search", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm25 WHERE {_SEEN}")
def _(spark, d):
    return r.bm25_scores(index(spark, d), TERMS, forgotten=forgotten(spark)).select("doc_id", F.round("score", 6).alias("score"))


@query("p9_erasure_watermark", f"WITH {DOCS} SELECT tenant AS source, count(*) AS n FROM docs WHERE {_SEEN} GROUP BY 1")
def _(spark, d):
    return r.visible_documents(documents(spark, d), forgotten=forgotten(spark)).groupBy(F.col("tenant").alias("source")).agg(F.count("*").alias("n"))


@query("r2_bm25_search", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm25 WHERE score >= 0.1 ORDER BY bm25.score DESC, segment, doc_id LIMIT 20")
def _(spark, d):
    return r.bm25_search(index(spark, d), TERMS, 20).select("doc_id", F.round("score", 6).alias("score"))


@query("a16_coverage", f"""WITH {BM25} SELECT CAST(4 AS BIGINT) AS query_tokens, CAST(sum(hit) AS BIGINT) AS matched_tokens, sum(hit) / 4 AS coverage, coalesce(string_agg(DISTINCT term, ',' ORDER BY term) FILTER (hit = 0), '') AS missing,
  (SELECT count(*) FROM bm25) AS candidates, (SELECT count(*) FROM bm25 WHERE score < 0.5) AS below_floor
FROM (SELECT t.term, CASE WHEN EXISTS (SELECT 1 FROM docs WHERE list_contains(tokens, t.term)) THEN 1 ELSE 0 END AS hit FROM (SELECT unnest({TERMS!r}) AS term) t)""")
def _(spark, d):
    return r.coverage(index(spark, d), TERMS, 0.5)


_QUERY = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 3)"
_COS = "list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])))"


def one(spark, d):
    """The query vector, a list of numbers."""
    return table(spark, d, "embeddings").where("vec_id = 3").first()["embedding"]


@query("t13_vector_search", f"WITH {_QUERY} SELECT vec_id, round({_COS}, 6) AS cosine FROM embeddings, q ORDER BY {_COS} DESC, vec_id LIMIT 10")
def _(spark, d):
    return r.nearest(table(spark, d, "embeddings"), one(spark, d), 10).withColumn("cosine", F.round("cosine", 6))


@query("t13_filtered_vector_search", f"WITH {_QUERY} SELECT vec_id, round({_COS}, 6) AS cosine FROM embeddings, q WHERE label = 2 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def _(spark, d):
    return r.nearest(table(spark, d, "embeddings").where("label = 2"), one(spark, d), 10).withColumn("cosine", F.round("cosine", 6))


@query("r6_unit_cosine", f"WITH {_QUERY} SELECT vec_id, round(least(greatest({_COS}, 0), 1), 6) AS cosine FROM embeddings, q")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(r.clamped(r.cosine_to(F.col("embedding"), one(spark, d))), 6).alias("cosine"))


_VECTOR = f"v AS (SELECT vec_id, least(greatest({_COS}, 0), 1) AS c FROM embeddings, q)"


@query("r4_fused_rerank", f"""WITH {BM25}, {_QUERY}, pool AS (SELECT * FROM bm25 WHERE score >= 0.1 ORDER BY score DESC, segment, doc_id LIMIT 80), {_VECTOR},
f AS (SELECT doc_id, score, coalesce(c, 0) AS cosine, 0.7 * score / (SELECT max(score) FROM pool) + 0.3 * coalesce(c, 0) AS fused FROM pool LEFT JOIN v ON vec_id = doc_id)
SELECT doc_id, round(score, 6) AS score, round(cosine, 6) AS cosine, round(fused, 6) AS fused FROM f ORDER BY f.fused DESC, doc_id LIMIT 20""")
def _(spark, d):
    pool = r.bm25_search(index(spark, d), TERMS, 80).select("doc_id", "score")
    out = r.fused(pool, table(spark, d, "embeddings"), one(spark, d), 20, 0.7)
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in ("score", "cosine", "fused")))


def _fused(nodes: int) -> str:
    bm25, graph = (0.5, 0.3) if nodes >= 100 else (0.8, 0)
    return f"""WITH {BM25}, {_QUERY}, pool AS (SELECT * FROM bm25 WHERE score > 0 ORDER BY score DESC, segment, doc_id LIMIT 80), {_VECTOR},
f AS (SELECT doc_id, score / (SELECT max(score) FROM pool) AS bm25, CASE WHEN doc_id % 3 = 0 THEN 1.0 / (doc_id % 4 + 1) ELSE 0 END AS graph, coalesce(c, 0) AS dense, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 4 AS INTEGER) ELSE 0 END AS hop FROM pool LEFT JOIN v ON vec_id = doc_id)
SELECT doc_id, round(bm25, 6) AS bm25, round(graph, 6) AS graph, round(dense, 6) AS dense, hop, round({bm25} * bm25 + {graph} * graph + 0.2 * dense, 6) AS score FROM f ORDER BY {bm25} * f.bm25 + {graph} * f.graph + 0.2 * f.dense DESC, doc_id LIMIT 20"""


def _fused_rows(spark, d, nodes):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    hop = (F.col("doc_id") % 4).cast("int")
    near = table(spark, d, "documents").where("doc_id % 3 = 0").select("doc_id", (1.0 / (hop + 1)).alias("boost"), hop.alias("hop"))
    out = r.fused_retrieval(index(spark, d), TERMS, vectors, one(spark, d), near, nodes, 20)
    return out.select("doc_id", "hop", *(F.round(c, 6).alias(c) for c in ("bm25", "graph", "dense", "score")))


@query("r3_fused_retrieval", _fused(1000))
def _(spark, d):
    return _fused_rows(spark, d, 1000)


@query("r3_cold_start", _fused(20))
def _(spark, d):
    return _fused_rows(spark, d, 20)


@query("r5_graph_boost", f"""WITH {BM25}, hits AS (SELECT doc_id, score FROM bm25), m AS (SELECT doc_id, doc_id % 5 + 1 AS overlap, 0.5 + doc_id % 3 / 10 AS confidence FROM documents WHERE doc_id % 4 = 0),
e AS (SELECT doc_id AS src, doc_id + 1 + doc_id % 3 AS dst, 0.2 + doc_id % 7 / 10 AS confidence FROM documents UNION ALL SELECT doc_id, doc_id + 1, 0.9 FROM documents),
top AS (SELECT doc_id FROM hits ORDER BY score DESC, doc_id LIMIT 10),
x AS (SELECT doc_id, max(0.3 * overlap / (SELECT max(overlap) FROM m) * confidence) AS boost FROM m GROUP BY 1), y AS (SELECT dst AS doc_id, max(0.2 * confidence) AS boost FROM e WHERE src IN (SELECT doc_id FROM top) GROUP BY 1)
SELECT h.doc_id, round(score, 6) AS score, round(score + coalesce(x.boost, 0) + coalesce(y.boost, 0), 6) AS boosted FROM hits h LEFT JOIN x ON h.doc_id = x.doc_id LEFT JOIN y ON h.doc_id = y.doc_id""")
def _(spark, d):
    docs = table(spark, d, "documents")
    hits = kept(r.bm25_scores(index(spark, d), TERMS).select("doc_id", "score"), "hits")
    matches = docs.where("doc_id % 4 = 0").selectExpr("doc_id", "doc_id % 5 + 1 AS overlap", "0.5D + doc_id % 3 / 10 AS confidence")
    edges = docs.selectExpr("doc_id AS src", "doc_id + 1 + doc_id % 3 AS dst", "0.2D + doc_id % 7 / 10 AS confidence").union(docs.selectExpr("doc_id", "doc_id + 1", "0.9D"))
    out = r.graph_boosted(hits, matches, edges)
    return out.select("doc_id", F.round("score", 6).alias("score"), F.round("boosted", 6).alias("boosted"))


@query("j8_hydration", f"WITH {BM25}, top AS (SELECT doc_id, score FROM bm25 WHERE score >= 0.1 ORDER BY score DESC, segment, doc_id LIMIT 50) SELECT doc_id, round(score, 6) AS score, md5(text) AS digest FROM top JOIN documents USING (doc_id) WHERE source = 'src1'")
def _(spark, d):
    hits = r.bm25_search(index(spark, d), TERMS, 50).select("doc_id", "score")
    out = r.hydrated(hits, documents(spark, d), "src1")
    return out.select("doc_id", F.round("score", 6).alias("score"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("r11_reciprocal_rank_fusion", """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents)
SELECT doc_id, round(sum(1.0 / (60 + rank)), 6) AS rrf, min(rank) AS best_rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    lists = [numbered(docs, [], -F.col("n_chars"), ["-n_chars", "doc_id"]), numbered(docs, [], F.col("doc_id"), ["doc_id"])]
    return r.reciprocal_rank_fusion(lists, "doc_id").select("doc_id", F.round("rrf", 6).alias("rrf"), "best_rank")


_CASE = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: strlen(x) >= 2))"


@query("t12_case_retrieval", f"""WITH c AS (SELECT conv_id * 1000 + turn AS case_id, {_CASE} AS t, turn % 2 = 0 AS success, (conv_id % 5) / 10 AS reward, turn AS created_at FROM conversations WHERE role = 'user'), q AS (SELECT t AS q FROM c ORDER BY case_id LIMIT 1),
s AS (SELECT case_id, reward, created_at, len(list_intersect(t, q)) / len(list_distinct(t || q)) AS similarity FROM c, q WHERE success AND len(list_intersect(t, q)) > 0)
SELECT case_id, round(similarity, 6) AS similarity FROM s ORDER BY s.similarity DESC, reward DESC, created_at DESC, case_id LIMIT 15""")
def _(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), case_terms(F.col("text")).alias("terms"), (F.col("turn") % 2 == 0).alias("success"), (F.col("conv_id") % 5 / 10).alias("reward"), F.col("turn").alias("created_at"))
    task = c.orderBy("case_id").select("terms").first()["terms"]
    return r.case_retrieval(c, F.array(*map(F.lit, task)), 15, only_success=True).select("case_id", F.round("similarity", 6).alias("similarity"))


@query("a40_case_similarity", f"""WITH {DOCS}, c AS (SELECT conv_id, turn, list_distinct({tokens_sql('text')}) AS t FROM conversations WHERE role = 'user'), q AS (SELECT t AS q FROM c ORDER BY conv_id, turn LIMIT 1)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(t || q)) > 0 THEN len(list_intersect(t, q)) / len(list_distinct(t || q)) ELSE 0 END, 6) AS jaccard FROM c, q""")
def _(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_distinct(tokens(F.col("text"))).alias("t"))
    q = c.orderBy("conv_id", "turn").limit(1).select(F.col("t").alias("q"))
    return c.crossJoin(F.broadcast(q)).select("conv_id", "turn", F.round(jaccard(F.col("t"), F.col("q")), 6).alias("jaccard"))


@query("f_redaction", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(api[_-]?key|token|secret|password|passwd)\s*[=:]\s*\S+', '\1=[REDACTED]', 'g'), '\b(sk-|ghp_|xoxb-|AKIA)[A-Za-z0-9_-]{8,}', '[REDACTED]', 'g'), '\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', '[REDACTED]', 'g')) AS digest FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(redacted(F.col("text")).cast("binary")).alias("digest"))


@query("a17_tenant_footprint", "SELECT doc_id % 50 AS segment, count(*) AS docs, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT source) > 1 AS mixed FROM documents GROUP BY 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy((F.col("doc_id") % 50).alias("segment")).agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes"), (F.countDistinct("source") > 1).alias("mixed"))
