"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, idfile, minhash, packing, quality, sharding, token_counts, toxicity, vectors
from .common import table
from .encoding import vocabulary


def op1_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 0.8)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(len(w) - 4, 1)), lambda p: array_to_string(w[p + 1:p + 5], ' '))) AS s FROM d WHERE len(w) > 0),
its AS (SELECT DISTINCT item_id, unnest(list_transform(range(0, greatest(len(w) - 4, 1)), lambda p: array_to_string(w[p + 1:p + 5], ' '))) AS s FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM its GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS found FROM ds JOIN its USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS item_shingles, found AS found_shingles, found / n AS containment
FROM f JOIN n USING (item_id) WHERE found >= ceil(round(n * 0.8, 6))
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, window=2048)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("""
        SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text
        UNION ALL SELECT -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'""")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(turns)


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS al,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(replace(replace(replace(role, '\', '\s'), '<', '\l'), '[', '\b')) + length(role) - length(replace(role, '>', ''))
      + length(replace(replace(replace(text, '\', '\s'), '<', '\l'), '[', '\b')) + 13) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(al) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


SHARD_BYTES = 1 << 20


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)[0]


#: Prefixes of up to 24 bits: enough while no bucket of that depth is over the limit.
OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
    lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT)), 48, '0') AS bits FROM documents),
l AS (SELECT doc_id, n_bytes, depth, substr(bits, 1, depth) AS shard,
    sum(n_bytes) OVER (PARTITION BY depth, substr(bits, 1, depth)) AS total,
    count(*) OVER (PARTITION BY depth, substr(bits, 1, depth)) AS rows_in
  FROM d, (SELECT CAST(unnest(range(0, 25)) AS INTEGER) AS depth))
SELECT doc_id, n_bytes, shard, depth FROM l WHERE total <= {SHARD_BYTES} OR rows_in = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_token_id_output, op2_quality_classifier, op3_decontamination, op4_packing, op5_chat_formatting, op6_token_counts, op7_sharding, op8_toxicity, op9_embedding_near_dedup, op10_minhash_near_dedup)}


def oracle_sql() -> dict:
    return {"op3_decontamination": OP3_SQL, "op5_chat_formatting": OP5_SQL, "op7_sharding": OP7_SQL}
