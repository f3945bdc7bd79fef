"""The queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import (
    attention_quality,
    bit_mining,
    chat_format,
    license_scan,
    middle_fill,
    minhash_dedup,
    parse_dedup,
    piece_encode,
    quality_rules,
    residual_packing,
    suffix_tree,
    threshold_sketch,
    wrapper_extract,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op2_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = threshold_sketch.fingerprint(_table(spark, sf_dir, "documents"))
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        threshold_sketch.as_text(own).alias("fingerprint"),
        threshold_sketch.as_text(edited).alias("edited_fingerprint"),
        threshold_sketch.likeness(own, edited).alias("near_edited"),
        threshold_sketch.likeness(own, following).alias("near_next"),
        threshold_sketch.containment(own, edited).alias("held_by_edited"),
    )


def op3_piece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encode.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op4_wrapper_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = attention_quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = attention_quality.score(docs, model)
    return scored.select("doc_id", attention_quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("places", lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.link(_table(spark, sf_dir, "documents"))


def op8_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces = residual_packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return residual_packing.pack(pieces, docs.count())


def op9_parse_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = parse_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    added = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("t")).select("conv_id", "t.*")
    return chat_format.read_back(chat_format.prefix_targets(rows.unionByName(added)))


OP10_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), l AS (
  SELECT *, sum(12 + length(replace(replace(replace(r, '\', '\\'), '<|', '<\|'), chr(10), '<\n|')) + 1
    + length(replace(replace(x, '\', '\\'), '<|', '<\|')) + 11) OVER (PARTITION BY conv_id ORDER BY i) AS so_far
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN r = 'assistant' THEN length(x) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN x END, '' ORDER BY i), '')) AS loss_sha256,
  CAST(sum(CASE WHEN r = 'assistant' OR i = n THEN so_far END) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
"""

def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bit_mining.mine(rows.select("vec_id", "embedding", moved.alias("label")))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_fill.digests(_table(spark, sf_dir, "documents"))


#: Cuts by summed lengths of units instead of lists of them.
OP13_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || doc_id) AS h,
    list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]'), lambda w: length(w)) AS sizes
  FROM documents
), d AS (
  SELECT doc_id, x, sizes, len(sizes) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
    CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4
  FROM t
), c AS (
  SELECT *, CAST(coalesce(list_sum(sizes[1:CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT)]), 0) AS BIGINT) AS p,
    CAST(coalesce(list_sum(sizes[1:CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT)]), 0) AS BIGINT) AS q,
    CASE WHEN x = '' OR x LIKE '%<P>%' OR x LIKE '%<S>%' OR x LIKE '%<M>%' OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || substr(x, 1, p) || '<S>' || substr(x, q + 1) || '<M>' || substr(x, p + 1, q - p)
    ELSE '<S>' || substr(x, q + 1) || '<P>' || substr(x, 1, p) || '<M>' || substr(x, p + 1, q - p) END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM c
"""

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_threshold_sketch": op2_threshold_sketch,
    "op3_piece_encode": op3_piece_encode,
    "op4_wrapper_extract": op4_wrapper_extract,
    "op5_attention_quality": op5_attention_quality,
    "op6_license_scan": op6_license_scan,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_residual_packing": op8_residual_packing,
    "op9_parse_dedup": op9_parse_dedup,
    "op10_prefix_targets": op10_prefix_targets,
    "op11_suffix_tree": op11_suffix_tree,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL = {"op10_prefix_targets": OP10_SQL, "op12_hard_negatives": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
