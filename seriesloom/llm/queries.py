"""Registered queries of the operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination, find_benchmark_spans
from .html import extract_main_text
from .language import detect_languages
from .merkle import fold, manifest_with_audit, path_digest
from .minhash import near_duplicates
from .mixing import mix_sources
from .oracles import TOPK, VARIANTS, merkle_sql
from .pairwise_quality import score_quality
from .passages import shared_passages
from .quality_rules import weak_quality
from .sharding import shard_rows
from .tool_calls import format_chat
from .topk import nearest
from .variants import spelling_variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(find_benchmark_spans(documents, _table(spark, sf_dir, "benchmark")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


#: The tools that ``with_calls`` puts into conversations.
TOOLS = {
    "lookup": {
        "type": "object",
        "required": ["query", "limit"],
        "properties": {
            "query": {"type": "string", "minLength": 1},
            "limit": {"type": "integer", "minimum": 1, "maximum": 6},
            "after": {"type": "string"},
        },
        "additionalProperties": False,
    }
}


def with_calls(conversations: DataFrame) -> DataFrame:
    """The conversations, with a call in every assistant turn and a result for most calls.

    The table holds no tool calls, so Spark derives them: the query is the text's
    first 20 characters, the limit its length modulo 7 (0 breaks the schema), every
    turn from 4 on refers to the call at half its turn if that was an assistant's, and
    turns divisible by 11 get no result.
    """
    call_id = F.concat(F.lit("call_"), F.col("turn").cast("string"))
    half = F.floor(F.col("turn") / 2).cast("long")
    arguments = F.struct(
        F.substring("text", 1, 20).alias("query"),
        (F.length("text") % 7).alias("limit"),
        F.when(F.col("turn") >= 4, F.struct(F.concat(F.lit("call_"), half.cast("string")).alias("$ref"))).alias("after"),
    )
    call = F.to_json(F.struct(call_id.alias("id"), F.lit("lookup").alias("name"), arguments.alias("arguments")))
    spoken = F.when(
        F.col("role") == "assistant", F.concat(F.coalesce("text", F.lit("")), F.lit("\n<tool_call>"), call, F.lit("</tool_call>"))
    ).otherwise(F.col("text"))
    result = F.to_json(F.struct(call_id.alias("tool_call_id"), F.struct(F.length("text").alias("n_chars")).alias("content")))
    asked = conversations.select("conv_id", "turn", "role", spoken.alias("text"))
    answers = conversations.where((F.col("role") == "assistant") & (F.col("turn") % 11 != 0)).select(
        "conv_id", "turn", F.lit("tool").alias("role"), result.alias("text")
    )
    return asked.unionByName(answers)


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(with_calls(_table(spark, sf_dir, "conversations")), TOOLS)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = detect_languages(documents, documents.where(~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "langs", "shares")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = weak_quality(_table(spark, sf_dir, "documents"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return scored.select(*base, "base_failed", "kept")


def op9_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(_table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    audit = manifest_with_audit(documents, F.when(altered, lowered))
    folded = audit.select(
        "doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"),
        fold(F.col("audited"), F.col("path")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_mixing": op3_mixing,
    "op4_html": op4_html,
    "op5_sharding": op5_sharding,
    "op6_tool_calls": op6_tool_calls,
    "op7_language": op7_language,
    "op8_quality_rules": op8_quality_rules,
    "op9_pairwise_quality": op9_pairwise_quality,
    "op10_passages": op10_passages,
    "op11_merkle": op11_merkle,
    "op12_topk": op12_topk,
    "op13_variants": op13_variants,
}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op11_merkle": merkle_sql(),
    "op12_topk": TOPK,
    "op13_variants": VARIANTS,
    "op2_decontaminate": rf"""
WITH b AS (
    SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark WHERE text IS NOT NULL
), bw AS (
    SELECT item_id, least(len(w), 13) AS n,
           unnest([array_to_string(w[i:i + least(len(w), 13) - 1], ' ')
                   FOR i IN range(1, len(w) - least(len(w), 13) + 2)]) AS win
    FROM b WHERE len(w) > 0
), d AS (
    SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_WORD}'), []) AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
    SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i,
           unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS win
    FROM d, sizes WHERE len(w) >= n
), hit AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw USING (n, win)
), spots AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items,
           string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
    FROM hit GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN found USING (doc_id)
""",
}
