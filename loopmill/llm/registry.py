"""One thin query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopmill.llm import chat, collocations, decontaminate, langid, line_dedup, lm_score, media, near_dedup, packing, pii, token_counts, warc, whitening
from loopmill.llm.common import crc_bucket, materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_width", "media_height", "bit_depth", "colour_type")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 3) == 1
    model = langid.fit(docs, ~held_out)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat.rotate(table(spark, sf_dir, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws("+", m["start"], m["length"])), ",")
    return views.select("conv_id", "speaker", "chunk", "turns", "own_turns", F.sha2("rendered", 256).alias("rendered_sha256"), F.length("rendered").cast("long").alias("rendered_chars"), masks.alias("masks"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "starts_doc", "ends_doc")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_bucket("doc_id", 7) == 2
    return lm_score.score(table(spark, sf_dir, "documents"), ~held_out, held_out)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars_left"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def token_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each context limit from 128 to 1,048,576 tokens: documents that are longer, and tokens left when all are cut there."""
    sums = token_counts.suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents")))
    limits = spark.range(7, 21).select(F.pow(F.lit(2.0), "id").cast("long").alias("context_limit"))
    return token_counts.answer_limits(materialize(sums), limits)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.span_words("spans")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "component", "n", whitening.deviation_long().alias("deviation"), "whitened", "explained", "identity_error")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_media,
    op2_langid,
    op3_warc,
    op4_chat,
    op5_packing,
    op6_lm_score,
    op7_near_dedup,
    op8_line_dedup,
    op9_token_counts,
    op10_decontaminate,
    op11_pii,
    op12_whitening,
    op13_collocations,
    token_limits,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from loopmill.llm import oracles

    return oracles.ORACLES
