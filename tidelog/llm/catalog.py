"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import alignment, chat, decontamination, hamming, language, licenses, mixing, near_dedup, oracles, quality, repeats, secrets, token_counts, vocabularies, whitening
from tidelog.llm.scratch import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{n}") for k, n in enumerate(secrets.NAMES[:3])]
    return found.select("doc_id", *counts, F.sha2(secrets.span_text("base"), 256).alias("base_sha256"), secrets.span_text("spans").alias("spans"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    found = language.identify(docs.select("doc_id", "text"), language.learn(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    firsts = F.transform("base", lambda b: b["first"])
    best = F.expr("array_max(concat(array(0d), transform(base, b -> 0.7d), transform(detections, d -> d.confidence)))")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        licenses.joined("transform(base, b -> b.label)").alias("base_labels"),
        licenses.joined("concat(transform(base, b -> b.label), transform(detections, d -> d.label))").alias("labels"),
        best.alias("score"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row_key")


def op8_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hamming.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabularies.installed(vocabularies.PIECE_BPE), limit=4096)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [vocabularies.installed(name) for name in (vocabularies.BYTE_BPE, vocabularies.PIECE_BPE)]
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), *paths)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_secrets": op2_secrets,
    "op3_mixing": op3_mixing,
    "op4_language": op4_language,
    "op5_repeats": op5_repeats,
    "op6_licenses": op6_licenses,
    "op7_quality": op7_quality,
    "op8_hamming": op8_hamming,
    "op9_chat": op9_chat,
    "op10_decontamination": op10_decontamination,
    "op11_token_counts": op11_token_counts,
    "op12_whitening": op12_whitening,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {
    "op1_near_dedup": oracles.near_dedup(4, 80),
    "op2_secrets": oracles.secret_scan(),
    "op3_mixing": oracles.mixing(mixing.BLOCK, mixing.UNITS),
    "op5_repeats": oracles.repeats(repeats.LENGTH),
    "op6_licenses": oracles.license_scan(),
    "op8_hamming": oracles.hamming(10),
    "op10_decontamination": oracles.decontamination(),
}
