"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import chat_format, jaccard_join, language_id, license_scan, media, mixing, packing, pii, quality_rules, secret_scan, spans, spelling, token_counts, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"select * from values (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    out = chat_format.read_back(chat_format.format_chats(rows.unionByName(own)))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("trained", "")
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length(trained).cast("bigint").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    # a row without an id is held out: nothing is learned from it
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    model = language_id.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return language_id.predict_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), capacity=2048).withColumn("piece", F.col("piece").cast("int"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(_documents(spark, sf_dir))
    base = F.lit(quality_rules.mask("base")).cast("bigint")
    return quality_rules.apply_policy(rows, "v1").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed").bitwiseAND(base) != 0).alias("base_failed"), "kept", F.col("failed").alias("failed_bits"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.find_spans(_documents(spark, sf_dir), pii.finder)
    counts = [spans.count("spans", k).alias(f"n_{k}") for k in pii.BASE]
    top = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score")
    return found.select("doc_id", *counts, F.sha2(spans.told("spans", pii.BASE, by_start=False), 256).alias("base_sha256"), spans.told("spans", pii.KINDS, by_start=False).alias("spans"), top)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix, plan = mixing.mix_sources(_documents(spark, sf_dir), weights=(5, 2, 1), share=1.0, most=3.0)
    taken = mix.groupBy("s", "begin").agg(F.sum("words").alias("taken"))
    return plan.join(taken, ["s", "begin"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.read_streams(media.text_streams(_documents(spark, sf_dir)))
    # time stamp, bytes and random access point of each elementary packet
    said = F.transform("units", lambda u: F.concat_ws(":", F.coalesce(u["pts"].cast("string"), F.lit("-")), u["bytes"], u["random_access"].cast("int")))
    return found.withColumn("units", F.array_join(said, ","))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_documents(spark, sf_dir), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.find_spans(_documents(spark, sf_dir), secret_scan.finder)
    counts = [spans.count("spans", k).alias(f"n_{k}") for k in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(spans.told("spans", secret_scan.BASE, by_start=True), 256).alias("base_sha256"), spans.told("spans", secret_scan.KINDS, by_start=True).alias("spans"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(_documents(spark, sf_dir))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])

    def labels(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    score = F.coalesce(F.array_max(F.transform("places", lambda p: p["weight"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        score.alias("score"),
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=4)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_language_id, op3_best_fit_packing, op4_quality_rules, op5_pii, op6_mixing, op7_media_columns, op8_token_counts, op9_ngram_jaccard_join, op10_secret_scan, op11_license_scan, op12_embedding_whitening, op13_spelling_variants)}
