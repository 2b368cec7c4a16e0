"""The operators as named queries over the given tables, with SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import chat, decontam, html, langid, line_dedup, mixing, near_dups, pii, quality, spans
from sluice.llm import bursts, kernel, vafile
from sluice.llm.common import table

Run = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    lines = F.coalesce(ends + 1, F.lit(0))
    narrow = docs.select("doc_id", F.xxhash64("text").alias("h"),
                         lines.cast("bigint").alias("n_lines"))
    found, name = line_dedup.annotate(docs, narrow, F.col("h"))
    return found.select("doc_id", "n_lines",
                        F.size(name).cast("bigint").alias("n_removed"),
                        F.array_join(F.col(name), ",").alias("removed_lines"))


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    planned, name = mixing.plan_copies(table(spark, folder, "documents").select(
        "doc_id", "text", "source"))
    return planned.select(
        "doc_id", F.col(name["size"]).alias("size"),
        F.col(name["source_size"]).alias("source_size"), F.col(name["target"]).alias("target"),
        (F.col(name["copies"]) * F.col(name["size"])).alias("taken"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs)
    return docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"),
                       langid.predict(F.col("text"), model).alias("p")).select(
        "doc_id", "held_out", "p.*")


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii.find(F.col("text"), pii.train(docs)).alias("f"))
    base, added = F.col("f.base"), F.col("f.added")
    counts = [pii.count_of(base, k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(pii.as_text(base).cast("binary"), 256).alias("base_sha256"),
        pii.as_text(F.concat(base, added)).alias("spans"),
        F.size(added).cast("bigint").alias("n_added"))


def op5_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")

    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(spans.sentences(t)) for t in texts], dtype="int64")

    narrow = docs.select("doc_id", F.xxhash64("text").alias("h"),
                         F.pandas_udf(count, "bigint")("text").alias("n_sentences"))
    found, name = spans.annotate(docs, narrow, F.col("h"))
    return found.select("doc_id", "n_sentences", F.size(name).cast("bigint").alias("n_removed"),
                        F.array_join(F.col(name), ",").alias("removed_sentences"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", quality.verdict(F.col("text")).alias("v")).select("doc_id", "v.*")


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found, name = decontam.find_hits(docs, table(spark, folder, "benchmark"))
    hits = F.col(name)
    # Text cast to binary keeps code point order when ids are sorted.
    return found.select(
        "doc_id", hits["n_words"].alias("n_words"),
        F.size(hits["hit"]).cast("bigint").alias("n_hit"),
        F.size(hits["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(hits["items"]), ",").cast("binary"), 256)
        .alias("items_sha256"),
        decontam.contaminated(hits).alias("contaminated"))


def op8_format_chats(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  turns.schema)
    return chat.digests(chat.windows(turns.unionByName(extra)))


def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return (pages.select("page_id", "url", html.extract(F.col("html")).alias("text"))
            .withColumn("n_chars", F.length("text").cast("bigint")))


def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    # Only the place of a text is needed once the classes are known.
    narrow = docs.select("doc_id", F.xxhash64("text").alias("h"))
    found = near_dups.classes(docs).select(
        F.col("doc").alias("_d"), F.col("h").alias("_h"), F.col("class_doc").alias("class_id"),
        F.lit(True).alias("_in"))
    joined = narrow.join(found, F.col("doc_id").eqNullSafe(F.col("_d"))
                         & (F.col("h") == F.col("_h")), "left")
    return joined.select("doc_id", F.when(F.col("_in"), F.col("class_id"))
                         .otherwise(F.col("doc_id")).alias("class_id"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return bursts.nodes(table(spark, folder, "conversations"))


def op12_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    measured = kernel.measure(table(spark, folder, "documents"))
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return kernel.scored(measured, kernel.fit(measured, labels))


def op13_cluster_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vafile.cluster(table(spark, folder, "embeddings"))


QUERIES: dict[str, Run] = {f.__name__: f for f in (
    op1_line_dedup, op2_mix_sources, op3_language_id, op4_personal_data, op5_sentence_spans,
    op6_quality_rules, op7_decontaminate, op8_format_chats, op9_main_text,
    op10_near_duplicates, op11_prefix_trie, op12_quality_scores, op13_cluster_vectors)}
