"""One query per operator over its whole table, with the parameters of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneloom.llm import decontaminate, exact, html_text, language, merkle, near, packing, quality, search, sharding, spans, sql, tokens, urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def teaches_language(docs: DataFrame) -> DataFrame:
    """The documents that language profiles may learn from."""
    return docs.where(~language.held_out())


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, teaches_language(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.without_repeats(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_links(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = quality.fit(docs.where(~quality.held_out()), table(spark, sf_dir, "labels").where(~quality.held_out()))
    return quality.score(docs, chain).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number its path ends with: bad if of low quality or toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.regexp_extract(urls.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+|/)?$", 1)
    numbered = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id is not null").distinct()
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urls.judge(pages, numbered.join(bad, "doc_id").select("url", "bad"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_language_id, op2_substring_dedup, op3_token_counts, op4_decontamination, op5_html_text, op6_exact_dedup, op7_jaccard_join, op8_quality, op9_packing, op10_url_filter,
    op11_merkle_manifest, op12_sharding, op13_ranked_search)}

SQL = {
    "op2_substring_dedup": sql.SPANS, "op4_decontamination": sql.DECONTAMINATION, "op6_exact_dedup": sql.EXACT, "op7_jaccard_join": sql.NEAR, "op11_merkle_manifest": sql.MERKLE,
    "op12_sharding": sql.SHARDING, "op13_ranked_search": sql.SEARCH,
}
