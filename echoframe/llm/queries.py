"""Registered queries of the thirteen operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoframe.llm import (
    bpe,
    decontamination,
    embedding_dedup,
    hard_negatives,
    html_extract,
    license_scan,
    merkle,
    ngram_join,
    quality,
    sharding,
    stream_dedup,
    toxicity,
    url_filter,
)
from echoframe.session import configure, new_table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file; ``BPE_TOKENIZER`` names another one."""
    named = os.environ.get("BPE_TOKENIZER")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn_lexicon(docs, table(spark, sf_dir, "labels")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), new_table_path(spark, "slot-map"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.deduplicate(configure(spark), f"{sf_dir}/documents.parquet", new_table_path(spark, "dedup-state"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda text: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    claim = F.when(tampered, leaf(lower)).otherwise(leaf(F.col("text")))
    return merkle.manifest_proofs(table(spark, sf_dir, "documents"), claim=claim)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


def url_filter_sql(rules: tuple = RULES, default: str = "allow") -> str:
    """DuckDB SQL for the rules, longest first."""
    cut = "regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1)"
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    fits = lambda r: f"(h = '{r.host}' OR ends_with(h, '.{r.host}')) AND starts_with(p, '{r.path}')"
    names = " ".join(f"WHEN {fits(rules[i])} THEN '{rules[i].name}'" for i in ranked)
    verdicts = " ".join(f"WHEN {fits(rules[i])} THEN '{rules[i].verdict}'" for i in ranked)
    return f"""
    WITH rest AS (SELECT page_id, {cut} AS r FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(r, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
      regexp_extract(substr(r, length(regexp_extract(r, '(?s)^[^/?#]*')) + 1), '(?s)^[^?#]*') AS p FROM rest)
    SELECT page_id, h AS host, p AS path, CASE {names} END AS rule, CASE {verdicts} ELSE '{default}' END AS verdict FROM parts
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_bpe, op3_toxicity, op4_embedding_dedup, op5_html_extract, op6_ngram_join, op7_quality, op8_sharding, op9_url_filter,
        op10_decontamination, op11_stream_dedup, op12_merkle, op13_hard_negatives,
    )
}

ORACLES = {
    "op1_license_scan": license_scan.scan_sql(),
    "op9_url_filter": url_filter_sql(),
    "op11_stream_dedup": stream_dedup.DEDUP_SQL,
    "op12_merkle": merkle.proofs_sql(),
    "op13_hard_negatives": hard_negatives.MINE_SQL,
}
