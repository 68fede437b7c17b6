"""Registered queries: scans, tokens and position extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoframe.functions import text as T
from echoframe.operators import positions as P
from echoframe.plans import inputs
from echoframe.plans.catalog import query, table, with_ctes
from echoframe.session import new_table_path
from echoframe.sources.corpus import first_rows, read_corpus


@query("s1_read_corpus", """
    SELECT 'documents:train:' || doc_id AS doc_id, doc_id AS corpus_index, sha256(text) AS text_sha256
    FROM documents WHERE doc_id >= 100""")
def s1(spark, sf):
    """A corpus window by index; the bound reaches the parquet scan."""
    rows = read_corpus(spark, f"{sf}/documents.parquet", "documents", start=100, index="doc_id")
    return rows.select("doc_id", "corpus_index", T.text_key("text").alias("text_sha256"))


@query("s1_read_corpus_file_order", """
    SELECT 'documents:train:' || doc_id AS doc_id, doc_id AS corpus_index, sha256(text) AS text_sha256
    FROM documents""")
def s1_file_order(spark, sf):
    """The same without an id column: index from file order."""
    rows = read_corpus(spark, f"{sf}/documents.parquet", "documents")
    return rows.select("doc_id", "corpus_index", T.text_key("text").alias("text_sha256"))


@query("s1_window_of_files", """
    SELECT 'documents:train:' || doc_id AS doc_id, doc_id AS corpus_index, sha256(text) AS text_sha256
    FROM documents WHERE doc_id >= (SELECT count(*) // 3 FROM documents) AND doc_id < (SELECT 2 * (count(*) // 3) FROM documents)""")
def s1_window(spark, sf):
    """A window by file order, of a copy of the corpus in many files; only those that it touches are opened."""
    docs = table(spark, sf, "documents")
    path = new_table_path(spark, "corpus-files")
    docs.repartitionByRange(12, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    third = docs.count() // 3
    rows = read_corpus(spark, path, "documents", start=third, length=third)
    return rows.select("doc_id", "corpus_index", T.text_key("text").alias("text_sha256"))


@query("s3_column_pruned_scan", "SELECT doc_id FROM documents")
def s3(spark, sf):
    return table(spark, sf, "documents").select("doc_id")


@query("s4_first_rows", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def s4(spark, sf):
    """The feature is a first-n slice, made deterministic by key order."""
    return first_rows(table(spark, sf, "documents").select("doc_id", "n_chars"), ["doc_id"], 100)


@query("t1_tokenize", with_ctes(inputs.SQL_TOKENS, select="""
    SELECT doc_id, len(toks) AS n_tokens, sha256(array_to_string(toks, '|')) AS tokens_sha256 FROM tokens"""))
def t1(spark, sf):
    docs = P.with_tokens(inputs.corpus(spark, sf))
    return docs.select(
        "doc_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("tokens", "|"), 256).alias("tokens_sha256"),
    )


@query("t2_candidate_positions", with_ctes(inputs.SQL_TOKENS, select="""
    SELECT doc_id, len(c) AS n_candidates, list_min(c) AS first_position, list_max(c) AS last_position
    FROM (SELECT doc_id, list_filter(range(50, len(toks)), lambda i: toks[i + 1] NOT IN (' la', ' the', ' de')) AS c
          FROM tokens)"""))
def t2(spark, sf):
    docs = P.with_tokens(inputs.corpus(spark, sf))
    cand = T.candidate_positions("tokens", specials=[" la", " the", " de"])
    return docs.select("doc_id", cand.alias("c")).select(
        "doc_id",
        F.size("c").cast("bigint").alias("n_candidates"),
        F.array_min("c").alias("first_position"),
        F.array_max("c").alias("last_position"),
    )


@query("t3_prefix_text", with_ctes(inputs.SQL_TOKENS, select="""
    SELECT doc_id, (len(toks) + 1) // 2 AS n_raw_tokens,
           array_to_string(list_filter(toks[1:(len(toks) + 1) // 2], lambda t: t NOT IN (' la', ' the')), '') AS prefix
    FROM tokens"""))
def t3(spark, sf):
    """Text up to the middle token of each document, without specials."""
    docs = P.with_tokens(inputs.corpus(spark, sf)).select("doc_id", "tokens", F.expr("(size(tokens) + 1) div 2").alias("n_raw_tokens"))
    return docs.select("doc_id", "n_raw_tokens", T.prefix_text("tokens", F.col("n_raw_tokens") - 1, [" la", " the"]).alias("prefix"))


@query("t4_pad_token_check", with_ctes(inputs.SQL_TOKENS, select="""
    SELECT count(*) AS n_docs, count(*) FILTER (list_contains(toks, ' <pad>')) AS n_with_token FROM tokens"""))
def t4(spark, sf):
    return P.count_token(P.with_tokens(inputs.corpus(spark, sf)), " <pad>")


@query("l1_extract_positions", with_ctes(inputs.SQL_TOKENS, inputs.sql_positions(), select="""
    SELECT doc_id, n_raw_tokens, detokenized_text_truncated FROM positions"""))
def l1(spark, sf):
    return inputs.positions(spark, sf)


@query("r1_sample_positions", with_ctes(inputs.SQL_TOKENS, inputs.sql_positions(5), select="""
    SELECT doc_id, n_raw_tokens FROM positions"""))
def r1(spark, sf):
    return inputs.positions(spark, sf, 5).select("doc_id", "n_raw_tokens")


@query("a4_sampling_counters", with_ctes(inputs.SQL_TOKENS, select="""
    SELECT sum(least(10, greatest(len(toks) - 50, 0)))::BIGINT AS n_rows, count(*) AS n_docs,
           count(*) FILTER (len(toks) <= 50) AS n_skipped,
           count(*) FILTER (len(toks) > 50 AND len(toks) < 60) AS n_short
    FROM tokens"""))
def a4(spark, sf):
    return P.sampling_report(inputs.corpus(spark, sf))
