"""Inputs of the registered queries, derived from the given tables.

Each derivation exists twice: as a DataFrame and as a SQL common table
expression, by the same closed-form rule. They read whole tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoframe.functions import constants as C
from echoframe.operators.positions import extract_positions
from echoframe.plans.catalog import table
from echoframe.sources.corpus import read_corpus, spread

def vocabulary_path() -> str:
    """Ranked pieces for the lattice tokenizer; ``PIECE_VOCABULARY`` names another file."""
    named = os.environ.get("PIECE_VOCABULARY")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


# ---- corpus and positions -----------------------------------------------------


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as read, for queries that need little more than its keys."""
    return read_corpus(spark, f"{sf_dir}/documents.parquet", "documents", index="doc_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus ready for per-document text work on every core."""
    return spread(documents(spark, sf_dir), "corpus_index")


def positions(spark: SparkSession, sf_dir: str, per_doc: int = C.POSITIONS_PER_DOC) -> DataFrame:
    return extract_positions(corpus(spark, sf_dir), positions_per_doc=per_doc)


SQL_TOKENS = r"""
tokens AS (
  SELECT 'documents:train:' || doc_id AS doc_id,
         (regexp_extract_all(text, '[ \n\t\r]*[^ \n\t\r]+'))[1:2048] AS toks
  FROM documents
)"""


def sql_positions(per_doc: int = C.POSITIONS_PER_DOC, name: str = "positions") -> str:
    return rf"""
{name}_sized AS (
  SELECT doc_id, toks, greatest(len(toks) - 50, 0) AS n,
         least({per_doc}, greatest(len(toks) - 50, 0)) AS k
  FROM tokens
),
{name}_drawn AS (
  SELECT doc_id, toks,
         list_reduce(
           list_transform(range(0, k), lambda i: [i]),
           lambda s, x: list_append(s, CASE
             WHEN list_contains(s, ('0x' || substr(sha256('42|' || doc_id || '|' || x[1]), 1, 15))::BIGINT % (n - k + x[1] + 1))
             THEN n - k + x[1]
             ELSE ('0x' || substr(sha256('42|' || doc_id || '|' || x[1]), 1, 15))::BIGINT % (n - k + x[1] + 1) END),
           []::BIGINT[]) AS picks
  FROM {name}_sized WHERE n > 0
),
{name} AS (
  SELECT doc_id, p + 51 AS n_raw_tokens, array_to_string(toks[1:p + 51], '') AS detokenized_text_truncated
  FROM (SELECT doc_id, toks, unnest(picks) AS p FROM {name}_drawn)
)"""
