"""Position extraction: corpus -> sampled token positions with their prefix text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoframe.functions import constants as C
from echoframe.functions import text as T
from echoframe.operators.sampling import DataCheckError, sample_positions  # noqa: F401

Tokenizer = Callable[[Column], Column]


def with_tokens(
    corpus: DataFrame,
    text: str = "text",
    max_length: int | None = C.MAX_LENGTH,
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """Add ``tokens``, all of them without a ``max_length``. A plug-in tokenizer is a column function from text to ``array<string>``."""
    if tokenizer is None:
        tokens = T.tokenize(text, max_length)
    else:
        tokens = tokenizer(F.col(text)) if max_length is None else F.slice(tokenizer(F.col(text)), 1, max_length)
    return corpus.withColumn("tokens", tokens)


def count_token(tokenized: DataFrame, token: str) -> DataFrame:
    """Documents seen and documents that contain ``token``."""
    return tokenized.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.array_contains("tokens", token)).alias("n_with_token"),
    )


def check_token_absent(tokenized: DataFrame, token: str) -> None:
    found = count_token(tokenized, token).first()["n_with_token"]
    if found:
        raise DataCheckError(f"pad token {token!r} found in {found} documents")


def extract_positions(
    corpus: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    positions_per_doc: int = C.POSITIONS_PER_DOC,
    seed: int = C.SEED,
    min_position: int = C.MIN_POSITION,
    max_length: int = C.MAX_LENGTH,
    specials: Sequence[str] = (),
    pad_token: str | None = None,
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """Positions table ``doc_id, n_raw_tokens, detokenized_text_truncated``.

    One narrow pass: a document is a row, so sampling and prefix building happen
    where the document is read. Prefixes are built for sampled positions only,
    before the explode, so tokens are never copied per position.
    """
    docs = with_tokens(corpus.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")),
                       "text", max_length, tokenizer)
    if pad_token is not None:
        check_token_absent(docs, pad_token)

    def sampled(toks: Column) -> Column:
        picks = sample_positions(toks, "doc_id", positions_per_doc, seed, min_position, specials)
        return T.prefixes(toks, picks, specials)

    rows = docs.select("doc_id", F.explode(T.let(F.col("tokens"), sampled)).alias("r"))
    return rows.select("doc_id", "r.n_raw_tokens", "r.detokenized_text_truncated")


def sampling_report(
    corpus: DataFrame,
    text: str = "text",
    positions_per_doc: int = C.POSITIONS_PER_DOC,
    min_position: int = C.MIN_POSITION,
    max_length: int = C.MAX_LENGTH,
    specials: Sequence[str] = (),
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """Counters of a sampling run: rows, documents, skipped and short-sampled documents."""
    docs = with_tokens(corpus.select(F.col(text).alias("text")), "text", max_length, tokenizer)
    counted = docs.select(F.size(T.candidate_positions("tokens", min_position, specials)).alias("n"))
    k = F.lit(positions_per_doc)
    return counted.agg(
        F.coalesce(F.sum(F.least("n", k)), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col("n") == 0).alias("n_skipped"),
        F.count_if((F.col("n") > 0) & (F.col("n") < k)).alias("n_short"),
    )
