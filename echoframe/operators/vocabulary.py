"""Corpus vocabulary and its fingerprint: do two tables share a tokenizer?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoframe.operators.positions import DataCheckError
from echoframe.operators.sampling import natural_rank
from echoframe.sources.sidecar import read_json, write_json

TEXT = "detokenized_text_truncated"
META_FINGERPRINT = "tokenizer_fingerprint"
META_NAME = "tokenizer_name"


def vocabulary(tokenized: DataFrame) -> DataFrame:
    """``token, n, token_id``: tokens with counts and dense ids in token order.

    Counting combines map-side, so a token that makes up much of the corpus
    travels once per task.
    """
    counts = tokenized.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return natural_rank(counts, ["token"], "token_id")


def vocabulary_fingerprint(vocab: DataFrame, specials: tuple[str, ...] = ()) -> DataFrame:
    """One-row fingerprint of the vocabulary and the special tokens.

    A hash tree instead of one long string: tokens are hashed into 4096 groups,
    each group is hashed over its sorted members, and the root over the groups.
    No step holds more than its share, and equal vocabularies give equal roots.
    """
    leaf = vocab.select(F.sha2("token", 256).alias("h"))
    fine = leaf.groupBy(F.substring("h", 1, 6).alias("g")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h")
    )
    coarse = fine.groupBy(F.substring("g", 1, 3).alias("g3")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda s: s["h"]), ""), 256).alias("h")
    )
    root = coarse.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g3", "h"))), lambda s: s["h"]), "").alias("all")
    )
    return root.select(F.sha2(F.concat_ws("|", "all", F.lit(",".join(sorted(specials)))), 256).alias("fingerprint"))


def check_fingerprint(spark: SparkSession, meta_path: str, fingerprint: str, name: str = "") -> bool:
    """Compare with the stored fingerprint; record it on the first run.

    Returns True when the state was new. A different one is an error.
    """
    meta = read_json(spark, meta_path)
    stored = meta.get(META_FINGERPRINT)
    if stored is None:
        write_json(spark, meta_path, {**meta, META_FINGERPRINT: fingerprint, META_NAME: name})
        return True
    if stored != fingerprint:
        raise DataCheckError(
            f"tokenizer fingerprint mismatch: stored for {meta.get(META_NAME, 'unknown')!r}, current {name!r}"
        )
    return False


def tag_fingerprint(positions: DataFrame, fingerprint: str, name: str = "") -> DataFrame:
    """Record the tokenizer on the prefix column; the tag survives parquet and every later join."""
    return positions.withMetadata(TEXT, {META_FINGERPRINT: fingerprint, META_NAME: name})


def table_fingerprint(df: DataFrame) -> dict:
    """The tag of a positions or explained table, empty when there is none."""
    return dict(df.schema[TEXT].metadata)


def require_fingerprint(meta: dict, fingerprint: str) -> bool:
    """True when a table's metadata carries this fingerprint; missing metadata is an error."""
    stored = meta.get(META_FINGERPRINT)
    if not stored:
        raise DataCheckError("the table has no tokenizer fingerprint")
    return stored == fingerprint
