"""Key joins between positions, explanations, vectors and rollouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoframe.operators.labelling import KEYS
from echoframe.operators.marks import may_match, sketch
from echoframe.operators.positions import DataCheckError


def key_report(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``n_missing`` (left only), ``n_extra`` (right only) and repeated keys per side.

    Both key lists are counted in one aggregation; only keys are shuffled.
    """
    tagged = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = tagged.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return per_key.agg(
        F.count_if((F.col("l") > 0) & (F.col("r") == 0)).alias("n_missing"),
        F.count_if((F.col("l") == 0) & (F.col("r") > 0)).alias("n_extra"),
        F.count_if(F.col("l") > 1).alias("n_repeated_left"),
        F.count_if(F.col("r") > 1).alias("n_repeated_right"),
    )


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The differing keys themselves, with the ``side`` that has them; one aggregation over the keys of both, each side read once."""
    sides = left.select(*keys, F.lit("missing").alias("side")).unionByName(right.select(*keys, F.lit("extra").alias("side")))
    per_key = sides.groupBy(*keys).agg(F.min("side").alias("side"), F.max("side").alias("other"))
    return per_key.filter(F.col("side") == F.col("other")).select(*keys, "side")


def check_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS, strict: bool = True) -> dict[str, int]:
    """Raise on repeated keys and, when strict, on keys one side lacks; return the counts."""
    row = key_report(left, right, keys).first().asDict()
    if row["n_repeated_left"] or row["n_repeated_right"]:
        raise DataCheckError(f"keys {tuple(keys)} repeat: {row}")
    if strict and (row["n_missing"] or row["n_extra"]):
        raise DataCheckError(f"{row['n_missing']} rows missing from the right side, {row['n_extra']} extra there")
    return row


def join_vectors(explained: DataFrame, vectors: DataFrame, strict: bool = True, check: bool = True) -> DataFrame:
    """Explained rows with their vector, matched by key.

    The check reads the keys of both sides before the join does: store inputs
    that are costly to make. Sides that are bucketed by key (``sources.bucketed``) are not shuffled.
    """
    if check:
        check_keys(explained, vectors, strict=strict)
    return explained.join(vectors, list(KEYS), "inner")


def keep_documents(rows: DataFrame, documents: DataFrame, key: str = "doc_id", sketched: bool = False) -> DataFrame:
    """Rows whose document is in the set.

    With ``sketched`` a sketch of the set goes ahead of the join, so that of
    wide rows only those are shuffled that will hardly be dropped. It reads the
    documents twice; give it a stored table.
    """
    chosen = documents.select(key).distinct()
    if sketched:
        rows = may_match(rows, sketch(documents, [key]), [key])
    return rows.join(chosen, key, "left_semi")


def split_vectors(vectors: DataFrame, explained_splits: DataFrame, split: str, sketched: bool = False) -> DataFrame:
    """Vectors of the documents one explained split holds."""
    return keep_documents(vectors, explained_splits.filter(F.col("split") == split), sketched=sketched)


def fan_out(prompts: DataFrame, samples: int) -> DataFrame:
    """Each prompt ``samples`` times, numbered in ``sample_id``; no shuffle."""
    if samples < 1:
        raise ValueError("samples must be positive")
    return prompts.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))


def attach_parent(rollouts: DataFrame, prompts: DataFrame, key: str = "prompt_id") -> DataFrame:
    return rollouts.join(prompts, key)
