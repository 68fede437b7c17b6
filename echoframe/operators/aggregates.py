"""Counts and statistics over positions, splits and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoframe.functions.vectors import l2_norm


def positions_by_document(positions: DataFrame) -> DataFrame:
    """Per document: distinct sorted positions, the largest, and the text there.

    Distinct positions are bounded by the token limit, so a document repeated
    over many rows still gives a small row; both aggregates combine map-side.
    """
    return positions.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("n_raw_tokens")).alias("positions"),
        F.max("n_raw_tokens").alias("max_n_raw_tokens"),
        F.max_by("detokenized_text_truncated", F.struct("n_raw_tokens", "detokenized_text_truncated")).alias("longest_text"),
    )


def split_counts(df: DataFrame, column: str = "split") -> DataFrame:
    """Documents and rows per split, counted per (split, document) first."""
    per_doc = df.groupBy(column, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy(column).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n").cast("bigint").alias("n_rows")
    )


def norm_statistics(vectors: DataFrame, vector: str = "activation_vector") -> DataFrame:
    """Mean, population deviation, range of the norms and the scale to use: a round value near the mean."""
    stats = vectors.select(l2_norm(vector).alias("norm")).agg(
        F.avg("norm").alias("mean_norm"),
        F.stddev_pop("norm").alias("std_norm"),
        F.min("norm").alias("min_norm"),
        F.max("norm").alias("max_norm"),
    )
    scale = F.when(F.col("mean_norm") >= 10, F.bround("mean_norm", -1)).otherwise(F.bround("mean_norm", 1))
    return stats.withColumn("recommended_scale", scale)


def extraction_rate(responses: DataFrame, response: str = "response") -> DataFrame:
    from echoframe.functions.text import has_explanation

    return responses.agg(F.avg(has_explanation(response).cast("double")).alias("extraction_rate"))
