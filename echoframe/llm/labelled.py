"""Training folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled rows a model is fitted on; a parameter of every fit.
MAX_LABELLED = 20_000


def held_out(doc_id: Column) -> Column:
    """Whether a row is outside the training fold; rows without an id are."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, text, y`` of at most ``limit`` labelled rows of the training fold.

    Rows are taken in the order of a hash of the id. Null ids and labels other
    than 0 and 1 are left out, of several labels of an id the largest counts,
    and of several texts of an id the smallest. The broadcast side has at most
    ``limit`` rows of two numbers.
    """
    chosen = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
