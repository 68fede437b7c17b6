"""Marker sites in token sequences and vector injection at them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoframe.operators.positions import DataCheckError
from echoframe.operators.sampling import natural_rank


def marker_sites(tokens: DataFrame, marker: int, left: int, right: int) -> DataFrame:
    """``seq_id, pos`` where the marker stands between its two neighbours.

    One scan that keeps only marker and neighbour tokens. Each votes for the
    site it would belong to, and a site needs all three votes; votes of one
    place combine map-side and no sequence is gathered. A first or last position
    lacks a neighbour and never wins.
    """
    here = F.col("pos").cast("bigint")
    votes = F.array(
        F.when(F.col("token_id") == marker, F.struct(here.alias("site"), F.lit(1).alias("vote"))),
        F.when(F.col("token_id") == left, F.struct((here + 1).alias("site"), F.lit(2).alias("vote"))),
        F.when(F.col("token_id") == right, F.struct((here - 1).alias("site"), F.lit(4).alias("vote"))),
    )
    return (
        tokens.filter(F.col("token_id").isin(marker, left, right))
        .select("seq_id", F.explode(F.array_compact(votes)).alias("v"))
        .groupBy("seq_id", F.col("v.site").alias("pos"))
        .agg(F.bit_or("v.vote").alias("votes"))
        .filter("votes = 7")
        .select("seq_id", "pos")
    )


def sites_in_array(ids: Column | str, marker: int, left: int, right: int) -> Column:
    """The same for one sequence held as an array: 0-based site positions, no shuffle."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    inner = F.when(F.size(ids) > 2, F.sequence(F.lit(1), F.size(ids) - 2)).otherwise(F.array().cast("array<int>"))
    return F.filter(
        inner,
        lambda p: (F.get(ids, p) == marker) & (F.get(ids, p - 1) == left) & (F.get(ids, p + 1) == right),
    )


def inject_vectors(
    tokens: DataFrame, vectors: DataFrame, marker: int, left: int, right: int, check: bool = True
) -> DataFrame:
    """Replace the embedding at the i-th site, in (seq_id, pos) order, by vector i.

    ``tokens``: ``seq_id, pos, token_id, embedding``; ``vectors``: ``vec_idx``
    (0-based, dense) and ``vector``. Sites and vectors must be equally many.
    """
    sites = marker_sites(tokens, marker, left, right)
    if check:
        n_sites = sites.count()
        seen = vectors.agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("vec_idx").alias("ids"), F.min("vec_idx").alias("low"), F.max("vec_idx").alias("high")
        ).first()
        if n_sites != seen["n"]:
            raise DataCheckError(f"found {n_sites} sites with the right neighbours, expected {seen['n']}")
        if seen["n"] and (seen["ids"], seen["low"], seen["high"]) != (seen["n"], 0, seen["n"] - 1):
            raise DataCheckError(f"vec_idx must be 0 to {seen['n'] - 1}, each once; got {seen['ids']} values from {seen['low']} to {seen['high']}")
    numbered = natural_rank(sites, ["seq_id", "pos"], "vec_idx")
    placed = numbered.join(vectors.select("vec_idx", "vector"), "vec_idx").select("seq_id", "pos", "vector")
    return tokens.join(placed, ["seq_id", "pos"], "left").select(
        "seq_id",
        "pos",
        "token_id",
        F.coalesce("vector", "embedding").alias("embedding"),
        F.col("vector").isNotNull().alias("injected"),
    )
