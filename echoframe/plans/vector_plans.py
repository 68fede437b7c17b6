"""Registered queries: vector functions and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoframe.functions import vectors as V
from echoframe.operators import aggregates as A
from echoframe.operators import evaluation as E
from echoframe.plans import inputs
from echoframe.plans.catalog import query, table, with_ctes
from echoframe.sources.sidecar import vector_width

# a, b: each vector and its successor (cyclic); na, nb their norms
SQL_PAIRS = """
pairs AS (
  SELECT x.vec_id, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b
  FROM embeddings x JOIN embeddings y ON y.vec_id = (x.vec_id + 1) % (SELECT count(*) FROM embeddings)
),
normed AS (
  SELECT *, sqrt(list_sum(list_transform(a, lambda x: x * x))) AS na, sqrt(list_sum(list_transform(b, lambda x: x * x))) AS nb
  FROM pairs
),
unit AS (
  SELECT vec_id, a, b, na, nb, list_transform(a, lambda x: x / (na / 8.0)) AS ua, list_transform(b, lambda x: x / (nb / 8.0)) AS ub
  FROM normed
)"""
SQL_MU = """
elements AS (SELECT vec_id, i, ua[i] AS x FROM unit, range(1, 65) t(i)),
mu AS (SELECT i, avg(x) AS m FROM elements GROUP BY i),
mu_norm AS (SELECT sqrt(sum(m * m)) AS nm FROM mu),
base AS (
  SELECT avg((x - m) * (x - m)) AS rawvar, avg((x - m / (nm / 8.0)) * (x - m / (nm / 8.0))) AS meannorm
  FROM elements JOIN mu USING (i), mu_norm
)"""


def pairs(spark, sf):
    emb = table(spark, sf, "embeddings")
    n = emb.count()
    left = emb.select("vec_id", F.col("embedding").alias("a"), ((F.col("vec_id") + 1) % n).alias("other"))
    right = emb.select(F.col("vec_id").alias("other"), F.col("embedding").alias("b"))
    return left.join(right, "other").drop("other")


def r6(column):
    return F.round(column, 6)


@query("v1_l2_norm", with_ctes(SQL_PAIRS, select="SELECT vec_id, round(na, 6) AS norm FROM normed"))
def v1(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r6(V.l2_norm("embedding")).alias("norm"))


@query("v2_normalize", with_ctes(SQL_PAIRS, select="""
    SELECT vec_id, round(ua[1], 6) AS first_value, round(list_sum(ua), 6) AS total, round(list_sum(a), 6) AS raw_total,
           round(ua[64] * 2.5, 6) AS last_injected FROM unit"""))
def v2(spark, sf):
    emb = table(spark, sf, "embeddings")
    return emb.select(
        "vec_id",
        V.normalize("embedding").alias("u"),
        V.normalize("embedding", "raw").alias("w"),
        V.normalize("embedding", V.default_injection_scale(64)).alias("s"),
    ).select(
        "vec_id",
        r6(F.get("u", F.lit(0))).alias("first_value"),
        r6(F.aggregate("u", F.lit(0.0), lambda acc, x: acc + x)).alias("total"),
        r6(F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x)).alias("raw_total"),
        r6(F.get("s", F.lit(63))).alias("last_injected"),
    )


@query("v4_mse", with_ctes(SQL_PAIRS, select="""
    SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (ua[i] - ub[i]) * (ua[i] - ub[i]))) / 64, 6) AS mse,
           round(list_sum(list_transform(range(1, 65), lambda i: (a[i] - b[i]) * (a[i] - b[i]))) / 64, 6) AS raw_mse FROM unit"""))
def v4(spark, sf):
    return pairs(spark, sf).select("vec_id", r6(V.mse("a", "b")).alias("mse"), r6(V.mse("a", "b", "raw")).alias("raw_mse"))


@query("v5_cosine", with_ctes(SQL_PAIRS, select="""
    SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i])) / (na * nb), 6) AS cos FROM unit"""))
def v5(spark, sf):
    return pairs(spark, sf).select("vec_id", r6(V.cosine("a", "b")).alias("cos"))


SQL_SCORE = with_ctes(SQL_PAIRS, select="""
    SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (ua[i] - ub[i]) * (ua[i] - ub[i]))) / 64, 6) AS mse,
           round(list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i])) / (na * nb), 6) AS cos FROM unit""")


@query("v6_score", SQL_SCORE)
def v6(spark, sf):
    scored = pairs(spark, sf).select("vec_id", V.score("a", "b").alias("s"))
    return scored.select("vec_id", r6("s.mse").alias("mse"), r6("s.cos").alias("cos"))


@query("v6_score_numpy", SQL_SCORE)
def v6_numpy(spark, sf):
    """The Arrow form of the same score, for wide vectors."""
    scored = pairs(spark, sf).select("vec_id", V.score_arrow()(F.col("a"), F.col("b")).alias("s"))
    return scored.select("vec_id", r6("s.mse").alias("mse"), r6("s.cos").alias("cos"))


@query("v7_vector_width", """
    SELECT count(*) AS n_rows, min(len(embedding)) AS min_width, max(len(embedding)) AS max_width FROM embeddings""")
def v7(spark, sf):
    return vector_width(table(spark, sf, "embeddings"), "embedding")


@query("v8_last_valid", """
    SELECT vec_id, CASE WHEN vec_id % 65 > 0 THEN embedding[vec_id % 65] END AS last_value FROM embeddings""")
def v8(spark, sf):
    """Mask with vec_id % 65 leading ones."""
    emb = table(spark, sf, "embeddings")
    mask = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i <= F.col("vec_id") % 65).cast("int"))
    return emb.select("vec_id", V.value_at_last_valid("embedding", mask).alias("last_value"))


@query("a3_norm_statistics", with_ctes(SQL_PAIRS, select="""
    SELECT round(avg(na), 6) AS mean_norm, round(stddev_pop(na), 6) AS std_norm, round(min(na), 6) AS min_norm,
           round(max(na), 6) AS max_norm,
           round(CASE WHEN avg(na) >= 10 THEN round_even(avg(na), -1) ELSE round_even(avg(na), 1) END, 6) AS recommended_scale
    FROM normed"""))
def a3(spark, sf):
    stats = A.norm_statistics(table(spark, sf, "embeddings"), "embedding")
    return stats.select(*[r6(c).alias(c) for c in stats.columns])


@query("a7_mean_vector", with_ctes(SQL_PAIRS, SQL_MU, select="SELECT i::BIGINT AS element, round(m, 6) AS value FROM mu"))
def a7(spark, sf):
    mean = E.mean_vector(table(spark, sf, "embeddings"), "embedding")
    return mean.select(F.posexplode("mean_vector").alias("i", "m")).select(
        (F.col("i") + 1).cast("bigint").alias("element"), r6("m").alias("value")
    )


@query("a8_fve_baselines", with_ctes(SQL_PAIRS, SQL_MU, select="""
    SELECT (SELECT count(*) FROM embeddings) AS n_vectors, round(rawvar, 6) AS rawvar, round(meannorm, 6) AS meannorm FROM base"""))
def a8(spark, sf):
    base = E.fve_baselines(table(spark, sf, "embeddings"), "embedding")
    return base.select("n_vectors", r6("rawvar").alias("rawvar"), r6("meannorm").alias("meannorm"))
