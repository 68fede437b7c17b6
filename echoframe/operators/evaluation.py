"""How well description and reconstruction keep a vector."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoframe.functions import constants as C
from echoframe.functions import text as T
from echoframe.functions.vectors import (
    PYTHON_WIDTH,
    SQRT_D,
    Scale,
    default_injection_scale,
    dot,
    l2_norm,
    normalize,
    normalize_arrow,
    score,
    squared_norm,
)
from echoframe.operators.inference import Codebook, reconstruct_bag, verbalise
from echoframe.operators.joins import join_vectors
from echoframe.operators.positions import DataCheckError
from echoframe.operators.sampling import natural_rank, running_mean, sample_rows

Reconstructor = Callable[[Column], Column]


def _normalized(vector: str, scale: Scale, width: int | None) -> Column:
    if width is not None and width > PYTHON_WIDTH:
        return normalize_arrow(scale)(F.col(vector))
    return normalize(vector, scale)


def mean_vector(vectors: DataFrame, vector: str = "activation_vector", scale: Scale = SQRT_D, width: int | None = None) -> DataFrame:
    """Element-wise mean of the normalised vectors: one pass, combined map-side."""
    return vectors.select(array_to_vector(_normalized(vector, scale, width)).alias("v")).agg(
        vector_to_array(Summarizer.mean(F.col("v"))).alias("mean_vector")
    )


def _baseline_columns(scale: Scale) -> list[Column]:
    """Baselines from the mean vector ``mu`` and the mean squared norm ``sq``.

    mean |v - m|^2 = mean |v|^2 - 2 mu.m + |m|^2, for m = mu and for the
    re-normalised mu: no second pass over the vectors.
    """
    d = F.size("mu").cast("double")
    mu_n = normalize("mu", scale)
    rawvar = (F.col("sq") - squared_norm("mu")) / d
    meannorm = (F.col("sq") - F.lit(2.0) * dot("mu", mu_n) + squared_norm(mu_n)) / d
    return [rawvar.alias("rawvar"), meannorm.alias("meannorm")]


def fve_baselines(vectors: DataFrame, vector: str = "activation_vector", scale: Scale = SQRT_D, width: int | None = None) -> DataFrame:
    """Errors of predicting the mean: ``rawvar`` (as is) and ``meannorm`` (re-normalised)."""
    normed = vectors.select(_normalized(vector, scale, width).alias("n"))
    sums = normed.select(array_to_vector("n").alias("v"), squared_norm("n").alias("q")).agg(
        vector_to_array(Summarizer.mean(F.col("v"))).alias("mu"), F.avg("q").alias("sq"), F.count("q").alias("n_vectors")
    )
    return sums.select("n_vectors", *_baseline_columns(scale))


def fve_report(
    scored: DataFrame,
    pred: str = "pred",
    gold: str = "gold",
    scale: Scale = SQRT_D,
    width: int | None = None,
    baseline_scope: str = "all",
) -> DataFrame:
    """Fraction of variance explained, against both baselines, in one pass.

    Errors are averaged over rows with a prediction. Baselines cover all gold
    rows, or the same rows with ``baseline_scope="valid"``.
    """
    if baseline_scope not in ("all", "valid"):
        raise ValueError("baseline_scope must be all or valid")
    failed_before = None
    if baseline_scope == "valid":
        failed_before = F.lit(scored.filter(F.col(pred).isNull()).count())
        scored = scored.filter(F.col(pred).isNotNull())
    rows = scored.select(_normalized(gold, scale, width).alias("n"), score(pred, gold, scale, width)["mse"].alias("mse"))
    sums = rows.select(array_to_vector("n").alias("v"), squared_norm("n").alias("q"), "mse").agg(
        vector_to_array(Summarizer.mean(F.col("v"))).alias("mu"),
        F.avg("q").alias("sq"),
        F.avg("mse").alias("mse"),
        F.count("mse").alias("n_evaluated"),
        F.count_if(F.col("mse").isNull()).alias("n_failed"),
    )
    based = sums.select(
        "n_evaluated", (failed_before if failed_before is not None else F.col("n_failed")).alias("n_failed"), "mse", *_baseline_columns(scale)
    )
    return based.select(
        "*",
        F.try_divide("mse", "rawvar").alias("r"),
        F.try_divide("mse", "meannorm").alias("m"),
    ).select(
        "n_evaluated", "n_failed", "mse", "rawvar", "meannorm",
        (1 - F.col("r")).alias("fve_nrm"),
        (1 - F.col("m")).alias("fve_nrm_meannorm"),
        (-F.col("mse")).alias("reward_equivalent"),
    )


def check_some_evaluated(report: DataFrame) -> None:
    row = report.first()
    if not row["n_evaluated"]:
        raise DataCheckError(f"all {row['n_failed']} samples failed extraction")


def running_score(scored: DataFrame, index: str = "idx", every: int = 50) -> DataFrame:
    """Mean error so far at every ``every``-th sample, each prediction paired with its own gold row."""
    return running_mean(scored, index, "mse", every).select(index, "n_valid", F.col("running_mean").alias("running_mse"))


def _described(vectors: DataFrame, codebook: Codebook, reconstruct: Reconstructor, vector: str, samples: int = 1) -> DataFrame:
    spoken = verbalise(vectors, codebook, samples, vector)
    return spoken.withColumn("explanation", T.extract_explanation("response")).withColumn(
        "pred", reconstruct(F.col("explanation"))
    )


def roundtrip_eval(
    positions: DataFrame,
    vectors: DataFrame,
    codebook: Codebook,
    reconstruct: Reconstructor | None = None,
    scale: Scale = SQRT_D,
    width: int | None = None,
) -> DataFrame:
    """Vector -> description -> vector per position, with error and cosine; NULL when no description was found.

    ``vectors`` comes from :func:`echoframe.operators.inference.encode`.
    """
    joined = join_vectors(positions, vectors, strict=False, check=False)
    told = _described(joined, codebook, reconstruct or reconstruct_bag, "activation_vector")
    slim = told.select(
        "doc_id",
        "n_raw_tokens",
        T.preview("detokenized_text_truncated").alias("text"),
        (F.col("n_raw_tokens") - 1).alias("position"),
        "explanation",
        F.col("response").alias("raw_output"),
        score("pred", "activation_vector", scale, width).alias("s"),
    )
    return natural_rank(slim, ["doc_id", "n_raw_tokens"], "idx").select(
        "idx", "doc_id", "text", "position", "explanation", "raw_output", "s.mse", "s.cos"
    )


def evaluate_vectors(
    vectors: DataFrame,
    codebook: Codebook,
    keys: Sequence[str],
    samples: int | None = None,
    reconstruct: Reconstructor | None = None,
    vector: str = "activation_vector",
    seed: int = C.SEED,
) -> DataFrame:
    """Per-sample results of a sampled set: keys, explanation, prediction and gold."""
    chosen = vectors if samples is None else sample_rows(vectors, samples, keys, seed)
    told = _described(chosen, codebook, reconstruct or reconstruct_bag, vector)
    return told.select(*keys, "explanation", "pred", F.col(vector).alias("gold"))


def write_results(results: DataFrame, path: str) -> None:
    """Per-sample results as JSON lines; failed samples are not written."""
    results.filter(F.col("explanation").isNotNull()).withColumnRenamed("pred", "ar_vector").write.mode("overwrite").json(path)


def translate(
    vectors: DataFrame,
    codebook: Codebook,
    d_model: int,
    reconstruct: Reconstructor | None = None,
    injection_scale: float | None = None,
    vector: str = "activation_vector",
    critic_template: str = C.CRITIC_TEMPLATE,
) -> DataFrame:
    """Describe every vector and reconstruct it: output text, explanation, vector and its norm."""
    scale = injection_scale if injection_scale is not None else default_injection_scale(d_model)
    scaled = vectors.withColumn("_scaled", normalize(vector, scale))
    spoken = verbalise(scaled, codebook, 1, "_scaled").drop("_scaled", "sample_id")
    told = spoken.withColumnRenamed("response", "actor_output").withColumn(
        "explanation", T.extract_explanation("actor_output")
    )
    prompted = told.withColumn("critic_prompt", T.critic_prompt("explanation", critic_template))
    build = reconstruct or (lambda c: reconstruct_bag(c, d_model))
    return prompted.withColumn("ar_vector", build(F.col("critic_prompt"))).withColumn("ar_vector_norm", l2_norm("ar_vector"))
