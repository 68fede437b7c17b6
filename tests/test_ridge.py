"""The matrix-free ridge against the dense solve."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoframe.functions import text as T
from echoframe.operators import inference as I
from echoframe.operators import ridge as R
from echoframe.operators.positions import DataCheckError


def table(spark, n=300, width=5):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(90)]
    rows = []
    for _ in range(n):
        said = list(rng.choice(words, rng.integers(0, 12)))
        rows.append((" ".join(said + said[:2]), [float(len(said) + len([w for w in said if w < f"w{4 * c}"]) + rng.normal() * 0.1) for c in range(width)]))
    rows += [(None, [1.0] * width), ("w1 w2", None), ("", [0.5] * width)]
    return spark.createDataFrame(rows, "api_explanation string, activation_vector array<double>").repartition(4)


@pytest.mark.parametrize("block", [R.BLOCK_BYTES, 2000])
def test_same_as_the_dense_solve(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK_BYTES", block)  # several blocks of outputs
    monkeypatch.setattr(R, "SUM_FEATURES", 16)
    labelled = table(spark)
    dense = I.fit_ridge(labelled, features=128, d_model=5, penalty=2.0)
    sparse = R.fit_ridge_sparse(labelled, features=128, penalty=2.0)
    assert (sparse.residuals <= 1e-8).all() and sparse.steps > 1
    assert np.allclose(sparse.weights[:-1], dense.weights[sparse.active], atol=1e-5)
    assert np.allclose(sparse.weights[-1], dense.weights[-1], atol=1e-5)
    both = labelled.select(sparse.predict("api_explanation").alias("a"), dense.predict("api_explanation").alias("b")).collect()
    assert all((r["a"] is None) == (r["b"] is None) and (r["a"] is None or np.allclose(r["a"], r["b"], atol=1e-3)) for r in both)


def test_many_features_and_unseen_words(spark):
    labelled = table(spark)
    model = R.fit_ridge_sparse(labelled)
    assert model.features == 1 << 18 and len(model.active) <= 181 and model.weights.shape == (len(model.active) + 1, 5)
    new = spark.createDataFrame([("never met",), ("",), (None,)], "t string").select(model.predict("t").alias("v")).collect()
    assert np.allclose(new[0]["v"], model.weights[-1]) and np.allclose(new[1]["v"], model.weights[-1]) and new[2]["v"] is None


def test_nothing_to_fit(spark):
    with pytest.raises(DataCheckError):
        R.fit_ridge_sparse(table(spark).limit(0))
    mixed = table(spark).union(spark.createDataFrame([("w1", [1.0])], "t string, v array<double>"))
    with pytest.raises(DataCheckError):
        R.fit_ridge_sparse(mixed.filter(F.col("activation_vector").isNotNull()))


def test_words_that_come_together_cost_few_passes(spark, monkeypatch):
    """Frequent words in nested phrases, rare ones beside them: the diagonal alone needs 101 steps here."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):
        depth = int(rng.integers(1, 25))
        said = [f"often{i}" for i in range(depth)] + [f"rare{k}", f"rare{k // 2}x"]
        rows.append((" ".join(said), [float(depth**2) + rng.normal(), float(k % 7) + rng.normal()]))
    labelled = spark.createDataFrame(rows, "api_explanation string, activation_vector array<double>").repartition(3)
    monkeypatch.setattr(R, "AT_ONCE", 500, raising=False)  # rows and their pairs in many slices
    sparse = R.fit_ridge_sparse(labelled, features=1 << 14, penalty=1.0, tolerance=1e-7)
    assert (sparse.residuals <= 2e-7).all() and sparse.steps <= 30
    x = np.zeros((400, len(sparse.active) + 1))
    for i, r in enumerate(labelled.select(I.token_buckets(T.tokenize("api_explanation", None), 1 << 14).alias("b"), F.col("activation_vector").alias("y")).collect()):
        np.add.at(x[i], np.searchsorted(sparse.active, r["b"]), 1.0)
        rows[i] = r["y"]
    x[:, -1], ridge = 1.0, np.eye(x.shape[1])
    ridge[-1, -1] = 0.0
    assert np.allclose(sparse.weights, np.linalg.solve(x.T @ x + ridge, x.T @ np.array(rows)), atol=1e-3)
