import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echoframe.functions import vectors as V
from echoframe.operators.positions import DataCheckError
from echoframe.sources.sidecar import check_vector_width


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "a array<double>, b array<double>")


def test_known_scores(spark):
    rows = frame(spark, [([1.0, 0.0], [3.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 0.0], [-1.0, 0.0])])
    got = [(r["s"]["mse"], r["s"]["cos"]) for r in rows.select(V.score("a", "b").alias("s")).collect()]
    assert got == [pytest.approx((0, 1)), pytest.approx((2, 0)), pytest.approx((4, -1))]


def test_zero_vector_stays_zero(spark):
    row = frame(spark, [([0.0, 0.0], [1.0, 1.0])]).select(
        V.normalize("a", 8).alias("n"), V.normalize_arrow(8)("a").alias("m")
    ).first()
    assert row["n"] == [0.0, 0.0] and row["m"] == [0.0, 0.0]


def test_null_vectors_give_null(spark):
    rows = frame(spark, [(None, [1.0, 1.0]), ([1.0, 2.0], None), ([1.0, 2.0], [2.0, 1.0])])
    both = rows.select(
        V.score("a", "b").alias("s"), V.score_arrow()("a", "b").alias("p"), V.normalize("a").alias("n"), V.normalize_arrow()("a").alias("m")
    ).collect()
    assert [r["s"]["mse"] is None for r in both] == [True, True, False]
    assert [r["s"]["cos"] is None for r in both] == [True, True, False]
    assert [r["p"]["mse"] is None for r in both] == [True, True, False]
    assert both[0]["n"] is None and both[0]["m"] is None
    assert both[1]["n"] == pytest.approx(both[1]["m"])


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.tuples(*[st.lists(st.floats(-5, 5, allow_nan=False, width=32), min_size=4, max_size=4)] * 2),
        min_size=1,
        max_size=6,
    )
)
def test_mse_is_twice_one_minus_cos(spark, pairs):
    pairs = [p for p in pairs if np.linalg.norm(p[0]) > 1e-3 and np.linalg.norm(p[1]) > 1e-3]
    if not pairs:
        return
    rows = frame(spark, pairs).select("a", "b", V.score("a", "b").alias("s"), V.score_arrow()("a", "b").alias("p")).collect()
    for r in rows:
        a, b = np.array(r["a"]), np.array(r["b"])
        cos = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
        assert r["s"]["cos"] == pytest.approx(cos, abs=1e-9)
        assert r["s"]["mse"] == pytest.approx(2 * (1 - cos), abs=1e-9)
        assert r["p"]["mse"] == pytest.approx(r["s"]["mse"], abs=1e-9)
        assert r["p"]["cos"] == pytest.approx(r["s"]["cos"], abs=1e-9)


def test_scale_settings():
    assert V.scale_for(None, 16) is None and V.scale_for("raw", 16) is None and V.scale_for("none", 4) is None
    assert V.scale_for("sqrt_d_model", 16) == 4.0 and V.scale_for("2.5", 16) == 2.5
    assert V.default_injection_scale(16) == 10.0


def test_wide_vectors_take_the_arrow_form(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(3, 300)), rng.normal(size=(3, 300))
    rows = frame(spark, [(x.tolist(), y.tolist()) for x, y in zip(a, b)])
    got = rows.select(V.score("a", "b", width=300).alias("w"), V.score("a", "b").alias("n")).collect()
    for r in got:
        assert r["w"]["mse"] == pytest.approx(r["n"]["mse"])


def test_token_logprob_is_log_softmax(spark):
    logits = [1.0, 1000.0, 999.0]
    got = spark.createDataFrame([(logits,)], "l array<double>").select(V.token_logprob("l", F.lit(2)).alias("r")).first()["r"]
    assert got == pytest.approx(-1 - math.log1p(math.exp(-1)))


def test_last_valid(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1, 1, 0]), ([1.0], [0])], "v array<double>, m array<int>")
    assert [r[0] for r in df.select(V.value_at_last_valid("v", "m")).collect()] == [2.0, None]


def test_width_check(spark):
    good = spark.createDataFrame([([1.0, 2.0],)], "activation_vector array<float>")
    assert check_vector_width(good) == (1, 2)
    with pytest.raises(DataCheckError):
        check_vector_width(good, expected=3)
    with pytest.raises(DataCheckError):
        check_vector_width(good.union(spark.createDataFrame([([1.0],)], "activation_vector array<float>")))
