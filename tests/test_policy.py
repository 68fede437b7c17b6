import hashlib
import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from echoframe.operators import evaluation as E
from echoframe.operators import inference as I
from echoframe.operators import injection as N
from echoframe.operators import policy as P
from echoframe.operators.positions import DataCheckError
from echoframe.session import new_table_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # test classes travel with the task


def test_failed_extraction_takes_the_floor(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), ([2.0, 0.0], [1.0, 0.0])], "pred array<double>, gold array<double>")
    assert [r["reward"] for r in P.add_rewards(df).collect()] == [-2.0, pytest.approx(0.0)]
    assert P.critic_loss(df).first()["n_valid"] == 1


def test_advantages(spark):
    df = spark.createDataFrame([(1, -1.0), (1, -1.0), (2, -1.0), (2, -0.5), (2, 0.0)], "prompt_id int, reward double")
    rows = P.add_advantages(df).collect()
    assert [r["advantage"] for r in rows if r["prompt_id"] == 1] == [0.0, 0.0]
    second = sorted(r["advantage"] for r in rows if r["prompt_id"] == 2)
    assert second == pytest.approx([-1.0, 0.0, 1.0]) and sum(second) == pytest.approx(0)


def test_single_sample_groups_are_an_error(spark):
    df = spark.createDataFrame([(1, -1.0)], "prompt_id int, reward double")
    with pytest.raises(Exception, match="at least two samples"):
        P.add_advantages(df).collect()


def test_one_group_with_a_third_of_all_rows(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 1000).alias("prompt_id"), (F.col("id") % 17 / 10.0).alias("reward")
    )
    out = P.add_advantages(df).groupBy("prompt_id").agg(F.count("*").alias("n"), F.sum("advantage").alias("s"))
    assert out.agg(F.sum("n")).first()[0] == 6000
    assert out.filter("abs(s) > 1e-6").count() == 0


def test_kl_forms(spark):
    df = spark.createDataFrame([(1, 0, 1, -1.0, -2.0), (1, 1, 1, -3.0, -1.0)], "seq_id int, pos int, prompt_len int, logp double, ref_logp double")
    assert P.sequence_terms(df, "per_token").first()["kl_penalty"] == pytest.approx(2.5)
    assert P.sequence_terms(df, "per_seq").first()["kl_penalty"] == pytest.approx(1.0)
    assert P.sequence_terms(df, response_only=True).first()["seq_logp"] == -3.0
    with pytest.raises(ValueError):
        P.sequence_terms(df, "none")


def test_equal_shards_with_an_empty_one(spark):
    df = spark.createDataFrame([(0, i) for i in range(5)] + [(1, i) for i in range(2)], "s int, k int")
    assert sorted(tuple(r) for r in P.equal_shards(df, "s", 2, ["k"]).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert P.equal_shards(df, "s", 3, ["k"]).count() == 0


def test_cross_entropy_modes(spark):
    rng = np.random.default_rng(1)
    logits, labels, mask = rng.normal(size=(2, 4, 3)), [[-100, -100, 2, 1], [-100, 0, 1, 2]], [[0, 0, 1, 1], [0, 1, 1, 0]]
    rows = [(s, p, logits[s, p].tolist(), labels[s][p], float(mask[s][p])) for s in range(2) for p in range(4)]
    df = spark.createDataFrame(rows, "seq_id int, pos int, logits array<double>, label int, mask double")
    ce, used, masked, weight = [], [], 0.0, 0
    for s in range(2):
        for p in range(3):
            target = labels[s][p + 1]
            lse = np.log(np.exp(logits[s, p]).sum())
            value = 0.0 if target == -100 else lse - logits[s, p, target]
            ce.append(value)
            used += [] if target == -100 else [value]
            masked += value * mask[s][p + 1]
            weight += mask[s][p + 1]
    assert P.cross_entropy(df).first()["loss"] == pytest.approx(masked / weight)
    assert P.cross_entropy(df.drop("mask")).first()["loss"] == pytest.approx(np.mean(ce))
    assert P.cross_entropy(df.drop("mask"), ignore_masked=True).first()["loss"] == pytest.approx(np.mean(used))


IDS = {0: [9, 1, 5, 2, 5], 1: [5, 2, 1, 5, 2], 2: [1, 5, 3, 1, 5, 2]}


def tokens(spark):
    rows = [(s, p, t, [float(t), float(p)]) for s, ids in IDS.items() for p, t in enumerate(ids)]
    return spark.createDataFrame(rows, "seq_id int, pos int, token_id int, embedding array<double>")


def test_marker_sites_need_both_neighbours_and_no_edge(spark):
    want = [(0, 2), (1, 3), (2, 4)]
    assert sorted(tuple(r) for r in N.marker_sites(tokens(spark), 5, 1, 2).collect()) == want
    arrays = spark.createDataFrame([(s, ids) for s, ids in IDS.items()], "seq_id int, ids array<int>")
    got = arrays.select("seq_id", F.explode(N.sites_in_array("ids", 5, 1, 2)).alias("pos")).collect()
    assert sorted(tuple(r) for r in got) == want


def test_injection_order_and_count(spark):
    vectors = spark.createDataFrame([(i, [100.0 + i, 0.0]) for i in range(3)], "vec_idx bigint, vector array<double>")
    out = {(r["seq_id"], r["pos"]): r["embedding"] for r in N.inject_vectors(tokens(spark), vectors, 5, 1, 2).collect()}
    assert len(out) == 16
    assert [out[k][0] for k in [(0, 2), (1, 3), (2, 4)]] == [100.0, 101.0, 102.0]
    assert out[(0, 4)] == [5.0, 4.0]
    with pytest.raises(DataCheckError):
        N.inject_vectors(tokens(spark), vectors.limit(2), 5, 1, 2)


# ---- evaluation -----------------------------------------------------------------------


def unit(m, scale):
    return m / (np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) / scale)


@pytest.mark.parametrize("scope", ["all", "valid"])
def test_fve_against_numpy(spark, scope):
    rng = np.random.default_rng(2)
    gold, pred = rng.normal(1, 1, size=(40, 6)), rng.normal(1, 1, size=(40, 6))
    missing = np.arange(40) % 5 == 0
    rows = [(g.tolist(), None if m else p.tolist()) for g, p, m in zip(gold, pred, missing)]
    df = spark.createDataFrame(rows, "gold array<double>, pred array<double>")
    scale = np.sqrt(6)
    g, p = unit(gold, scale), unit(pred, scale)
    mse = ((g - p)[~missing] ** 2).mean()
    base = g if scope == "all" else g[~missing]
    mu = base.mean(axis=0, keepdims=True)
    rawvar, meannorm = ((base - mu) ** 2).mean(), ((base - unit(mu, scale)) ** 2).mean()
    row = E.fve_report(df, baseline_scope=scope).first()
    assert (row["n_evaluated"], row["n_failed"]) == (32, 8)
    assert row["mse"] == pytest.approx(mse) and row["rawvar"] == pytest.approx(rawvar) and row["meannorm"] == pytest.approx(meannorm)
    assert row["fve_nrm"] == pytest.approx(1 - mse / rawvar) and row["fve_nrm_meannorm"] == pytest.approx(1 - mse / meannorm)
    wide = E.fve_report(df, width=1000, baseline_scope=scope).first()
    assert wide["fve_nrm"] == pytest.approx(row["fve_nrm"])


def test_all_failed_is_an_error(spark):
    df = spark.createDataFrame([([1.0, 0.0], None)] * 3, "gold array<double>, pred array<double>")
    with pytest.raises(DataCheckError, match="all 3 samples"):
        E.check_some_evaluated(E.fve_report(df))


def test_predicting_the_mean_explains_nothing(spark):
    rng = np.random.default_rng(3)
    g = unit(rng.normal(2, 1, size=(50, 4)), 2.0)
    mu = g.mean(axis=0)
    df = spark.createDataFrame([(x.tolist(), mu.tolist()) for x in g], "gold array<double>, pred array<double>")
    assert E.fve_report(df).first()["fve_nrm_meannorm"] == pytest.approx(0, abs=1e-9)


def test_ridge_matches_numpy_on_the_same_features(spark):
    words = ["red", "green", "blue", "dark"]
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(words, size=5)) for _ in range(60)]
    y = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(t, v.tolist()) for t, v in zip(texts, y)], "api_explanation string, activation_vector array<double>")
    model = I.fit_ridge(df.repartition(7), features=16, d_model=3, penalty=0.5)
    x = np.zeros((60, 17))
    x[:, -1] = 1
    for i, t in enumerate(texts):
        for token in re.findall(r"[ \n\t\r]*[^ \n\t\r]+", t):
            x[i, int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 16] += 1
    penalty = 0.5 * np.eye(17)
    penalty[-1, -1] = 0
    want = np.linalg.solve(x.T @ x + penalty + 1e-9 * np.eye(17), x.T @ y)
    assert np.allclose(model.weights, want, atol=1e-6)
    out = df.select(model.predict("api_explanation").alias("p")).collect()
    assert np.allclose([r["p"] for r in out], x @ want, atol=1e-5)


def test_verbalise_is_nearest_anchor_and_null_explanations_give_null_scores(spark):
    labelled = spark.createDataFrame([(i, [float(i == j) for j in range(3)], f"axis {i}\n\nx") for i in range(3)], "k int, activation_vector array<double>, api_explanation string")
    book = I.fit_codebook(labelled, ["k"], size=10)
    assert len(book.texts) == 3
    vectors = spark.createDataFrame([(0, [0.1, 5.0, 0.2]), (1, [3.0, 0.0, 2.0]), (2, None)], "id int, activation_vector array<double>")
    out = I.verbalise(vectors, book, 2).orderBy("id", "sample_id").collect()
    assert [(r["id"], r["response"].split("\n")[1]) for r in out] == [(0, "axis 1"), (0, "axis 2"), (1, "axis 0"), (1, "axis 2")]
    told = E.translate(vectors.filter("id < 2"), book, 3).collect()
    assert {r["explanation"] for r in told} == {"axis 1\n\nx", "axis 0\n\nx"}
    assert all(r["ar_vector_norm"] == pytest.approx(np.linalg.norm(r["ar_vector"])) for r in told)
    with pytest.raises(ValueError):
        I.verbalise(vectors, book, 4)


def test_write_results_leaves_failed_samples_out(spark):
    df = spark.createDataFrame([(1, "e", [1.0]), (2, None, None)], "idx int, explanation string, pred array<double>")
    path = new_table_path(spark, "test-results")
    E.write_results(df, path)
    assert [r["idx"] for r in spark.read.json(path).collect()] == [1]


def test_encoder_plugin_and_clamp(spark):
    class Length(I.Encoder):
        def encode(self, texts, positions):
            return [(p, np.array([[len(t), n] for n in p], dtype=float)) for t, p in zip(texts, positions)]

    rows = spark.createDataFrame([("d", 1, "a"), ("d", 3, "a b c")], "doc_id string, n_raw_tokens bigint, detokenized_text_truncated string")
    got = {r["n_raw_tokens"]: r["activation_vector"] for r in I.encode(rows, encoder=Length()).collect()}
    assert got == {1: [5.0, 1.0], 3: [5.0, 3.0]}
    assert I.encode(rows, 8, max_length=2).count() == 1
    assert I.encode(rows, 8, max_length=2, clamp=True).count() == 2
    report = I.encode_report(rows, 2).first()
    assert (report["n_written"], report["n_skipped"]) == (1, 1)
