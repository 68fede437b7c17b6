import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from echoframe.operators import sampling as S
from echoframe.operators.positions import DataCheckError, check_token_absent, extract_positions, with_tokens


def docs(spark, n, copies=1):
    return spark.range(n * copies).select(F.concat(F.lit("d"), F.col("id") % n).alias("doc_id"))


def order(keys, seed=42):
    return sorted(keys, key=lambda k: hashlib.sha256(f"{seed}|{k}".encode()).hexdigest())


def test_split_counts_and_disjointness(spark):
    split = S.split_documents(docs(spark, 10, copies=3))
    per_doc = split.groupBy("doc_id").agg(F.countDistinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert all(r["n"] == 1 for r in per_doc)
    assert Counter(r["s"] for r in per_doc) == {"av_sft": 2, "ar_sft": 2, "rl": 6}


def test_split_matches_hash_order(spark):
    got = {r["doc_id"]: r["split"] for r in S.split_documents(docs(spark, 103)).collect()}
    ranked = order(got)
    assert [got[d] for d in ranked] == ["av_sft"] * 25 + ["ar_sft"] * 25 + ["rl"] * 53


@pytest.mark.parametrize("fractions", [(-0.1, 0.6, 0.5), (0.3, 0.3, 0.3)])
def test_bad_fractions(spark, fractions):
    with pytest.raises(ValueError):
        S.split_documents(docs(spark, 4), fractions)


@pytest.mark.parametrize("settle", [1, 3, 2048])
def test_cuts_are_exact_at_every_depth(spark, monkeypatch, settle):
    monkeypatch.setattr(S, "SETTLE_ROWS", settle)
    monkeypatch.setattr(S, "PREFIX_DIGITS", 1)
    hashes = docs(spark, 500).select(S.seeded_hash(1, "doc_id").alias("h"))
    everything = sorted(r["h"] for r in hashes.collect())
    n, cuts = S.hash_cuts(hashes, lambda total: [0, 1, 7, total // 2, total - 1, total, total + 5])
    assert n == 500
    assert [sum(h < c for h in everything) for c in cuts] == [0, 1, 7, 250, 499, 500, 500]


def test_samples_do_not_depend_on_partitioning(spark, sf):
    corpus = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    results = []
    for parts in (1, 4, 17):
        spread = corpus.repartition(parts)
        rows = extract_positions(spread)
        kept = S.sample_documents(rows, 30)
        ranked = S.seeded_rank(spread.select("doc_id"), ["doc_id"])
        natural = S.natural_rank(spread.select("doc_id"), ["doc_id"])
        results.append(
            (
                sorted((r["doc_id"], r["n_raw_tokens"]) for r in kept.select("doc_id", "n_raw_tokens").collect()),
                sorted(tuple(r) for r in ranked.collect()),
                sorted(tuple(r) for r in natural.collect()),
            )
        )
    assert results[0] == results[1] == results[2]


def test_positions_are_distinct_in_range_and_capped(spark, sf):
    rows = extract_positions(spark.read.parquet(f"{sf}/documents.parquet"), positions_per_doc=7, min_position=20)
    per_doc = rows.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.countDistinct("n_raw_tokens").alias("d"), F.min("n_raw_tokens").alias("low")
    )
    assert per_doc.filter("n <> d OR low < 21 OR n > 7").count() == 0


def test_short_documents_keep_every_candidate(spark):
    corpus = spark.createDataFrame([("a", " ".join("x" * 54)), ("b", "too short")], "doc_id string, text string")
    rows = extract_positions(corpus).orderBy("n_raw_tokens").collect()
    assert [(r["doc_id"], r["n_raw_tokens"]) for r in rows] == [("a", n) for n in (51, 52, 53, 54)]


def test_index_sampling_is_uniform(spark):
    picks = spark.range(4000).select(F.explode(S.sample_indices(F.lit(8), 3, 42, F.col("id"))).alias("i"))
    counts = {r["i"]: r["count"] for r in picks.groupBy("i").count().collect()}
    assert set(counts) == set(range(8))
    assert all(abs(c - 1500) < 150 for c in counts.values())


def test_pad_token_check(spark):
    tokenized = with_tokens(spark.createDataFrame([("a <pad> b",), ("c",)], "text string"))
    check_token_absent(tokenized, " <eos>")
    with pytest.raises(DataCheckError):
        check_token_absent(tokenized, " <pad>")
    with pytest.raises(DataCheckError):
        extract_positions(spark.createDataFrame([("1", "a <pad>")], "doc_id string, text string"), pad_token=" <pad>")


def test_range_shards(spark):
    rows = spark.range(10).select(F.format_string("d%02d", "id").alias("doc_id"))
    counts = S.range_shards(rows, 3).groupBy("shard_id").count().collect()
    assert {r["shard_id"]: r["count"] for r in counts} == {0: 3, 1: 3, 2: 4}
    few = S.range_shards(rows.filter("doc_id < 'd02'"), 4).collect()
    assert sorted((r["doc_id"], r["shard_id"]) for r in few) == [("d00", 1), ("d01", 3)]


def test_natural_rank_of_two_keys(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"), (-F.col("id")).alias("payload"))
    got = S.natural_rank(rows, ["a", "b"]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1000))
    assert [(r["a"], r["b"]) for r in got] == sorted((r["a"], r["b"]) for r in got)
    assert all(r["payload"] == -r["b"] for r in got)


def test_epoch_batches_are_full_and_change_with_the_epoch(spark):
    rows = spark.range(103)
    first = S.epoch_batches(rows, ["id"], world=3, batch=5, epoch=0).collect()
    groups = Counter((r["worker"], r["batch_id"]) for r in first)
    assert set(groups.values()) == {5} and len(groups) == 3 * (103 // 3 // 5)
    assert len({r["id"] for r in first}) == len(first)
    second = S.epoch_batches(rows, ["id"], world=3, batch=5, epoch=1).collect()
    assert {(r["id"], r["worker"], r["batch_id"]) for r in first} != {(r["id"], r["worker"], r["batch_id"]) for r in second}


def test_assign_by_deficit_waterfall(spark):
    got = S.assign_by_deficit(docs(spark, 10), {"av": 3, "ar": 0, "rl": 4}).collect()
    assert Counter(r["bucket"] for r in got) == {"av": 3, "rl": 4, None: 3}
    short = S.assign_by_deficit(docs(spark, 4), {"av": 3, "ar": 5, "rl": 5}).collect()
    assert Counter(r["bucket"] for r in short) == {"av": 3, "ar": 1}


def test_running_mean_matches_brute_force(spark):
    rows = spark.range(257).select("id", F.when(F.col("id") % 4 != 0, F.col("id") * 1.5).alias("v"))
    got = S.running_mean(rows, "id", "v", 10, buckets=7).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(9, 257, 10))
    for r in got:
        values = [i * 1.5 for i in range(r["id"] + 1) if i % 4]
        assert r["n_valid"] == len(values)
        assert r["running_mean"] == pytest.approx(sum(values) / len(values))


def test_bucket_needs():
    assert S.bucket_needs(10) == {"av": 2, "ar": 2, "rl": 6}
    assert S.deficits({"av": 5, "ar": 1}, {"av": 2, "ar": 4}) == {"av": 3, "ar": 0}


def test_split_rule_fits_every_table_with_the_documents(spark):
    rows = docs(spark, 40, copies=2)
    rule = S.split_rule(rows)
    other = docs(spark, 40, copies=5).withColumn("split", rule).distinct().collect()
    assert {tuple(r) for r in other} == {tuple(r) for r in S.split_documents(rows).distinct().collect()}
