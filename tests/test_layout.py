"""Bucketed tables, sketches before joins, windows that open only their files, batches by budget, ranks and shards."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echoframe.operators import inference as I
from echoframe.operators import joins as J
from echoframe.operators import labelling as L
from echoframe.operators import marks as M
from echoframe.operators import sampling as S
from echoframe.session import new_table_path
from echoframe.sources import bucketed as B
from echoframe.sources.corpus import read_corpus


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def without_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def sides(spark):
    rows = spark.range(500).select(F.concat(F.lit("d"), F.col("id") % 60).alias("doc_id"), F.col("id").alias("n_raw_tokens"))
    return rows.withColumn("api_explanation", F.concat(F.lit("e"), "n_raw_tokens")), rows.filter("n_raw_tokens % 3 > 0").withColumn("activation_vector", F.array(F.col("n_raw_tokens").cast("float")))


def test_bucketed_sides_are_not_shuffled(spark):
    undo = without_broadcast(spark)
    try:
        paths = [new_table_path(spark, "test-bucketed") for _ in range(2)]
        left, right = sides(spark)
        a, b = (B.write_bucketed(t, p, L.KEYS, 4) for t, p in zip((left, right), paths))
        joined = J.join_vectors(a, b, strict=False, check=False)
        assert "Exchange" not in plan(joined)
        want = sorted(tuple(r) for r in J.join_vectors(left, right, strict=False, check=False).collect())
        assert sorted(tuple(r) for r in joined.collect()) == want
        # a session that has never heard of the tables opens them by path
        for p in paths:
            spark.sql(f"DROP TABLE {B._name(p)}")
        again = J.join_vectors(*(B.open_bucketed(spark, p) for p in paths), strict=False, check=False)
        assert "Exchange" not in plan(again) and sorted(tuple(r) for r in again.collect()) == want
        with pytest.raises(FileNotFoundError):
            B.open_bucketed(spark, new_table_path(spark, "none"))
    finally:
        undo()


def test_a_bucketed_cache_stays_where_it_is(spark):
    undo = without_broadcast(spark)
    try:
        cache = spark.range(300).select(F.sha2(F.col("id").cast("string"), 256).alias("text_sha256"), F.concat(F.lit("x"), "id").alias("explanation"))
        stored = B.write_bucketed(cache, new_table_path(spark, "test-cache"), ["text_sha256"], 8)
        texts = spark.range(0, 900, 2).select(F.sha2(F.col("id").cast("string"), 256).alias("text_sha256"))
        found = L.cache_lookup(texts, stored)
        assert plan(found).count("Exchange hashpartitioning") == 1  # the texts alone
        assert found.filter("cached is not null").count() == 150 and found.count() == 450
    finally:
        undo()


@given(st.lists(st.text(max_size=5), max_size=40), st.lists(st.text(max_size=5), max_size=40))
@settings(max_examples=8, deadline=None)
def test_a_sketch_loses_no_key(spark, chosen, others):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(chosen + others)], "doc_id string, i int")
    ids = spark.createDataFrame([(k,) for k in chosen], "doc_id string")
    kept = {r["i"] for r in M.may_match(rows, M.sketch(ids, ["doc_id"]), ["doc_id"]).collect()}
    assert set(range(len(chosen))) <= kept
    exact = J.keep_documents(rows, ids, sketched=True).collect()
    assert sorted(r["i"] for r in exact) == [i for i, k in enumerate(chosen + others) if k in set(chosen)]


def test_a_sketch_spares_the_shuffle(spark):
    undo = without_broadcast(spark)
    try:
        rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 50).alias("wide")).repartition(4)
        ids = spark.range(100).select((F.col("id") * 7).alias("doc_id"))
        passed = M.may_match(rows, M.sketch(ids, ["doc_id"]), ["doc_id"]).count()
        assert 100 <= passed <= 110
        assert J.keep_documents(rows, ids, sketched=True).count() == 100
        assert M.sketch(spark.range(10**6).select(F.col("id").alias("doc_id")), ["doc_id"]).count() <= M.WORDS
    finally:
        undo()


def test_a_sketch_grows_with_its_keys_as_far_as_it_may(spark):
    assert [M.words_for(n) for n in (0, 1 << 20, 1 << 21, 1 << 22, 10**9)] == [1 << 18, 1 << 18, 1 << 19, 1 << 20, M.MOST_WORDS]
    few = spark.range(40_000).select(F.col("id").alias("doc_id"))
    others = spark.range(10**6, 10**6 + 20_000).select(F.col("id").alias("doc_id"))
    marks = M.sketch(few, ["doc_id"], 10_000)
    assert marks.count() <= -(-10_000 // M.ROW_WORDS) and M.may_match(few, marks, ["doc_id"], 10_000).count() == 40_000
    passed = M.may_match(others, marks, ["doc_id"], 10_000).count()
    assert passed <= 20_000 / 50 and passed + M.cannot_match(others, marks, ["doc_id"], 10_000).count() == 20_000


@pytest.mark.parametrize("folder", ["plain", "with space %41"])
def test_a_window_opens_its_files_alone(spark, tmp_path, folder):
    path = str(tmp_path / folder)
    spark.range(1000).select(F.concat(F.lit("t"), "id").alias("text"), "id").repartitionByRange(50, "id").sortWithinPartitions("id").write.parquet(path)
    everything = {r["corpus_index"]: r["text"] for r in read_corpus(spark, path, "c").collect()}
    assert sorted(everything) == list(range(1000))
    for start, length, files in ((0, 5, 1), (405, 10, 2), (990, 100, 1), (2000, 5, 1), (500, None, 50)):
        part = read_corpus(spark, path, "c", start=start, length=length)
        rows = {r["corpus_index"]: r["text"] for r in part.collect()}
        assert rows == {k: v for k, v in everything.items() if k >= start and (length is None or k < start + length)}
        assert len([f for f in part.inputFiles() if "corpus-files" not in f]) <= files


@given(st.lists(st.integers(0, 300), max_size=60), st.integers(1, 400))
@settings(max_examples=200, deadline=None)
def test_packs_fit_the_budget(lengths, budget):
    lengths = np.array(lengths, np.int64)
    packs = I.pack(lengths, budget)
    assert sorted(int(i) for p in packs for i in p) == list(range(len(lengths)))
    for p in packs:
        assert len(p) == 1 or lengths[p].max() * len(p) <= budget


class Padded(I.Encoder):
    """Refuses a batch whose padded size is over its room."""

    def encode(self, texts, positions):
        n = [len(t.split()) for t in texts]
        assert len(texts) == 1 or max(n) * len(texts) <= 400, (max(n), len(texts))
        return [(p, np.array([[float(len(t)), float(k)] for k in p]).reshape(len(p), 2)) for t, p in zip(texts, positions)]


def test_an_encoder_sees_no_batch_over_its_budget(spark):
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = [(f"d{k}", n, " ".join(["w"] * n)) for k, n in enumerate([1, 5, 300, 90, 90, 90, 7, 500, 33, 2] * 6)]
    positions = spark.createDataFrame(rows, "doc_id string, n_raw_tokens long, detokenized_text_truncated string").repartition(2)
    plain_ = {(r["doc_id"], r["n_raw_tokens"]): list(r["activation_vector"]) for r in I.encode(positions, encoder=Padded(), token_budget=400).collect()}
    assert plain_ == {(d, n): [float(len(t)), float(n)] for d, n, t in rows}
    report = I.packing_report(positions, 400).first()
    assert report["n_docs"] == 60 and report["n_tokens"] == sum(n for _, n, _ in rows) and report["n_over"] == 0
    assert report["n_tokens"] <= report["n_padded"] < 2 * report["n_tokens"]


def test_ranks_of_any_keys(spark):
    rng = np.random.default_rng(0)
    rows = list({(None if k % 9 == 0 else f"é{rng.integers(0, 30)}" if k % 2 else f"Z{rng.integers(0, 30)}", int(rng.integers(-50, 50))) for k in range(400)})
    frame = spark.createDataFrame(rows, "a string, b long").repartition(3)
    got = {(r["a"], r["b"]): r["rank"] for r in S.natural_rank(frame, ["a", "b"]).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    assert got == {r: k for k, r in enumerate(order)}
    assert S.natural_rank(frame.limit(0), ["a", "b"]).collect() == []


def test_many_shards_make_a_small_plan(spark):
    docs = spark.range(12_000).select(F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("doc_id"))
    sharded = S.range_shards(docs, 5000)
    got = {r["doc_id"]: r["shard_id"] for r in sharded.collect()}
    starts = [s * 12_000 // 5000 for s in range(5000)]
    want = np.searchsorted(starts, np.arange(12_000), "right") - 1
    assert [got[k] for k in sorted(got)] == want.tolist()
    assert sharded._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") < 20


def test_buckets_grow_with_the_table():
    assert B.buckets_for(0) == B.buckets_for(1000) == 8
    assert B.buckets_for(30_000_000) * B.BUCKET_ROWS >= 30_000_000
