import pytest

from echoframe.operators import joins as J
from echoframe.operators import pool as PL
from echoframe.operators.generation import generate
from echoframe.operators.positions import DataCheckError
from echoframe.operators.sampling import bucket_needs
from echoframe.session import new_table_path
from echoframe.sources.corpus import read_corpus
from echoframe.sources.sidecar import read_json
from echoframe.streaming import jobs


def window(spark, sf):
    return lambda start, length: read_corpus(spark, f"{sf}/documents.parquet", "documents", start=start, length=length, index="doc_id")


def buckets(spark, pool):
    return {r["doc_id"]: r["bucket"] for r in PL.pool_positions(spark, pool).select("doc_id", "bucket").distinct().collect()}


def test_growing_never_moves_a_document(spark, sf):
    pool = new_table_path(spark, "test-pool")
    assert PL.pool_counts(spark, pool) == {"av": 0, "ar": 0, "rl": 0}
    PL.grow_pool(spark, pool, window(spark, sf), bucket_needs(40), positions_per_doc=2)
    first, cursor = buckets(spark, pool), read_json(spark, PL.meta_path(pool))[PL.CURSOR]
    assert cursor == 40
    PL.grow_pool(spark, pool, window(spark, sf), bucket_needs(100), positions_per_doc=2)
    second = buckets(spark, pool)
    assert first.items() <= second.items() and len(second) > len(first)
    rows = PL.pool_positions(spark, pool)
    assert rows.groupBy("doc_id", "n_raw_tokens").count().filter("count > 1").count() == 0
    before = read_json(spark, PL.meta_path(pool))
    have = PL.pool_counts(spark, pool)
    assert PL.grow_pool(spark, pool, window(spark, sf), have, positions_per_doc=2) == have
    assert read_json(spark, PL.meta_path(pool)) == before


def test_a_replayed_batch_adds_nothing(spark, sf):
    pool = new_table_path(spark, "test-pool")
    batch = PL.extract_positions(window(spark, sf)(0, 30), positions_per_doc=1)
    assert PL.add_to_pool(spark, pool, batch, bucket_needs(60)) > 0
    assert PL.add_to_pool(spark, pool, batch, bucket_needs(60)) == 0


def test_model_output_takes_explained_rows_when_there_are_any(spark, sf):
    pool = new_table_path(spark, "test-pool")
    PL.grow_pool(spark, pool, window(spark, sf), bucket_needs(40), positions_per_doc=2)
    PL.label_pool(spark, pool)
    av, rl = PL.model_output(spark, pool, "av", 5), PL.model_output(spark, pool, "rl", 1000)
    assert "api_explanation" in av.columns and "api_explanation" not in rl.columns
    assert av.select("doc_id").distinct().count() == 5
    assert rl.select("doc_id").distinct().count() == PL.pool_counts(spark, pool)["rl"]


def test_stream_over_two_deliveries(spark, sf):
    source, pool, checkpoint = (new_table_path(spark, n) for n in ("test-source", "test-pool", "test-checkpoint"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    needs = bucket_needs(120)
    seen = []
    for part in (docs.filter("doc_id < 80"), docs.filter("doc_id >= 80")):
        part.write.mode("append").parquet(source)
        jobs.ingest_corpus(spark, source, docs.schema, pool, needs, checkpoint, files_per_batch=1, positions_per_doc=1).awaitTermination()
        seen.append(buckets(spark, pool))
    assert seen[0].items() <= seen[1].items()
    assert PL.pool_counts(spark, pool) == needs
    again = new_table_path(spark, "test-checkpoint")  # a lost checkpoint replays everything
    jobs.ingest_corpus(spark, source, docs.schema, pool, needs, again, positions_per_doc=1).awaitTermination()
    assert buckets(spark, pool) == seen[1]


def test_generation_end_to_end_and_again(spark, sf):
    pool, out = new_table_path(spark, "test-pool"), new_table_path(spark, "test-out")
    settings = dict(corpus=window(spark, sf), num_docs=60, fingerprint="f1", tokenizer_name="blanks", positions_per_doc=2)
    paths = generate(spark, pool, out, **settings)
    for bucket, path in paths.items():
        rows, vectors = spark.read.parquet(path), spark.read.parquet(f"{path}_vectors")
        assert rows.count() == vectors.count() > 0
        assert ("api_explanation" in rows.columns) == (bucket != "rl")
        assert J.check_keys(rows, vectors)["n_missing"] == 0
    before = {b: spark.read.parquet(p).select("doc_id", "n_raw_tokens").collect() for b, p in paths.items()}
    generate(spark, pool, out, stages=["explain", "output"], **settings)
    for b, p in paths.items():
        assert sorted(spark.read.parquet(p).select("doc_id", "n_raw_tokens").collect()) == sorted(before[b])
    with pytest.raises(DataCheckError):
        generate(spark, pool, out, **{**settings, "fingerprint": "f2"})
    with pytest.raises(ValueError):
        generate(spark, pool, out, stages=["train"], **settings)
