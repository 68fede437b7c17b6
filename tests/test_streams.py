"""Streams with keyed state: what was seen costs neither a call nor a read."""

import glob
import os

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from echoframe.operators import inference as I
from echoframe.operators import labelling as L
from echoframe.operators import pool as PL
from echoframe.operators.sampling import bucket_needs
from echoframe.sources import commits
from echoframe.sources.tables import POSITIONS
from echoframe.streaming import jobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # test classes travel with the task


class Noted(I.Provider):
    """Leaves a file per prompt asked."""

    def __init__(self, folder):
        self.folder = folder

    def complete(self, prompts):
        for p in prompts:
            with open(os.path.join(self.folder, f"{abs(hash(p))}-{os.urandom(8).hex()}"), "w") as f:
                f.write(p)
        return [None if "silent" in p else f"<analysis>\n- one\n\n- two {len(p)}\n</analysis>" for p in prompts]


class Forbidden(I.Provider):
    def complete(self, prompts):
        raise AssertionError("asked")


def deliver(spark, source, *rows):
    spark.createDataFrame(rows, POSITIONS).coalesce(1).write.mode("append").parquet(source)


def spoil(target):
    """Whatever reads an earlier file of the target fails from now on."""
    files = [f for f in glob.glob(f"{target}/*/batch=*/**/*.parquet", recursive=True)]
    assert files
    for name in files:
        with open(name, "wb") as f:
            f.write(b"spoiled")
    return files


def keep(files):
    return {name: open(name, "rb").read() for name in files}


def keys(df):
    return sorted((r["doc_id"], r["n_raw_tokens"]) for r in df.collect())


def test_labels_are_state(spark, tmp_path):
    source, target, checkpoint, asked = (str(tmp_path / n) for n in ("source", "target", "checkpoint", "asked"))
    os.mkdir(asked)
    deliver(spark, source, ("d1", 1, "text a"), ("d2", 2, "text a"), ("d3", 3, "text b"), ("d4", 4, "silent"), ("d1", 1, "text a"))
    jobs.label_stream(spark, source, target, checkpoint, Noted(asked)).awaitTermination()
    assert len(os.listdir(asked)) == 3
    assert keys(L.labelled(spark, target)) == [("d1", 1), ("d2", 2), ("d3", 3)]
    assert [r["doc_id"] for r in L.audited(spark, target).filter("dropped").collect()] == ["d4"]
    # later: all again, and new positions of known texts. Nobody is asked, and the target is not read
    before = keep(glob.glob(f"{target}/*/batch=*/*.parquet"))
    spoil(target)
    deliver(spark, source, ("d1", 1, "text a"), ("d4", 4, "silent"), ("d5", 5, "text b"), ("d6", 6, "silent"))
    jobs.label_stream(spark, source, target, checkpoint, Forbidden()).awaitTermination()
    for name, data in before.items():
        with open(name, "wb") as f:
            f.write(data)
        crc = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    assert keys(L.labelled(spark, target)) == [("d1", 1), ("d2", 2), ("d3", 3), ("d5", 5)]
    assert keys(L.audited(spark, target).filter("dropped")) == [("d4", 4), ("d6", 6)]


@pytest.mark.parametrize("when", ["before the record", "after the record"])
def test_restart_from_the_checkpoint(spark, tmp_path, monkeypatch, when):
    source, target, checkpoint, asked = (str(tmp_path / n) for n in ("source", "target", "checkpoint", "asked"))
    os.mkdir(asked)
    deliver(spark, source, ("d1", 1, "text a"), ("d2", 2, "text b"))
    publish = commits._publish

    def lost(*args):
        if when == "after the record":
            publish(*args)
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(commits, "_publish", lost)
        with pytest.raises(Exception, match="driver lost"):
            jobs.label_stream(spark, source, target, checkpoint, Noted(asked)).awaitTermination()
    committed = commits.committed_batches(spark, target)
    assert committed == ([0] if when == "after the record" else [])
    jobs.label_stream(spark, source, target, checkpoint, Noted(asked)).awaitTermination()
    assert keys(L.labelled(spark, target)) == [("d1", 1), ("d2", 2)]
    deliver(spark, source, ("d3", 3, "text a"), ("d4", 4, "text c"))
    n = len(os.listdir(asked))
    jobs.label_stream(spark, source, target, checkpoint, Noted(asked)).awaitTermination()
    assert keys(L.labelled(spark, target)) == [("d1", 1), ("d2", 2), ("d3", 3), ("d4", 4)]
    assert len(os.listdir(asked)) == n + 1


def test_a_cache_spares_calls(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("source", "target", "checkpoint"))
    deliver(spark, source, ("d1", 1, "known"))
    cache = spark.createDataFrame([("known", "one\n\ntwo")], "t string, explanation string").select(F.sha2("t", 256).alias("text_sha256"), "explanation")
    jobs.label_stream(spark, source, target, checkpoint, Forbidden(), cache=cache).awaitTermination()
    assert [r["api_explanation"] for r in L.labelled(spark, target).collect()] == ["one\n\ntwo"]
    assert L.audited(spark, target).count() == 0


def test_one_text_of_many_positions_is_one_call(spark, tmp_path):
    source, target, checkpoint, asked = (str(tmp_path / n) for n in ("source", "target", "checkpoint", "asked"))
    os.mkdir(asked)
    rows = spark.range(3000).select(
        F.concat(F.lit("d"), "id").alias("doc_id"), F.col("id").alias("n_raw_tokens"),
        F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("detokenized_text_truncated"),
    )
    rows.repartition(5).write.parquet(source)
    jobs.label_stream(spark, source, target, checkpoint, Noted(asked), files_per_batch=2).awaitTermination()
    assert L.labelled(spark, target).count() == 3000
    assert len(os.listdir(asked)) == 51


def test_state_of_labels_is_kept_without_calls_from_python(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("source", "target", "checkpoint"))
    deliveries = ((("d1", 1, "text a"), ("d2", 2, "text a"), ("d3", 3, "text b")), (("d1", 1, "text a"), ("d4", 4, "text a")))
    for rows, positions, asked, met in zip(deliveries, (3, 1), (2, 0), (2, 1), strict=True):
        deliver(spark, source, *rows)
        stream = jobs.label_stream(spark, source, target, checkpoint)
        stream.awaitTermination()
        states = [(s["operatorName"], s["numRowsUpdated"]) for s in stream.lastProgress["stateOperators"]]
        assert sorted(states) == sorted([("dedupe", positions), ("dedupe", asked), ("stateStoreSave", met)])


def test_one_key_with_two_texts_is_two_positions(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("source", "target", "checkpoint"))
    texts = spark.range(600).select(F.format_string("text number %d of these", "id").alias("detokenized_text_truncated"))
    keyed = texts.select(F.lit(None).cast("string").alias("doc_id"), F.lit(7).cast("long").alias("n_raw_tokens"), "detokenized_text_truncated")
    keyed.union(keyed).coalesce(1).write.parquet(source)  # among so many texts some hashes share their last 12 bits
    jobs.label_stream(spark, source, target, checkpoint).awaitTermination()
    rows = L.labelled(spark, target)
    assert rows.count() == rows.select("detokenized_text_truncated").distinct().count() == 600
    assert L.audited(spark, target).count() == 600


def test_ingest_reads_no_row_of_its_own_pool(spark, sf, tmp_path):
    source, pool, checkpoint = (str(tmp_path / n) for n in ("source", "pool", "checkpoint"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    needs = bucket_needs(120)
    docs.filter("doc_id < 60").write.parquet(source)
    jobs.ingest_corpus(spark, source, docs.schema, pool, needs, checkpoint, positions_per_doc=1).awaitTermination()
    first = PL.pool_counts(spark, pool)
    assert 0 < sum(first.values()) <= 60
    spoil(pool)
    docs.write.mode("append").parquet(source)  # all again, and the rest
    jobs.ingest_corpus(spark, source, docs.schema, pool, needs, checkpoint, positions_per_doc=1).awaitTermination()
    assert PL.pool_counts(spark, pool) == needs
    last = commits.last_commit(spark, pool)["batch"]
    later = commits.read_committed(spark, pool, "positions", PL.POOL, batches=[last])
    assert later.select("doc_id").distinct().count() == sum(needs.values()) - sum(first.values())
    assert later.filter(F.split("doc_id", ":")[2].cast("long") < 60).count() == 0


def test_ingest_reads_a_folder_of_files_like_one_file(spark, tmp_path):
    from echoframe.plans import registry

    docs = spark.range(40).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), i + F.col("id")))).alias("text")
    )
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one-file"))
    os.mkdir(tmp_path / "one")
    os.rename(glob.glob(str(tmp_path / "one-file" / "*.parquet"))[0], tmp_path / "one" / "documents.parquet")
    many, one = (sorted(map(tuple, registry.PLANS["st1_ingest_stream"](spark, str(tmp_path / n)).collect())) for n in ("many", "one"))
    assert len(many) == 20 and many == one
