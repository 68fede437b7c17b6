"""Tables that change together: half batches are never seen, and never stay."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from echoframe.operators import inference as I
from echoframe.operators import labelling as L
from echoframe.operators import pool as PL
from echoframe.operators.sampling import bucket_needs
from echoframe.session import new_table_path
from echoframe.sources import commits
from echoframe.sources.corpus import read_corpus

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # test classes travel with the task


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def held(spark, path, table):
    rows = commits.read_committed(spark, path, table)
    return None if rows is None else sorted(r["v"] for r in rows.collect())


def failing(spark):
    return numbers(spark, 1).select(F.raise_error(F.lit("lost executor")).cast("long").alias("v"))


def test_batches_and_facts(spark):
    path = new_table_path(spark, "test-commits")
    assert commits.last_commit(spark, path)["batch"] == -1 and held(spark, path, "a") is None
    first = commits.commit(spark, path, {"a": numbers(spark, 1, 2), "b": numbers(spark, 3)}, {"cursor": 5, "kept": "x"})
    assert first["rows"] == {"a": 2, "b": 1}
    commits.commit(spark, path, {"a": numbers(spark)}, {"cursor": 9})
    commits.commit(spark, path, {"a": numbers(spark, 4)})
    assert held(spark, path, "a") == [1, 2, 4] and held(spark, path, "b") == [3]
    assert commits.last_commit(spark, path)["facts"] == {"cursor": 9, "kept": "x"}
    assert sorted(r["v"] for r in commits.read_committed(spark, path, "a", batches=[0]).collect()) == [1, 2]
    assert "batch" not in commits.read_committed(spark, path, "a").columns


@pytest.mark.parametrize("where", ["second table", "record"])
def test_a_crash_leaves_no_half_batch(spark, monkeypatch, where):
    path = new_table_path(spark, "test-commits")
    commits.commit(spark, path, {"a": numbers(spark, 1), "b": numbers(spark, 2)}, {"cursor": 1})
    with monkeypatch.context() as m:
        if where == "record":
            m.setattr(commits, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(Exception, match="lost"):
            commits.commit(spark, path, {"a": numbers(spark, 7, 8), "b": failing(spark) if where == "second table" else numbers(spark, 9)}, {"cursor": 2})
    assert held(spark, path, "a") == [1] and held(spark, path, "b") == [2]
    assert commits.last_commit(spark, path)["facts"] == {"cursor": 1}
    # the next batch has the same number and other tables: nothing of the half one shows up in it
    commits.commit(spark, path, {"b": numbers(spark, 5)}, {"cursor": 3})
    assert held(spark, path, "a") == [1] and held(spark, path, "b") == [2, 5]


def test_a_second_writer_changes_nothing(spark, monkeypatch):
    path = new_table_path(spark, "test-commits")
    commits.commit(spark, path, {"a": numbers(spark, 1)})
    record = commits.last_commit(spark, path)
    with pytest.raises(RuntimeError):
        commits._publish(spark, path, {**record, "facts": {"mine": True}})
    assert commits.last_commit(spark, path) == record


class Plain(I.Provider):
    def complete(self, prompts):
        return [f"<analysis>\n- one\n\n- two of {len(p)}\n</analysis>" if "good row" in p else None for p in prompts]


def test_labels_and_audit_come_together(spark, monkeypatch):
    path = new_table_path(spark, "test-labels")
    rows = spark.createDataFrame([("d1", 1, "good row"), ("d2", 2, "bad row")], "doc_id string, n_raw_tokens long, detokenized_text_truncated string")
    with monkeypatch.context() as m:
        m.setattr(commits, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            L.label_into(spark, rows, path, Plain())
    assert L.labelled(spark, path) is None and L.audited(spark, path) is None
    assert L.label_into(spark, rows, path, Plain()) == {"explained": 1, "dropped": 1}
    assert L.labelled(spark, path).count() == 1 and L.audited(spark, path).count() == 2
    assert L.label_into(spark, rows, path, Plain()) == {"explained": 0, "dropped": 0}


def test_the_cursor_moves_with_the_rows(spark, sf, monkeypatch):
    pool = new_table_path(spark, "test-pool")

    def window(start, length):
        return read_corpus(spark, f"{sf}/documents.parquet", "documents", start=start, length=length, index="doc_id")

    PL.grow_pool(spark, pool, window, bucket_needs(30), positions_per_doc=1)
    before = (PL.pool_positions(spark, pool).count(), commits.last_commit(spark, pool))
    with monkeypatch.context() as m:
        m.setattr(commits, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            PL.grow_pool(spark, pool, window, bucket_needs(60), positions_per_doc=1)
    assert (PL.pool_positions(spark, pool).count(), commits.last_commit(spark, pool)) == before
    PL.grow_pool(spark, pool, window, bucket_needs(60), positions_per_doc=1)
    counted = PL.pool_positions(spark, pool).groupBy("bucket").agg(F.countDistinct("doc_id").alias("n"))
    assert {r["bucket"]: r["n"] for r in counted.collect()} == PL.pool_counts(spark, pool)
    assert commits.last_commit(spark, pool)["facts"][PL.CURSOR] > before[1]["facts"][PL.CURSOR]


def test_a_table_made_of_another_is_written_after_it(spark):
    path = new_table_path(spark, "test-commits")
    made = spark.sparkContext.accumulator(0)

    def count(v):
        made.add(1)
        return v

    dear = numbers(spark, 1, 2, 3).select(F.udf(count, "long")("v").alias("v"))
    record = commits.commit(spark, path, {"a": dear, "b": lambda stored: stored["a"].filter("v > 1")}, lambda stored: {"least": stored["b"].agg(F.min("v")).first()[0]})
    assert record["rows"] == {"a": 3, "b": 2} and record["facts"] == {"least": 2}
    assert held(spark, path, "a") == [1, 2, 3] and held(spark, path, "b") == [2, 3] and made.value == 3
    assert commits.commit(spark, path, {"a": numbers(spark, 4)})["facts"] == {"least": 2}
