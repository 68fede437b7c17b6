import pytest
from pyspark.sql import functions as F

from echoframe.functions import constants as C
from echoframe.operators import joins as J
from echoframe.operators import training_tables as TT
from echoframe.operators.positions import DataCheckError
from echoframe.session import new_table_path
from echoframe.sources import sidecar as SC
from echoframe.sources import tables as TB
from echoframe.sources.corpus import read_corpus


def explained(spark, n=4):
    return spark.range(n).select(
        F.concat(F.lit("d"), "id").alias("doc_id"), (F.col("id") + 51).alias("n_raw_tokens"),
        F.lit("text").alias("detokenized_text_truncated"), F.concat(F.lit("a\n\nb"), "id").alias("api_explanation"),
    )


def vectors(spark, n=4, width=3):
    value = F.array(*[(F.col("id") + i).cast("float") for i in range(width)])
    return spark.range(n).select(
        F.concat(F.lit("d"), "id").alias("doc_id"), (F.col("id") + 51).alias("n_raw_tokens"),
        value.alias("activation_vector"), F.lit(7).cast("bigint").alias("activation_layer"),
    )


@pytest.mark.parametrize("left, right", [(4, 3), (3, 4)])
def test_incomplete_keys_fail_unless_not_strict(spark, left, right):
    with pytest.raises(DataCheckError):
        J.join_vectors(explained(spark, left), vectors(spark, right))
    assert J.join_vectors(explained(spark, left), vectors(spark, right), strict=False).count() == 3


def test_repeated_keys_fail(spark):
    with pytest.raises(DataCheckError):
        J.join_vectors(explained(spark).union(explained(spark, 1)), vectors(spark), strict=False)


def test_join_is_by_key_not_by_row_order(spark):
    joined = J.join_vectors(explained(spark).orderBy(F.desc("doc_id")), vectors(spark)).collect()
    assert all(r["activation_vector"][0] == float(r["doc_id"][1:]) for r in joined)


@pytest.mark.parametrize("split", ["av_sft", "ar_sft", "rl"])
def test_training_tables_and_sidecars(spark, split):
    path = new_table_path(spark, "test-training")
    meta = TT.build_training(explained(spark), vectors(spark), split, path, marker={"injection_char": "㈎"})
    rows = TB.read_table(spark, path, TT.SCHEMAS[split])
    assert rows.count() == 4 and rows.columns == TT.SCHEMAS[split].names
    assert {r["activation_layer"] for r in rows.collect()} == {7}
    assert SC.read_sidecar(spark, path) == meta
    assert meta["row_count"] == 4 and meta["extraction"] == {
        "d_model": 3, "injection_scale": None, "mse_scale": "sqrt_d_model", "norm": "none"
    }
    assert ("critic" in meta["prompt_templates"]) == (split == "ar_sft")
    first = rows.filter("doc_id = 'd1'").first()
    if split == "ar_sft":
        assert first["prompt"] == "Summary of the following text: <text>a\n\nb1</text> <summary>"
        assert meta["tokens"]["critic_suffix"] == [" <summary>"]
    else:
        assert first["prompt"][0]["role"] == "user" and C.INJECT_PLACEHOLDER in first["prompt"][0]["content"]
    if split == "av_sft":
        assert first["response"] == "<explanation>\na\n\nb1\n</explanation>"


def test_unknown_split(spark):
    with pytest.raises(ValueError):
        TT.training_rows(explained(spark), vectors(spark), "test")


def test_bad_tail_and_uneven_vectors_leave_no_sidecar(spark, monkeypatch):
    path = new_table_path(spark, "test-training")
    monkeypatch.setattr(TT.T, "template_suffix_tokens", lambda *_: [" <other>"])
    with pytest.raises(DataCheckError):
        TT.build_training(explained(spark), vectors(spark), "ar_sft", path)
    assert SC.read_sidecar(spark, path) == {}
    uneven = vectors(spark, 3).union(vectors(spark, 4, 2).filter("doc_id = 'd3'"))
    with pytest.raises(DataCheckError):
        TT.build_training(explained(spark), uneven, "rl", new_table_path(spark, "test-training"))


def test_schema_is_checked_before_writing(spark):
    with pytest.raises(DataCheckError, match="n_raw_tokens"):
        TB.write_table(explained(spark).withColumn("n_raw_tokens", F.lit("x")), new_table_path(spark, "t"), TB.EXPLAINED)


def test_append_is_idempotent(spark):
    path = new_table_path(spark, "test-append")
    for n in (2, 4, 4):
        out = TB.append_rows(spark, explained(spark, n), path, ["doc_id", "n_raw_tokens"])
        assert out.count() == n


def test_merge_checks_the_count(spark):
    assert TB.merge_tables([explained(spark, 2), explained(spark, 3)], 5).count() == 5
    with pytest.raises(DataCheckError):
        TB.merge_tables([explained(spark, 2)], 3)


def test_document_count_of_a_missing_table(spark):
    assert TB.bucket_doc_count(spark, new_table_path(spark, "nothing")) == 0


def test_sorted_output_is_ordered_across_partitions(spark):
    out = TB.sorted_by(spark.range(500).select(F.xxhash64("id").alias("k")), "k")
    placed = out.withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    assert [r["k"] for r in placed] == sorted(r["k"] for r in placed)


def test_corpus_index_over_several_files(spark):
    path = new_table_path(spark, "test-corpus")
    docs = spark.range(97).select(F.concat(F.lit("t"), "id").alias("text"))
    docs.repartitionByRange(5, "text").write.parquet(path)
    rows = read_corpus(spark, path, "c").collect()
    assert sorted(r["corpus_index"] for r in rows) == list(range(97))
    window = read_corpus(spark, path, "c", start=10, length=30).collect()
    by_index = {r["corpus_index"]: r["text"] for r in rows}
    assert {r["doc_id"]: r["text"] for r in window} == {f"c:train:{i}": by_index[i] for i in range(10, 40)}


def test_window_is_pushed_into_the_scan(spark, sf):
    frame = read_corpus(spark, f"{sf}/documents.parquet", "d", start=5, length=10, index="doc_id")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,5)" in plan and "LessThan(doc_id,15)" in plan
    assert "lang" not in plan


def test_key_difference_is_one_aggregation_of_both_sides(spark):
    kind = "doc_id string, n_raw_tokens bigint"
    left = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3), (None, None)], kind)
    right = spark.createDataFrame([("a", 1), ("c", 2), ("c", 2), (None, None)], kind)
    out = J.key_difference(left, right)
    assert sorted(map(str, out.collect())) == sorted(
        ["Row(doc_id='b', n_raw_tokens=2, side='missing')", "Row(doc_id=None, n_raw_tokens=3, side='missing')", "Row(doc_id='c', n_raw_tokens=2, side='extra')"]
    )
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
