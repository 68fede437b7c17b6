import json

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from echoframe.operators import inference as I
from echoframe.operators import labelling as L
from echoframe.operators import vocabulary as VOC
from echoframe.operators.positions import DataCheckError, with_tokens
from echoframe.session import new_table_path
from echoframe.sources import label_cache as LC
from echoframe.sources import sidecar as SC

SCHEMA = "doc_id string, n_raw_tokens bigint, detokenized_text_truncated string"

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # test classes travel with the task


class Forbidden(I.Provider):
    def outcomes(self, prompts):
        raise AssertionError("the provider must not be called")


class TooFew(I.Provider):
    def complete(self, prompts):
        return ["x"] * (len(prompts) - 1)


class Scripted(I.Provider):
    """Answers by what the text says."""

    def complete(self, prompts):
        answers = {"good": "<analysis>\n- a\n- b\n</analysis>", "thin": "<analysis>a</analysis>", "open": "<analysis>a", "none": None}
        return [answers[p.split("<begin_text>")[1].split("<end_text>")[0].split()[0]] for p in prompts]


def positions(spark, *texts):
    return spark.createDataFrame([(f"d{i}", 51 + i, t) for i, t in enumerate(texts)], SCHEMA)


def test_drop_reasons_and_kept_rows(spark):
    rows = positions(spark, "good 1", "thin", "open", "none")
    attempts = L.attempt_labels(rows, Scripted())
    kept = L.attach_labels(rows, attempts).collect()
    assert [(r["doc_id"], r["api_explanation"]) for r in kept] == [("d0", "a\n\nb")]
    reasons = {r["text"]: r["drop_reason"] for r in L.audit(rows, attempts).collect()}
    assert reasons == {
        "good 1": None,
        "thin": "too few features (1 < 2)",
        "open": "extract pattern did not match",
        "none": "provider returned None (retries exhausted)",
    }
    assert {r["status"]: r["n"] for r in L.outcome_counts(attempts).collect()} == {"ok": 3, "retries exhausted": 1}


def test_all_dropped_is_an_error(spark):
    explained = L.label(positions(spark, "thin", "none"), Scripted())
    with pytest.raises(DataCheckError):
        L.check_some_kept(explained)


def test_completion_count_is_checked(spark):
    with pytest.raises(Exception, match="completions for"):
        L.label(positions(spark, "good", "thin"), TooFew()).collect()


def test_unknown_provider(spark):
    with pytest.raises(ValueError):
        L.label(positions(spark, "good"), "nobody")


def test_cached_texts_never_reach_the_provider(spark):
    rows = positions(spark, "good 1", "good 2")
    cache = LC.cache_from_explained(L.label(rows, Scripted()))
    again = L.label(rows, Forbidden(), cache)
    assert again.count() == 2


def test_feature_rule_applies_to_cache_hits(spark):
    rows = positions(spark, "good 1")
    thin = spark.createDataFrame([("only one",)], "explanation string").select(
        F.sha2(F.lit("good 1"), 256).alias("text_sha256"), "explanation"
    )
    assert L.label(rows, Forbidden(), thin).count() == 0


def test_one_text_in_a_third_of_all_rows_is_asked_once_and_lost_nowhere(spark):
    rows = spark.range(3000).select(
        F.concat(F.lit("d"), "id").alias("doc_id"),
        (F.col("id") % 100).alias("n_raw_tokens"),
        F.when(F.col("id") % 3 == 0, F.lit("good copy")).otherwise(F.concat(F.lit("good "), "id")).alias("detokenized_text_truncated"),
    )
    attempts = L.attempt_labels(rows, Scripted())
    assert attempts.count() == 2001
    assert L.attach_labels(rows, attempts).count() == 3000


def test_labelling_twice_asks_nothing(spark):
    path = new_table_path(spark, "test-labels")
    rows = positions(spark, "good 1", "good 2", "thin")
    assert L.label_into(spark, rows, path, Scripted()) == {"explained": 2, "dropped": 1}
    assert L.label_into(spark, rows, path, Forbidden()) == {"explained": 0, "dropped": 0}
    grown = positions(spark, "good 1", "good 2", "thin", "good 3")
    assert L.label_into(spark, grown, path, Scripted(), slices=3) == {"explained": 1, "dropped": 0}
    assert L.label_into(spark, grown, path, Scripted(), retry_dropped=True) == {"explained": 0, "dropped": 1}
    assert spark.read.parquet(f"{path}/explained").count() == 3


def test_a_job_that_drops_everything_stops_and_keeps_its_audit(spark):
    path = new_table_path(spark, "test-labels")
    with pytest.raises(DataCheckError):
        L.label_into(spark, positions(spark, "thin"), path, Scripted())
    assert spark.read.parquet(f"{path}/audit").filter("dropped").count() == 1
    other = new_table_path(spark, "test-labels")
    assert L.label_into(spark, positions(spark, "thin"), other, Scripted(), require_kept=False) == {"explained": 0, "dropped": 1}


@pytest.mark.parametrize("indent", [None, 2])
def test_json_cache_without_meta(spark, tmp_path, indent):
    key, other = "a" * 64, "b" * 64
    text = 'line "quoted"\n\nsecond, {brace}'
    path = tmp_path / "cache.json"
    path.write_text(
        json.dumps({"_meta": {"num_entries": 2, "description": "x"}, key: text, other: "plain ü"}, ensure_ascii=False, indent=indent)
    )
    got = {r["text_sha256"]: r["explanation"] for r in LC.cache_from_json(spark, str(path)).collect()}
    assert got == {key: text, other: "plain ü"}


def test_export_then_load(spark):
    cache = spark.createDataFrame([("a" * 64, "old"), ("b" * 64, "kept")], "text_sha256 string, explanation string")
    new = spark.createDataFrame([("a" * 64, "new\nline")], "text_sha256 string, explanation string")
    path = new_table_path(spark, "test-cache")
    assert LC.export_cache(cache, path, new, "f1", "tok") == 2
    got = {r[0]: r[1] for r in LC.cache_from_json(spark, path).collect()}
    assert got == {"a" * 64: "new\nline", "b" * 64: "kept"}
    meta = SC.read_json(spark, f"{path}_meta.json")
    assert meta["num_entries"] == 2 and meta["tokenizer_fingerprint"] == "f1" and meta["tokenizer_name"] == "tok"


def test_fingerprints(spark):
    def fingerprint(*texts):
        tokens = with_tokens(spark.createDataFrame([(t,) for t in texts], "text string"))
        vocab = tokens.select(F.explode("tokens").alias("token")).distinct()
        return VOC.vocabulary_fingerprint(vocab).first()["fingerprint"]

    assert fingerprint("a b", "c") == fingerprint("c", "a b b")
    assert fingerprint("a b") != fingerprint("a c")
    path = new_table_path(spark, "test-meta")
    assert VOC.check_fingerprint(spark, path, "one", "tok") is True
    assert VOC.check_fingerprint(spark, path, "one", "tok") is False
    with pytest.raises(DataCheckError):
        VOC.check_fingerprint(spark, path, "two", "tok")
    with pytest.raises(DataCheckError):
        VOC.require_fingerprint({}, "one")
    assert VOC.require_fingerprint({VOC.META_FINGERPRINT: "one"}, "two") is False


def test_fingerprint_tag_survives_parquet_and_labelling(spark):
    path = new_table_path(spark, "test-tagged")
    VOC.tag_fingerprint(positions(spark, "good 1"), "f1", "blanks").write.parquet(path)
    rows = spark.read.parquet(path)
    explained_path = new_table_path(spark, "test-tagged")
    L.label(rows, Scripted()).write.parquet(explained_path)
    tag = VOC.table_fingerprint(spark.read.parquet(explained_path))
    assert tag == {VOC.META_FINGERPRINT: "f1", VOC.META_NAME: "blanks"}
    assert VOC.require_fingerprint(tag, "f1")
    assert VOC.table_fingerprint(positions(spark, "good 1")) == {}


def test_only_texts_that_come_again_meet(spark, monkeypatch):
    rows = positions(spark, *[f"good {k}" for k in range(50)], "good copy", "good copy", "thin", "none", "none", None)
    met, attempt = [], L.attempt_labels

    def noted(some, *rest):
        met.extend(r[L.TEXT] for r in some.collect())
        return attempt(some, *rest)

    monkeypatch.setattr(L, "attempt_labels", noted)
    out = L.answer_rows(rows.filter(f"{L.TEXT} is not null"), Scripted(), text=False)
    assert sorted(met) == ["good copy", "good copy", "none", "none"]
    assert L.TEXT not in out.columns and out.count() == 55
    assert {r["status"]: r["count"] for r in out.groupBy("status").count().collect()} == {"ok": 53, "retries exhausted": 2}
    assert L.label(rows.filter(f"{L.TEXT} is not null"), Scripted(), text=False).columns == ["doc_id", "n_raw_tokens", "text_sha256", "api_explanation"]


class Noted(Scripted):
    """Keeps a line for every prompt it is asked."""

    def __init__(self, path):
        self.path = path

    def complete(self, prompts):
        with open(self.path, "a") as f:
            f.writelines(p.split("<begin_text>")[1].split("<end_text>")[0].strip() + "\n" for p in prompts)
        return super().complete(prompts)


@pytest.mark.parametrize("slices", [1, 2])
def test_stored_positions_are_written_only_into_the_two_tables(spark, monkeypatch, tmp_path, slices):
    texts = [f"good {k}" for k in range(40)] + ["good copy", "good copy", "thin", "none", "none"]
    rows = L.materialize(positions(spark, *texts), "test-positions")
    path, asked = new_table_path(spark, "test-labels"), tmp_path / "asked"
    written, write = [], L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, name: (written.append((name, df.columns)), write(df, name))[1])
    assert L.label_into(spark, rows.filter("n_raw_tokens % 3 = 0"), path, Noted(str(asked)), stored=True) == {"explained": 14, "dropped": 1}
    assert L.label_into(spark, rows, path, Noted(str(asked)), slices=slices, stored=True) == {"explained": 28, "dropped": 2}
    assert written and not any({L.TEXT, "text"} & set(columns) for _, columns in written), written
    lines = asked.read_text().splitlines()
    again = [t for k, t in enumerate(texts) if (51 + k) % 3 == 0 and t in ("good copy", "none")]
    assert sorted(lines) == sorted([*set(texts), *again])  # a text of both jobs is asked by both
    explained, audit = L.labelled(spark, path), L.audited(spark, path)
    assert explained.columns == [*rows.columns, "api_explanation"] and explained.filter("api_explanation = 'a\n\nb'").count() == 42
    assert sorted(r["text"] for r in audit.collect()) == sorted(texts) and audit.filter("dropped").count() == 3
    assert sorted(map(tuple, explained.select(*rows.columns).collect())) == sorted(map(tuple, rows.filter(f"{L.TEXT} like 'good%'").collect()))


def test_rows_with_more_columns_keep_them(spark):
    rows = L.materialize(positions(spark, "good 1", "good 2", "thin").withColumn("more", F.col("n_raw_tokens") * 2), "test-positions")
    path = new_table_path(spark, "test-labels")
    assert L.label_into(spark, rows, path, Scripted(), stored=True) == {"explained": 2, "dropped": 1}
    assert sorted((r["n_raw_tokens"], r["more"]) for r in L.labelled(spark, path).collect()) == [(51, 102), (52, 104)]
    assert "more" not in L.audited(spark, path).columns


@pytest.mark.parametrize("words", [64, 1 << 18])
def test_a_full_sketch_drops_no_open_row(spark, monkeypatch, words):
    """With few words nearly every key passes by chance: rows are told apart by their keys, those with a null are open."""
    monkeypatch.setattr(L, "words_for", lambda n: words)
    data = [(f"d{k % 300}", k, f"text {k}") for k in range(900)] + [("d1", 1, "the same key"), (None, 3, "no document"), ("d7", None, "no place")]
    rows = spark.createDataFrame(data, SCHEMA)
    done = rows.filter("n_raw_tokens % 2 = 1 or n_raw_tokens is null")
    got = sorted(r[L.TEXT] for r in L.skip_finished(rows, done, sketched=True).collect())
    assert got == sorted([f"text {k}" for k in range(0, 900, 2)] + ["no document", "no place"])


def test_finished_rows_behind_a_sketch(spark):
    rows = positions(spark, *[f"good {k}" for k in range(60)])
    done = rows.filter("n_raw_tokens % 3 = 0"), rows.filter("n_raw_tokens % 5 = 0")
    plain, sketched = (sorted(map(tuple, L.skip_finished(rows, *done, sketched=s).collect())) for s in (False, True))
    assert sketched == plain and len(plain) == rows.filter("n_raw_tokens % 3 <> 0 and n_raw_tokens % 5 <> 0").count()
