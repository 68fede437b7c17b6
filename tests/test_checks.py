"""Fixed values, inputs that must be refused, and inputs that must be evaluated once."""

import hashlib

import pytest
from pyspark.sql import functions as F

from echoframe.functions import constants as C
from echoframe.functions import vectors as V
from echoframe.operators import injection, policy, sampling
from echoframe.operators import training_tables as TT
from echoframe.operators.inference import OfflineProvider
from echoframe.operators.positions import DataCheckError
from echoframe.session import new_table_path
from echoframe.sources import label_cache
from echoframe.sources import sidecar as SC


@pytest.mark.parametrize(
    "name, length, digest",
    [
        ("ACTOR_TEMPLATE", 520, "054c09450507a3d83355aea8bf591d5ecca9cdd0a2c10a90efe0394273b62d75"),
        ("CRITIC_TEMPLATE", 67, "b2244f6d1bb9ff5a57641b179472abbfdb2a27a80c2c124e5646708e1936bc9d"),
        ("INSTRUCTION_TEMPLATE", 1727, "f68ab7385b6e6ea09eac4b58c92db63170c71f5d41c2ea925dc42cf21f246bc3"),
    ],
)
def test_templates_are_whole(name, length, digest):
    text = getattr(C, name)
    assert (len(text), hashlib.sha256(text.encode()).hexdigest()) == (length, digest)


@pytest.mark.parametrize("width", [None, 1000])
def test_unequal_lengths_are_an_error(spark, width):
    rows = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0, 3.0])], "pred array<double>, gold array<double>")
    with pytest.raises(Exception, match="lengths|width|reshape|broadcast|shape|length"):
        policy.add_rewards(rows, width=width).collect()
    fine = spark.createDataFrame([(None, [1.0, 2.0])], "pred array<double>, gold array<double>")
    assert policy.add_rewards(fine, width=width).first()["reward"] == C.FAILED_EXTRACTION_REWARD
    for value in (V.mse("pred", "gold"), V.mse("pred", "gold", None), V.cosine("pred", "gold")):
        with pytest.raises(Exception, match="lengths differ"):
            rows.select(value).collect()


def test_injection_needs_dense_indices(spark):
    tokens = spark.createDataFrame([(1, p, t, [0.0]) for p, t in enumerate([4, 5, 6, 4, 5, 6])], "seq_id long, pos long, token_id long, embedding array<double>")
    for ids in ((1, 2), (0, 0), (-1, 0)):
        with pytest.raises(DataCheckError, match="vec_idx"):
            injection.inject_vectors(tokens, spark.createDataFrame([(i, [1.0]) for i in ids], "vec_idx long, vector array<double>"), 5, 4, 6)
    out = injection.inject_vectors(tokens, spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_idx long, vector array<double>"), 5, 4, 6)
    assert out.filter("injected").count() == 2


def test_repeated_keys_end_with_an_error(spark):
    hashes = spark.range(5000).select(F.sha2((F.col("id") % 2).cast("string"), 256).alias("h"))
    with pytest.raises(DataCheckError, match="repeat"):
        sampling.hash_cuts(hashes, lambda n: [1000])
    with pytest.raises(DataCheckError, match="repeat"):
        sampling.hash_cuts(hashes.limit(40), lambda n: [3])


def test_damaged_cache_is_an_error(spark):
    key, path = "ab" * 32, new_table_path(spark, "cache")
    good = ["{", '  "_meta": {', '    "n": 2,', '    "by": "x"', "  },", f'  "{key}": "text",', f'  "{"cd" * 32}": "more"', "}", ""]
    spark.createDataFrame([(x,) for x in good], "value string").coalesce(1).write.text(path)
    assert label_cache.cache_from_json(spark, path).count() == 2
    for broken in (f'  "{key}": "text cut', f'  "{key[:20]}', "no entry"):
        path = new_table_path(spark, "cache")
        spark.createDataFrame([(x,) for x in [*good[:5], broken]], "value string").coalesce(1).write.text(path)
        with pytest.raises(Exception, match="unreadable line"):
            label_cache.cache_from_json(spark, path).collect()


def test_many_shards(spark):
    docs = spark.range(20_000).select(F.format_string("d%06d", "id").alias("doc_id"))
    got = {r["shard_id"]: r["count"] for r in sampling.range_shards(docs, 5000).groupBy("shard_id").count().collect()}
    assert got == {s: 4 for s in range(5000)}
    rows = spark.range(15_000).select(F.col("id").alias("k"), (F.col("id") % 5000).cast("int").alias("s"))
    assert policy.equal_shards(rows.filter("k <> 7"), "s", 5000, ["k"]).count() == 10_000


def test_sidecar_has_the_templates_in_use(spark):
    explained = spark.createDataFrame([("d1", 51, "text", "why")], "doc_id string, n_raw_tokens long, detokenized_text_truncated string, api_explanation string")
    vectors = spark.createDataFrame([("d1", 51, [1.0, 2.0], 0)], "doc_id string, n_raw_tokens long, activation_vector array<float>, activation_layer long")
    actor, critic = "Look: " + C.INJECT_PLACEHOLDER + " {injection_char}", "Sum <t>{explanation}</t> now then"
    for split in ("ar_sft", "rl"):
        meta = TT.build_training(explained, vectors, split, path := new_table_path(spark, "t"), corpus="web", actor_template=actor, critic_template=critic)
        assert meta == SC.read_sidecar(spark, path) and meta["extraction"]["corpus"] == "web"
        assert meta["prompt_templates"] == {"actor": actor} | ({"critic": critic} if split == "ar_sft" else {})


def test_provider_keeps_text_with_its_own_tags():
    text = "start of it <begin_text> and the end"
    ((answer, _),) = OfflineProvider().outcomes([C.INSTRUCTION_TEMPLATE.replace("{text}", text)])
    assert "opens with: start of it" in answer


def test_ranking_evaluates_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(1000).mapInPandas(count, "id long")
    assert sampling.natural_rank(rows, ["id"]).count() == 1000 and seen.value == 1000
    rewards = spark.range(1000).selectExpr("id", "id % 10 AS prompt_id", "id * 0.5D AS reward").mapInPandas(count, "id long, prompt_id long, reward double")
    assert policy.add_advantages(rewards).count() == 1000 and seen.value == 2000
    docs = spark.range(1000).selectExpr("cast(id AS string) AS doc_id").mapInPandas(count, "doc_id string")
    sampling.hash_cuts(docs.select(F.sha2("doc_id", 256).alias("h")), lambda n: [10, 500])
    assert seen.value == 3000


def test_conversations_keep_their_history(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 4, "assistant", "d"), (2, 0, "assistant", "alone")]
    got = {(r["conv_id"], r["turn"]): ([m["content"] for m in r["prompt"]], r["response"]) for r in TT.conversation_rows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, 2): (["s", "a"], "b"), (1, 4): (["s", "a", "b", "c"], "d"), (2, 0): ([], "alone")}


def test_histories_end_where_their_wanted_tokens_end(spark, monkeypatch):
    turns = [(c, t, "assistant" if t % 2 else "user", f"w{t} " * (t % 4)) for c in (1, 2) for t in range(40 if c == 1 else 4)]
    turns += [(1, 3, "user", "twice"), (1, None, "assistant", "x"), (None, 1, "assistant", "y"), (3, 0, "user", None), (3, 1, "assistant", "z")]
    messages = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(TT, "PARTS", 3)

    def texts(rows):
        return sorted((tuple(r) for r in TT.training_text(rows, 30).select("conv_id", "turn", "response", "tokens", "prompt_len").collect()), key=str)

    cut = TT.conversation_rows(messages, 30)
    assert texts(cut) == texts(TT.conversation_rows(messages))
    assert max(len(r["prompt"]) for r in cut.collect()) < 15
