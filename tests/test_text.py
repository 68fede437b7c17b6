import re

import pytest
from pyspark.sql import functions as F

from echoframe.functions import constants as C
from echoframe.functions import text as T


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "v string").select(build("v").alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("x<analysis> a </analysis>y<analysis>b</analysis>", "a"),
        ("<analysis>a", None),
        ("a</analysis>", None),
        ("<analysis></analysis>", ""),
        ("<analysis>\n\na\n\nb \n</analysis>", "a\n\nb"),
        (None, None),
    ],
)
def test_extract_answer(spark, raw, want):
    assert one(spark, raw, T.extract_answer) == want


def test_clean_list_markers_golden(spark):
    lines = ["- one", "2) two", "(a) three", "iv. four", "**Bold** rest", "", "*x*"]
    assert one(spark, "\n".join(lines), T.clean_list_markers) == "one\n\ntwo\n\nthree\n\nfour\n\nBold rest\n\nx"


@pytest.mark.parametrize(
    "line, want",
    [
        ("•  dot", "dot"),
        ("– dash", "dash"),
        ("　- wide", "wide"),
        ("-no blank", "-no blank"),
        ("12. twelve", "twelve"),
        ("(3) three", "three"),
        ("b) bee", "bee"),
        ("word. kept", "word. kept"),
        ("**A** and **B**", "A and **B"),
    ],
)
def test_clean_single_line(spark, line, want):
    assert one(spark, line, T.clean_list_markers) == want


def test_feature_filter(spark):
    assert one(spark, "one", T.has_enough_features) is False
    assert one(spark, "one\n\ntwo", T.has_enough_features) is True
    assert one(spark, None, T.has_enough_features) is False


@pytest.mark.parametrize(
    "response, want",
    [
        ("<explanation>\nz\n</explanation>", "z"),
        ("<explanation>a</explanation><explanation>b</explanation>", "a"),
        ("<explanation>cut", None),
        ("<explanation> x </explanation>", "x"),
    ],
)
def test_extract_explanation(spark, response, want):
    assert one(spark, response, T.extract_explanation) == want


def test_wrap_then_extract_is_identity(spark):
    assert one(spark, "a\n\nb", lambda c: T.extract_explanation(T.wrap_explanation(c))) == "a\n\nb"


def test_explanation_or_raw(spark):
    assert one(spark, "  plain ", T.explanation_or_raw) == "plain"


def test_tokens_join_back_to_the_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", T.tokenize("text", None).alias("t"))
    broken = docs.filter(F.array_join("t", "") != F.regexp_replace("text", "[ \n\t\r]+$", ""))
    assert broken.count() == 0


def test_tokenize_truncates_right(spark):
    assert one(spark, "a b c d", lambda c: T.tokenize(c, 2)) == ["a", " b"]


def test_specials_are_no_candidates_and_not_in_prefix(spark):
    tokens = F.array(*[F.lit(x) for x in ["a", "<s>", " b", "<s>", " c"]])
    row = spark.range(1).select(
        T.candidate_positions(tokens, 1, ["<s>"]).alias("c"), T.prefix_text(tokens, F.lit(4), ["<s>"]).alias("p")
    ).first()
    assert row["c"] == [2, 4]
    assert row["p"] == "a b c"


def test_prefixes_match_single_prefixes(spark):
    tokens = F.array(*[F.lit(f" w{i}") for i in range(12)])
    picks = F.array(*[F.lit(i).cast("bigint") for i in (2, 3, 9)])
    row = spark.range(1).select(T.prefixes(tokens, picks, [" w1"]).alias("r")).first()["r"]
    words = [f" w{i}" for i in range(12)]
    assert [(r[0], r[1]) for r in row] == [
        (p + 1, "".join(w for w in words[: p + 1] if w != " w1")) for p in (2, 3, 9)
    ]


def test_templates_need_their_placeholder():
    for build in (T.instruction_prompt, T.critic_prompt):
        with pytest.raises(ValueError):
            build(F.lit("x"), "no placeholder")
    with pytest.raises(ValueError):
        T.actor_prompt("none")
    with pytest.raises(ValueError):
        T.template_suffix_tokens("{explanation}x", "{explanation}")


def test_template_suffix(spark):
    suffix = T.template_suffix_tokens(C.CRITIC_TEMPLATE, "{explanation}")
    assert suffix == [" <summary>"]
    ok = one(spark, "body", lambda c: T.tail_matches(T.tokenize(T.critic_prompt(c), None), suffix))
    assert ok is True
    assert one(spark, "short", lambda c: T.tail_matches(T.tokenize(c, None), ["a", "b"])) is False


def test_inserted_text_is_not_rescanned(spark):
    assert one(spark, "{explanation}", T.critic_prompt) == C.CRITIC_TEMPLATE


def test_mask_and_slice(spark):
    df = spark.createDataFrame([([5, 6, 7, 8], 3)], "ids array<bigint>, n int")
    row = df.select(T.mask_prompt_labels("ids", "n").alias("m"), T.response_slice("ids", "n").alias("s")).first()
    assert row["m"] == [-100, -100, -100, 8]
    assert row["s"] == [8]


def test_whitespace_covers_what_python_strips():
    stripped = {chr(c) for c in range(0x110000) if not chr(c).strip()}
    assert set(C.WHITESPACE) == stripped
    assert re.match(C.WS, " ")


def test_the_prompt_length_is_computed_once_per_row(spark):
    df = spark.createDataFrame([("a b c", "a")], "whole string, prompt string")
    labels = T.mask_prompt_labels(F.transform(T.tokenize("whole"), F.length).cast("array<bigint>"), F.size(T.tokenize("prompt")))
    made = df.select(labels.alias("m"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2 and not re.search(r"lambdafunction\(CASE WHEN[^<]*<[^)]*regexp_extract_all", plan)
    assert made.first()["m"] == [-100, 2, 2]
