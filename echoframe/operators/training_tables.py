"""Training tables: explained rows joined with vectors and formatted per split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from echoframe.functions import constants as C
from echoframe.functions import text as T
from echoframe.operators.joins import join_vectors
from echoframe.operators.labelling import KEYS
from echoframe.operators.positions import DataCheckError
from echoframe.operators.sampling import SPLITS
from echoframe.sources import tables
from echoframe.sources.sidecar import write_sidecar

SCHEMAS = {"av_sft": tables.AV_SFT, "ar_sft": tables.AR_SFT, "rl": tables.RL}


def tail_violations(prompts: DataFrame, template: str = C.CRITIC_TEMPLATE, prompt: str = "prompt") -> DataFrame:
    """Prompts seen, and prompts whose last tokens are not those of the template."""
    suffix = T.template_suffix_tokens(template, "{explanation}")
    ok = T.tail_matches(T.tokenize(prompt, None), suffix)
    return prompts.agg(F.count(F.lit(1)).alias("n_prompts"), F.count_if(~ok).alias("n_bad_tails"))


def training_rows(
    explained: DataFrame,
    vectors: DataFrame,
    split: str,
    strict: bool = True,
    check: bool = True,
    actor_template: str = C.ACTOR_TEMPLATE,
    critic_template: str = C.CRITIC_TEMPLATE,
) -> DataFrame:
    """Rows of one training table, ``activation_layer`` included."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}, expected one of {SPLITS}")
    joined = join_vectors(explained, vectors, strict, check)
    keep = ["activation_vector", *KEYS, "activation_layer"]
    if split == "av_sft":
        return joined.select(
            T.actor_prompt(actor_template).alias("prompt"), T.wrap_explanation("api_explanation").alias("response"), *keep
        )
    if split == "ar_sft":
        return joined.select(T.critic_prompt("api_explanation", critic_template).alias("prompt"), *keep)
    return joined.select(T.actor_prompt(actor_template).alias("prompt"), *keep)


def build_training(
    explained: DataFrame,
    vectors: DataFrame,
    split: str,
    path: str,
    strict: bool = True,
    marker: dict | None = None,
    injection_scale: float | str | None = None,
    corpus: str | None = None,
    **templates: str,
) -> dict:
    """Write a training table and its sidecar; returns the sidecar.

    Row count, vector width and prompt tails are observed while the table is
    written. A violation raises before the sidecar exists, and a table without
    sidecar is not valid.
    """
    spark: SparkSession = explained.sparkSession
    rows = training_rows(explained, vectors, split, strict, **templates)
    suffix = None
    bad_tail = F.lit(False)
    if split == "ar_sft":
        suffix = T.template_suffix_tokens(templates.get("critic_template", C.CRITIC_TEMPLATE), "{explanation}")
        bad_tail = ~T.tail_matches(T.tokenize("prompt", None), suffix)
    seen = Observation()
    width = F.size("activation_vector")
    observed = rows.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.min(width).alias("narrow"),
        F.max(width).alias("wide"),
        F.coalesce(F.sum(bad_tail.cast("int")), F.lit(0)).alias("bad_tails"),
    )
    tables.conform(observed, SCHEMAS[split]).write.mode("overwrite").parquet(path)
    m = seen.get
    if m["rows"] and m["narrow"] != m["wide"]:
        raise DataCheckError(f"vector lengths differ: {m['narrow']} to {m['wide']}")
    if m["bad_tails"]:
        raise DataCheckError(f"{m['bad_tails']} prompts do not end with {suffix}")
    return write_sidecar(
        spark, path, split, m["rows"], m["wide"] or 0, marker=marker, injection_scale=injection_scale, critic_suffix=suffix, corpus=corpus, **templates
    )


#: Parts of a conversation in which tokens are first summed.
PARTS = 64


def opening_turns(messages: DataFrame, max_length: int) -> DataFrame:
    """Turns that begin within the first ``max_length`` rendered tokens of their conversation; all turns of a short one.

    A rendered turn begins with a visible sign and ends in a blank, so tokens of
    turns add up. They are summed in parts of a conversation first: what is too
    late in its part is too late in the whole, and only the few turns where parts
    pass the length meet. Texts are not moved for it.
    """
    one = F.array(F.struct("role", F.col("text").alias("content")))
    sized = messages.filter("conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.size(T.tokenize(T.render_chat(one, add_generation_prompt=False), max_length)).alias("n")
    )
    earlier = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sized.groupBy("conv_id", F.pmod(F.xxhash64("turn"), F.lit(PARTS)).alias("part"), "turn").agg(F.sum("n").alias("n"))
    reached = parts.withColumn("before", earlier("conv_id", "part")).filter(F.col("before") < max_length)
    reached = reached.groupBy("conv_id", "turn").agg(F.sum("n").alias("n")).withColumn("upto", earlier("conv_id") + F.col("n"))
    ends = reached.filter(F.col("upto") >= max_length).groupBy("conv_id").agg(F.min("turn").alias("end"))
    return messages.join(ends, "conv_id", "left").filter(F.col("end").isNull() | (F.col("turn") <= F.col("end"))).drop("end")


def conversation_rows(messages: DataFrame, max_length: int | None = None) -> DataFrame:
    """Prompt and response pairs: each assistant turn with all turns before it, the system message included.

    A row is as long as its history, whatever the plan; where only the first
    ``max_length`` tokens are wanted, turns that begin behind them are left out.
    Answers meet earlier turns in a join that adaptive execution splits, and are
    gathered per answer, so a very long conversation is not one task. An answer
    without earlier turns has an empty prompt.
    """
    answers = messages.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("response"))
    turn = F.struct(F.col("turn").alias("at"), "role", F.col("text").alias("content"))
    history = messages if max_length is None else opening_turns(messages, max_length)
    before = history.select(F.col("conv_id").alias("p_conv"), turn.alias("said"))
    pairs = answers.join(before, (F.col("conv_id") == F.col("p_conv")) & (F.col("said.at") < F.col("turn")), "left")
    return pairs.groupBy("conv_id", "turn", "response").agg(F.array_sort(F.collect_list("said")).alias("said")).select(
        "conv_id",
        "turn",
        F.transform("said", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("prompt"),
        "response",
    )


def training_text(rows: DataFrame, max_length: int | None = C.MAX_LENGTH) -> DataFrame:
    """Add ``tokens`` of the rendered prompt plus response and ``prompt_len`` in tokens."""
    rendered = T.render_chat("prompt")
    return rows.withColumn("tokens", T.tokenize(F.concat(rendered, "response"), max_length)).withColumn(
        "prompt_len", F.size(T.tokenize(rendered, max_length)).cast("bigint")
    )
