"""Rewards, group-relative advantages and the terms of a policy step, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoframe.functions import constants as C
from echoframe.functions.vectors import SQRT_D, Scale, score
from echoframe.operators.sampling import natural_rank
from echoframe.session import materialize


def add_rewards(
    rollouts: DataFrame, pred: str = "pred", gold: str = "gold", scale: Scale = SQRT_D, width: int | None = None
) -> DataFrame:
    """Add ``reward``: minus the normalised error, the floor where extraction failed (NULL prediction)."""
    error = score(pred, gold, scale, width)["mse"]
    return rollouts.withColumn("reward", F.coalesce(-error, F.lit(C.FAILED_EXTRACTION_REWARD)))


def group_statistics(rewards: DataFrame, group: str = "prompt_id") -> DataFrame:
    """Mean, sample deviation and size per group, combined map-side."""
    return rewards.groupBy(group).agg(
        F.avg("reward").alias("mean_reward"),
        F.stddev_samp("reward").alias("std_reward"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def add_advantages(rewards: DataFrame, group: str = "prompt_id", stored: bool = False) -> DataFrame:
    """Add ``advantage``: reward against its group, in floored sample deviations.

    Statistics are aggregated and joined back instead of a window, so a group of
    any size is never gathered in one task. A group of one has no deviation and
    is an error. Statistics and rows both read the scores, which are written
    first unless they are ``stored`` already.
    """
    rewards = rewards if stored else materialize(rewards, "rewards")
    stats = group_statistics(rewards, group)
    single = F.raise_error(F.lit("group-relative advantages need at least two samples per group"))
    spread = F.greatest("std_reward", F.lit(C.ADVANTAGE_STD_FLOOR))
    advantage = F.when(F.col("n_samples") < 2, single.cast("double")).otherwise(
        (F.col("reward") - F.col("mean_reward")) / spread
    )
    return rewards.join(stats, group).withColumn("advantage", advantage).drop("mean_reward", "std_reward", "n_samples")


def sequence_terms(
    tokens: DataFrame, kl: str = "per_seq", response_only: bool = False, seq: str | Sequence[str] = "seq_id"
) -> DataFrame:
    """Per sequence: ``seq_logp`` and ``kl_penalty``, in one aggregation over its tokens.

    ``per_token`` is the mean squared difference of policy and frozen log-probs,
    ``per_seq`` the squared difference of their sums. ``response_only`` leaves
    out positions before ``prompt_len``.
    """
    if kl not in ("per_token", "per_seq"):
        raise ValueError(f"unknown kl {kl!r}, expected per_token or per_seq")
    if response_only:
        tokens = tokens.filter(F.col("pos") >= F.col("prompt_len"))
    diff = F.col("logp") - F.col("ref_logp")
    penalty = F.avg(diff * diff) if kl == "per_token" else F.pow(F.sum("logp") - F.sum("ref_logp"), F.lit(2.0))
    keys = [seq] if isinstance(seq, str) else list(seq)
    return tokens.groupBy(*keys).agg(F.sum("logp").alias("seq_logp"), penalty.alias("kl_penalty"))


def policy_loss_term(kl_coef: float = C.KL_COEF) -> Column:
    return -(F.col("advantage") * F.col("seq_logp")) + F.lit(kl_coef) * F.col("kl_penalty")


def policy_loss(advantages: DataFrame, terms: DataFrame, kl_coef: float = C.KL_COEF, seq: str = "seq_id") -> DataFrame:
    """Mean loss over all rollouts."""
    return advantages.join(terms, seq).agg(
        F.avg(policy_loss_term(kl_coef)).alias("policy_loss"), F.count(F.lit(1)).alias("n_rollouts")
    )


def mean_reward_by_step(rewards: DataFrame, step: str = "step") -> DataFrame:
    return rewards.groupBy(step).agg(F.avg("reward").alias("mean_reward"))


def critic_loss(rollouts: DataFrame, pred: str = "pred", gold: str = "gold", scale: Scale = SQRT_D, width: int | None = None) -> DataFrame:
    """Mean normalised error over rows with a prediction, and their number."""
    error = score(pred, gold, scale, width)["mse"]
    valid = F.col(pred).isNotNull()
    return rollouts.filter(valid).agg(F.avg(error).alias("critic_loss"), F.count(F.lit(1)).alias("n_valid"))


def grpo_report(
    rollouts: DataFrame,
    tokens: DataFrame,
    kl: str = "per_seq",
    kl_coef: float = C.KL_COEF,
    scale: Scale = SQRT_D,
    width: int | None = None,
    response_only: bool = False,
) -> DataFrame:
    """Per step: mean reward, failed share, policy loss, critic loss.

    ``rollouts``: ``step, prompt_id, seq_id, pred, gold``; ``tokens``: ``seq_id,
    pos, logp, ref_logp``. Vectors are read and scored once; the scores are
    written, and the group statistics and joins work on those few numbers.
    """
    error = score("pred", "gold", scale, width)["mse"]
    scored = rollouts.select("step", "prompt_id", "seq_id", error.alias("mse")).withColumn(
        "reward", F.coalesce(-F.col("mse"), F.lit(C.FAILED_EXTRACTION_REWARD))
    )
    terms = sequence_terms(tokens, kl, response_only)
    full = add_advantages(materialize(scored, "scored-rollouts"), stored=True).join(terms, "seq_id")
    return full.groupBy("step").agg(
        F.count(F.lit(1)).alias("n_rollouts"),
        F.avg("reward").alias("mean_reward"),
        F.avg(F.col("mse").isNull().cast("double")).alias("failed_share"),
        F.avg(policy_loss_term(kl_coef)).alias("policy_loss"),
        F.avg("mse").alias("critic_loss"),
    )


def equal_shards(df: DataFrame, shard: str, num_shards: int, keys: Sequence[str]) -> DataFrame:
    """Cut every shard to the smallest one; nothing is left when a shard is empty.

    The rank inside a shard is the global rank less the rows of the shards
    before it, so a shard much larger than the rest is still spread out.
    """
    counts = {r[shard]: r["count"] for r in df.groupBy(shard).count().collect()}
    smallest = min(counts.get(s, 0) for s in range(num_shards))
    offsets, before = [], 0
    for s in sorted(counts):
        offsets.append((s, before))
        before += counts[s]
    kind = dict(df.dtypes)[shard]
    table = df.sparkSession.createDataFrame(offsets, f"`{shard}` {kind}, _before bigint")  # one row per shard
    ranked = natural_rank(df, [shard, *keys], "_rank").join(F.broadcast(table), shard)
    return ranked.filter(F.col("_rank") - F.col("_before") < smallest).select(*df.columns)


def identical_share(left: DataFrame, right: DataFrame, key: str | Sequence[str], value: str) -> DataFrame:
    """Share of ids with the same output on both sides; NULL equals NULL."""
    keys = [key] if isinstance(key, str) else list(key)
    pairs = left.select(*keys, F.col(value).alias("a")).join(right.select(*keys, F.col(value).alias("b")), keys)
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(F.col("a").eqNullSafe(F.col("b")).cast("double")).alias("identical_share")
    )


# ---- losses -----------------------------------------------------------------


def next_token_losses(tokens: DataFrame) -> DataFrame:
    """Per position: cross-entropy of the next label and the next mask.

    ``tokens``: ``seq_id, pos, logits, label`` and optionally ``mask``. The label
    is shifted by an equi-join on (seq_id, pos); its keys are unique, so even a
    sequence that dominates the table spreads evenly. Ignored labels give 0.
    """
    from echoframe.functions.vectors import token_logprob

    mask = F.col("mask") if "mask" in tokens.columns else F.lit(1.0)
    following = tokens.select("seq_id", (F.col("pos") - 1).alias("pos"), F.col("label").alias("target"), mask.alias("target_mask"))
    ignored = F.col("target") == C.IGNORED_LABEL
    safe = F.when(ignored, F.lit(0)).otherwise(F.col("target"))
    return (
        tokens.select("seq_id", "pos", "logits")
        .join(following, ["seq_id", "pos"])
        .select("seq_id", "pos", "target", "target_mask", F.when(ignored, F.lit(0.0)).otherwise(-token_logprob("logits", safe)).alias("loss"))
    )


def masked_mean(loss: Column, mask: Column) -> Column:
    return F.sum(loss * mask) / F.greatest(F.sum(mask), F.lit(1.0))


def cross_entropy(tokens: DataFrame, ignore_masked: bool = False) -> DataFrame:
    """Next-token cross-entropy of the whole table.

    With a mask: sum(loss * mask) / max(sum(mask), 1). Without: the plain mean,
    ignored positions counted as zeros unless ``ignore_masked``.
    """
    losses = next_token_losses(tokens)
    if "mask" in tokens.columns:
        value = masked_mean(F.col("loss"), F.col("target_mask"))
    elif ignore_masked:
        used = (F.col("target") != C.IGNORED_LABEL).cast("double")
        value = masked_mean(F.col("loss"), used)
    else:
        value = F.avg("loss")
    return losses.agg(value.alias("loss"), F.count(F.lit(1)).alias("n_positions"))


def mean_of_batch_means(losses: DataFrame, batch: str = "batch", loss: str = "loss") -> DataFrame:
    """Every batch weighs the same, however many rows it has."""
    return losses.groupBy(batch).agg(F.avg(loss).alias("m")).agg(F.avg("m").alias("loss"), F.count("m").alias("n_batches"))


def optimizer_step_losses(micro: DataFrame, accumulation: int, index: str = "micro", loss: str = "loss") -> DataFrame:
    """Loss per optimizer step: the sum over its micro-batches."""
    return micro.groupBy(F.expr(f"`{index}` div {int(accumulation)}").alias("step")).agg(F.sum(loss).alias("step_loss"))


def mean_step_loss(micro: DataFrame, accumulation: int, index: str = "micro", loss: str = "loss") -> DataFrame:
    steps = optimizer_step_losses(micro, accumulation, index, loss)
    return steps.agg(F.avg("step_loss").alias("loss"), F.count(F.lit(1)).alias("n_steps"))
