"""Registered queries: rollouts, rewards, policy terms, losses and marker injection."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoframe.functions import constants as C
from echoframe.functions import text as T
from echoframe.functions import vectors as V
from echoframe.operators import evaluation as E
from echoframe.operators import injection as N
from echoframe.operators import joins as J
from echoframe.operators import policy as P
from echoframe.plans.catalog import query, table, with_ctes
from echoframe.plans.vector_plans import SQL_MU, SQL_PAIRS, r6

# ---- derived inputs --------------------------------------------------------------------

# Four samples per vector; a sample mixes the vector with another one, and every
# ninth response is cut off.
SQL_ROLLOUTS = """
fanned AS (SELECT vec_id AS prompt_id, s AS sample_id, embedding AS gold, label FROM embeddings, range(4) t(s)),
rollouts AS (
  SELECT prompt_id // 64 AS step, prompt_id, sample_id, prompt_id * 4 + sample_id AS seq_id, f.label, y.label AS other_label,
    CASE WHEN (prompt_id * 4 + sample_id) % 9 = 0 THEN '<explanation>cut off'
         ELSE '<explanation>' || chr(10) || 'near ' || y.vec_id || chr(10) || '</explanation>' END AS response,
    CASE WHEN (prompt_id * 4 + sample_id) % 9 <> 0
         THEN list_transform(range(1, 65), lambda i: 0.7::DOUBLE * gold[i] + 0.3::DOUBLE * y.embedding[i]) END AS pred,
    gold::DOUBLE[] AS gold
  FROM fanned f JOIN embeddings y ON y.vec_id = (prompt_id + 1 + sample_id) % (SELECT count(*) FROM embeddings)
),
scored AS (
  SELECT *, sqrt(list_sum(list_transform(pred, lambda x: x * x))) AS np, sqrt(list_sum(list_transform(gold, lambda x: x * x))) AS ng
  FROM rollouts
),
rewarded AS (
  SELECT *, list_sum(list_transform(range(1, 65), lambda i: (pred[i] / (np / 8.0) - gold[i] / (ng / 8.0)) ** 2)) / 64 AS mse
  FROM scored
),
rewards AS (SELECT *, coalesce(-mse, -2.0) AS reward FROM rewarded)"""
SQL_ADVANTAGES = """
advantages AS (
  SELECT *, (reward - avg(reward) OVER w) / greatest(stddev_samp(reward) OVER w, 1e-8) AS advantage
  FROM rewards WINDOW w AS (PARTITION BY prompt_id)
)"""
SQL_LOGPS = """
logps AS (
  SELECT seq_id, pos, 3 AS prompt_len, -1 - ((seq_id * 31 + pos * 7) % 13) / 10.0::DOUBLE AS logp,
         -1 - ((seq_id * 31 + pos * 7 + 3) % 13) / 10.0::DOUBLE AS ref_logp
  FROM (SELECT seq_id, unnest(range(8 + seq_id % 9)) AS pos FROM rollouts)
),
terms AS (
  SELECT seq_id, sum(logp) AS seq_logp, avg((logp - ref_logp) ** 2) AS per_token, (sum(logp) - sum(ref_logp)) ** 2 AS per_seq,
         sum(logp) FILTER (pos >= prompt_len) AS response_logp
  FROM logps GROUP BY seq_id
)"""


def prompts(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("prompt_id"), F.col("embedding").alias("gold"), "label")


def rollouts(spark, sf):
    base = prompts(spark, sf)
    n = base.count()
    fanned = J.fan_out(base, C.SAMPLES_PER_PROMPT).withColumn("other", (F.col("prompt_id") + 1 + F.col("sample_id")) % n)
    others = base.select(F.col("prompt_id").alias("other"), F.col("gold").alias("other_vec"), F.col("label").alias("other_label"))
    seq = (F.col("prompt_id") * C.SAMPLES_PER_PROMPT + F.col("sample_id")).alias("seq_id")
    response = F.when(F.col("seq_id") % 9 == 0, F.lit("<explanation>cut off")).otherwise(
        T.wrap_explanation(F.concat(F.lit("near "), F.col("other").cast("string")))
    )
    mixed = F.zip_with(
        "gold", "other_vec", lambda x, y: F.lit(0.7) * x.cast("double") + F.lit(0.3) * y.cast("double")
    )
    joined = fanned.join(others, "other").select("*", seq).withColumn("response", response)
    return joined.select(
        F.expr("prompt_id div 64").alias("step"), "prompt_id", "sample_id", "seq_id", "label", "other_label", "response",
        F.when(T.extract_explanation("response").isNotNull(), mixed).alias("pred"), "gold",
    )


def logps(spark, sf):
    ids = J.fan_out(prompts(spark, sf).select("prompt_id"), C.SAMPLES_PER_PROMPT).select(
        (F.col("prompt_id") * C.SAMPLES_PER_PROMPT + F.col("sample_id")).alias("seq_id")
    )
    long = ids.select("seq_id", F.explode(F.sequence(F.lit(0), (7 + F.col("seq_id") % 9).cast("int"))).alias("pos"))

    def value(shift):
        return F.lit(-1.0) - ((F.col("seq_id") * 31 + F.col("pos") * 7 + shift) % 13) / F.lit(10.0)

    return long.select("seq_id", "pos", F.lit(3).alias("prompt_len"), value(0).alias("logp"), value(3).alias("ref_logp"))


# ---- rollouts ------------------------------------------------------------------------------


@query("j6_rollout_fan_out", """
    SELECT vec_id AS prompt_id, s::INTEGER AS sample_id, label FROM embeddings, range(4) t(s)""")
def j6(spark, sf):
    """Each prompt four times, then looked up again from its rollouts."""
    base = prompts(spark, sf).select("prompt_id", "label")
    fanned = J.fan_out(base.select("prompt_id"), C.SAMPLES_PER_PROMPT)
    return J.attach_parent(fanned, base)


@query("l9_rewards", with_ctes(SQL_ROLLOUTS, select="SELECT seq_id, round(reward, 6) AS reward FROM rewards"))
def l9(spark, sf):
    return P.add_rewards(rollouts(spark, sf)).select("seq_id", r6("reward").alias("reward"))


@query("r6_advantages", with_ctes(SQL_ROLLOUTS, SQL_ADVANTAGES, select="SELECT seq_id, round(advantage, 6) AS advantage FROM advantages"))
def r6_advantages(spark, sf):
    scored = P.add_rewards(rollouts(spark, sf)).select("prompt_id", "seq_id", "reward")
    return P.add_advantages(scored).select("seq_id", r6("advantage").alias("advantage"))


@query("a11_mean_reward", with_ctes(SQL_ROLLOUTS, select="SELECT step, round(avg(reward), 6) AS mean_reward FROM rewards GROUP BY step"))
def a11(spark, sf):
    means = P.mean_reward_by_step(P.add_rewards(rollouts(spark, sf)))
    return means.select("step", r6("mean_reward").alias("mean_reward"))


@query("a14_sequence_logprob", with_ctes(SQL_ROLLOUTS, SQL_LOGPS, select="""
    SELECT seq_id, round(seq_logp, 6) AS seq_logp, round(response_logp, 6) AS response_logp FROM terms"""))
def a14(spark, sf):
    tokens = logps(spark, sf)
    whole = P.sequence_terms(tokens).select("seq_id", r6("seq_logp").alias("seq_logp"))
    part = P.sequence_terms(tokens, response_only=True).select("seq_id", r6("seq_logp").alias("response_logp"))
    return whole.join(part, "seq_id")


@query("a15_kl_penalty", with_ctes(SQL_ROLLOUTS, SQL_LOGPS, select="""
    SELECT seq_id, round(per_token, 6) AS per_token, round(per_seq, 6) AS per_seq FROM terms"""))
def a15(spark, sf):
    tokens = logps(spark, sf)
    by_token = P.sequence_terms(tokens, "per_token").select("seq_id", r6("kl_penalty").alias("per_token"))
    return by_token.join(P.sequence_terms(tokens, "per_seq").select("seq_id", r6("kl_penalty").alias("per_seq")), "seq_id")


@query("a16_policy_loss", with_ctes(SQL_ROLLOUTS, SQL_ADVANTAGES, SQL_LOGPS, select="""
    SELECT round(avg(-(advantage * seq_logp) + 0.01 * per_seq), 6) AS policy_loss, count(*) AS n_rollouts
    FROM advantages JOIN terms USING (seq_id)"""))
def a16(spark, sf):
    scored = P.add_rewards(rollouts(spark, sf)).select("prompt_id", "seq_id", "reward")
    loss = P.policy_loss(P.add_advantages(scored), P.sequence_terms(logps(spark, sf)))
    return loss.select(r6("policy_loss").alias("policy_loss"), "n_rollouts")


@query("l10_grpo_report", with_ctes(SQL_ROLLOUTS, SQL_ADVANTAGES, SQL_LOGPS, select="""
    SELECT step, count(*) AS n_rollouts, round(avg(reward), 6) AS mean_reward, round(avg((mse IS NULL)::INT), 6) AS failed_share,
           round(avg(-(advantage * seq_logp) + 0.01 * per_seq), 6) AS policy_loss, round(avg(mse), 6) AS critic_loss
    FROM advantages JOIN terms USING (seq_id) GROUP BY step"""))
def l10(spark, sf):
    report = P.grpo_report(rollouts(spark, sf), logps(spark, sf))
    names = ["mean_reward", "failed_share", "policy_loss", "critic_loss"]
    return report.select("step", "n_rollouts", *[r6(c).alias(c) for c in names])


@query("l11_critic_loss", with_ctes(SQL_ROLLOUTS, select="""
    SELECT round(avg(mse), 6) AS critic_loss, count(mse) AS n_valid FROM rewarded"""))
def l11(spark, sf):
    return P.critic_loss(rollouts(spark, sf)).select(r6("critic_loss").alias("critic_loss"), "n_valid")


@query("a9_fve_report", with_ctes(SQL_PAIRS, SQL_MU, SQL_ROLLOUTS, select="""
    SELECT count(mse) AS n_evaluated, count(*) - count(mse) AS n_failed, round(avg(mse), 6) AS mse, round(any_value(rawvar), 6) AS rawvar,
           round(any_value(meannorm), 6) AS meannorm, round(1 - avg(mse) / any_value(rawvar), 6) AS fve_nrm,
           round(1 - avg(mse) / any_value(meannorm), 6) AS fve_nrm_meannorm, round(-avg(mse), 6) AS reward_equivalent
    FROM rewarded, base"""))
def a9(spark, sf):
    report = E.fve_report(rollouts(spark, sf))
    return report.select("n_evaluated", "n_failed", *[r6(c).alias(c) for c in report.columns[2:]])


@query("r13_running_score", with_ctes(SQL_ROLLOUTS, select="""
    SELECT seq_id, n_valid, round(running_mse, 6) AS running_mse FROM (
      SELECT seq_id, count(mse) OVER (ORDER BY seq_id) AS n_valid, avg(mse) OVER (ORDER BY seq_id) AS running_mse FROM rewarded)
    WHERE (seq_id + 1) % 50 = 0"""))
def r13(spark, sf):
    scored = rollouts(spark, sf).select("seq_id", V.mse("pred", "gold").alias("mse"))
    run = E.running_score(scored, "seq_id", 50)
    return run.select("seq_id", "n_valid", r6("running_mse").alias("running_mse"))


SQL_SHARDS = """
sharded AS (SELECT seq_id, CASE WHEN seq_id % 3 = 0 THEN 0 ELSE seq_id % 4 END AS shard FROM rollouts)"""


@query("a17_equal_shards", with_ctes(SQL_ROLLOUTS, SQL_SHARDS, select="""
    SELECT seq_id, shard FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY seq_id) AS r FROM sharded)
    WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM sharded GROUP BY shard))"""))
def a17(spark, sf):
    """One shard holds half of the rows."""
    rows = rollouts(spark, sf).select(
        "seq_id", F.when(F.col("seq_id") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("seq_id") % 4).alias("shard")
    )
    return P.equal_shards(rows, "shard", 4, ["seq_id"])


@query("a18_identical_outputs", with_ctes(SQL_ROLLOUTS, select="""
    SELECT count(*) AS n_pairs, round(avg((label = other_label)::INT), 6) AS identical_share FROM rollouts"""))
def a18(spark, sf):
    rows = rollouts(spark, sf)
    share = P.identical_share(
        rows.select("seq_id", F.col("label").alias("output")), rows.select("seq_id", F.col("other_label").alias("output")), "seq_id", "output"
    )
    return share.select("n_pairs", r6("identical_share").alias("identical_share"))


@query("a19_optimizer_step_loss", with_ctes(SQL_ROLLOUTS, select="""
    SELECT step, round(sum(-reward), 6) AS step_loss FROM (SELECT seq_id // 8 AS step, reward FROM rewards) GROUP BY step"""))
def a19(spark, sf):
    """Each rollout's error as one micro-batch loss, eight to a step."""
    micro = P.add_rewards(rollouts(spark, sf)).select(F.col("seq_id").alias("micro"), (-F.col("reward")).alias("loss"))
    return P.optimizer_step_losses(micro, 8).select("step", r6("step_loss").alias("step_loss"))


@query("a19_mean_step_loss", with_ctes(SQL_ROLLOUTS, select="""
    SELECT round(avg(l), 6) AS loss, count(*) AS n_steps FROM (SELECT sum(-reward) AS l FROM rewards GROUP BY seq_id // 8)"""))
def a19_mean(spark, sf):
    micro = P.add_rewards(rollouts(spark, sf)).select(F.col("seq_id").alias("micro"), (-F.col("reward")).alias("loss"))
    return P.mean_step_loss(micro, 8).select(r6("loss").alias("loss"), "n_steps")


@query("a13_mean_of_batch_means", with_ctes(SQL_ROLLOUTS, select="""
    SELECT round(avg(m), 6) AS loss, count(*) AS n_batches FROM (SELECT avg(-reward) AS m FROM rewards GROUP BY seq_id // 48)"""))
def a13(spark, sf):
    losses = P.add_rewards(rollouts(spark, sf)).select(F.expr("seq_id div 48").alias("batch"), (-F.col("reward")).alias("loss"))
    return P.mean_of_batch_means(losses).select(r6("loss").alias("loss"), "n_batches")


# ---- token losses -----------------------------------------------------------------------------

SQL_LOGITS = r"""
message_tokens AS (
  SELECT conv_id * 1000000 + turn AS seq_id, unnest(toks) AS token, unnest(range(len(toks))) AS pos
  FROM (SELECT conv_id, turn, (regexp_extract_all(text, '[ \n\t\r]*[^ \n\t\r]+')) AS toks FROM conversations)
),
logits AS (
  SELECT seq_id, pos, list_transform(range(5), lambda i: ((seq_id * 7 + pos * 3 + i * 5) % 11) / 4.0::DOUBLE) AS logits,
         CASE WHEN pos < 3 THEN -100 ELSE length(token) % 5 END AS label, (pos >= 3)::INT::DOUBLE AS mask
  FROM message_tokens
),
lse AS (SELECT *, ln(list_sum(list_transform(logits, lambda x: exp(x)))) AS z FROM logits),
shifted AS (
  SELECT a.seq_id, a.pos, b.label AS target, b.mask AS target_mask,
         CASE WHEN b.label = -100 THEN 0 ELSE a.z - a.logits[b.label + 1] END AS loss
  FROM lse a JOIN lse b ON b.seq_id = a.seq_id AND b.pos = a.pos + 1
)"""


def message_tokens(spark, sf):
    messages = table(spark, sf, "conversations")
    return messages.select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("seq_id"), F.posexplode(T.tokenize("text", None)).alias("pos", "token")
    )


def logits(spark, sf):
    """Five logits, a label and a mask per message token; the first three are prompt."""
    entry = F.transform(
        F.sequence(F.lit(0), F.lit(4)), lambda i: ((F.col("seq_id") * 7 + F.col("pos") * 3 + i * 5) % 11) / F.lit(4.0)
    )
    label = F.when(F.col("pos") < 3, F.lit(C.IGNORED_LABEL)).otherwise(F.char_length("token") % 5)
    return message_tokens(spark, sf).select(
        "seq_id", "pos", entry.alias("logits"), label.alias("label"), (F.col("pos") >= 3).cast("int").cast("double").alias("mask")
    )


@query("v9_token_logprob", with_ctes(SQL_LOGITS, select="""
    SELECT seq_id, pos, round(-loss, 6) AS logp FROM shifted WHERE target <> -100"""))
def v9(spark, sf):
    losses = P.next_token_losses(logits(spark, sf)).filter(F.col("target") != C.IGNORED_LABEL)
    return losses.select("seq_id", F.col("pos").cast("bigint").alias("pos"), r6(-F.col("loss")).alias("logp"))


@query("a12_masked_cross_entropy", with_ctes(SQL_LOGITS, select="""
    SELECT round(sum(loss * target_mask) / greatest(sum(target_mask), 1), 6) AS loss, count(*) AS n_positions FROM shifted"""))
def a12(spark, sf):
    return P.cross_entropy(logits(spark, sf)).select(r6("loss").alias("loss"), "n_positions")


@query("a12_plain_cross_entropy", with_ctes(SQL_LOGITS, select="""
    SELECT round(avg(loss), 6) AS loss, round(sum(loss) / count(*) FILTER (target <> -100), 6) AS loss_of_used, count(*) AS n_positions
    FROM shifted"""))
def a12_plain(spark, sf):
    """Without a mask ignored positions add nothing and still count; the option leaves them out."""
    tokens = logits(spark, sf).drop("mask")
    plain = P.cross_entropy(tokens)
    used = P.cross_entropy(tokens, ignore_masked=True).select("n_positions", r6("loss").alias("loss_of_used"))
    return plain.select(r6("loss").alias("loss"), "n_positions").join(used, "n_positions")


# ---- marker injection ----------------------------------------------------------------------------

SQL_SITES = SQL_LOGITS.split(",\nlogits AS")[0] + """,
ids AS (SELECT seq_id, pos, length(token) AS token_id FROM message_tokens),
sites AS (
  SELECT seq_id, pos FROM (
    SELECT *, lag(token_id) OVER w AS l, lead(token_id) OVER w AS r FROM ids WINDOW w AS (PARTITION BY seq_id ORDER BY pos))
  WHERE token_id = 5 AND l = 4 AND r = 6
)"""


def token_ids(spark, sf):
    return message_tokens(spark, sf).select("seq_id", F.col("pos").cast("bigint").alias("pos"), F.char_length("token").cast("bigint").alias("token_id"))


@query("r11_marker_sites", with_ctes(SQL_SITES, select="SELECT seq_id, pos FROM sites"))
def r11(spark, sf):
    return N.marker_sites(token_ids(spark, sf), 5, 4, 6)


@query("r11_marker_sites_in_arrays", with_ctes(SQL_SITES, select="SELECT seq_id, pos FROM sites"))
def r11_arrays(spark, sf):
    """The same with one row per sequence: no shuffle."""
    ids = F.transform(T.tokenize("text", None), lambda t: F.char_length(t))
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000000 + F.col("turn")).alias("seq_id"), ids.alias("ids"))
    sites = T.let(F.col("ids"), lambda i: N.sites_in_array(i, 5, 4, 6))
    return rows.select("seq_id", F.explode(sites).alias("pos")).select("seq_id", F.col("pos").cast("bigint").alias("pos"))


@query("r12_inject_vectors", with_ctes(SQL_SITES, """
    numbered AS (SELECT *, row_number() OVER (ORDER BY seq_id, pos) - 1 AS vec_idx FROM sites),
    placed AS (
      SELECT seq_id, pos, list_sum(embedding::DOUBLE[]) AS total FROM numbered
      JOIN embeddings ON vec_id = vec_idx * 7 % (SELECT count(*) FROM embeddings))""", select="""
    SELECT i.seq_id, i.pos, i.token_id, p.total IS NOT NULL AS injected, round(coalesce(p.total, i.token_id / 10.0::DOUBLE + i.pos), 4) AS total
    FROM ids i LEFT JOIN placed p USING (seq_id, pos)"""))
def r12(spark, sf):
    """As many vectors as there are sites; a plain token's embedding is (token_id / 10, pos)."""
    ids = token_ids(spark, sf)
    tokens = ids.withColumn("embedding", F.array((F.col("token_id") / F.lit(10.0)).cast("double"), F.col("pos").cast("double")))
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    n = emb.count()
    wanted = spark.range(N.marker_sites(ids, 5, 4, 6).count()).withColumnRenamed("id", "vec_idx")
    vectors = wanted.withColumn("vec_id", F.col("vec_idx") * 7 % n).join(emb, "vec_id")
    out = N.inject_vectors(tokens, vectors, 5, 4, 6)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
    return out.select("seq_id", "pos", "token_id", "injected", F.round(total, 4).alias("total"))
