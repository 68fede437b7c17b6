"""Registered queries: labels, caches, prompts and training tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from echoframe.functions import constants as C
from echoframe.functions import text as T
from echoframe.operators import inference as I
from echoframe.operators import joins as J
from echoframe.operators import labelling as L
from echoframe.operators import lattice as LT
from echoframe.operators import training_tables as TT
from echoframe.operators import vocabulary as VOC
from echoframe.operators.aggregates import extraction_rate
from echoframe.operators.calls import Busy, CallProvider, Declined, Patience
from echoframe.operators.positions import extract_positions, with_tokens
from echoframe.operators.sampling import SPLITS, split_documents, split_rule
from echoframe.plans import inputs
from echoframe.plans.catalog import query, table, with_ctes
from echoframe.plans.sampling_plans import SQL_POSITIONS, SQL_SPLIT, sql_ranked
from echoframe.session import materialize, new_table_path
from echoframe.sources import label_cache as LC
from echoframe.sources import sidecar as SC
from echoframe.sources import tables as TB
from echoframe.sources.bucketed import buckets_for, write_bucketed
from echoframe.sources.corpus import spread

# ---- SQL building blocks -----------------------------------------------------------


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_extract(raw: str) -> str:
    return (
        f"CASE WHEN regexp_matches({raw}, {sql_text(C.ANALYSIS_PATTERN)}) "
        f"THEN regexp_extract({raw}, {sql_text(C.ANALYSIS_PATTERN)}, 1) END"
    )


def sql_clean(content: str) -> str:
    line = (
        f"trim(trim(regexp_replace(regexp_replace(l, {sql_text(C.LIST_MARKER_PATTERN)}, ''), "
        f"{sql_text(C.LEADING_BOLD_PATTERN)}, '\\1 '), {sql_text(C.WHITESPACE)}), '*_')"
    )
    return (
        f"array_to_string(list_filter(list_transform(string_split({content}, chr(10)), lambda l: {line}), "
        f"lambda l: l <> ''), chr(10) || chr(10))"
    )


def sql_features(x: str) -> str:
    return f"len(string_split({x}, chr(10) || chr(10)))"


SQL_RAW = f"""
lined AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
raws AS (
  SELECT doc_id, CASE
    WHEN doc_id % 13 = 0 THEN NULL
    WHEN doc_id % 11 = 0 THEN '<analysis>' || ls[1] || '</analysis>'
    WHEN doc_id % 7 = 0 THEN '<analysis>' || chr(10) || '- ' || ls[1] || chr(10) || chr(10) || '2) ' || coalesce(ls[2], '')
    ELSE '<analysis>' || chr(10) || '- ' || ls[1] || chr(10) || chr(10) || '2) ' || coalesce(ls[2], '') || chr(10) || chr(10)
         || '**' || coalesce(ls[3], 'end') || '** tail' || chr(10) || '</analysis>' END AS raw
  FROM lined
),
answers AS (SELECT doc_id, raw, {sql_extract('raw')} AS content FROM raws),
cleaned AS (SELECT doc_id, raw, content, CASE WHEN content IS NOT NULL THEN {sql_clean('content')} END AS extracted FROM answers),
reasons AS (
  SELECT doc_id, raw, extracted, CASE
    WHEN raw IS NULL THEN 'provider returned None (retries exhausted)'
    WHEN extracted IS NULL THEN 'extract pattern did not match'
    WHEN {sql_features('extracted')} < 2 THEN 'too few features (' || {sql_features('extracted')} || ' < 2)' END AS drop_reason
  FROM cleaned
)"""


def raw_completions(spark, sf):
    """Completions in every shape the provider may give, from the first lines of each document."""
    docs = table(spark, sf, "documents").select("doc_id", F.split("text", "\n", -1).alias("ls"))

    def line(i, default):
        return F.coalesce(F.get("ls", F.lit(i)), F.lit(default))

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    head = text("<analysis>\n- ", line(0, ""), "\n\n2) ", line(1, ""))
    raw = (
        F.when(F.col("doc_id") % 13 == 0, F.lit(None).cast("string"))
        .when(F.col("doc_id") % 11 == 0, text("<analysis>", line(0, ""), "</analysis>"))
        .when(F.col("doc_id") % 7 == 0, head)
        .otherwise(text(head, "\n\n**", line(2, "end"), "** tail\n</analysis>"))
    )
    return docs.select("doc_id", raw.alias("raw"))


def sql_labels(source: str = "positions", name: str = "explained") -> str:
    """The offline provider on every position of ``source``, cleaned."""
    return f"""
{name}_asked AS (SELECT *, replace(detokenized_text_truncated, chr(10), ' ') AS t FROM {source}),
{name}_raw AS (
  SELECT *, CASE WHEN trim(t, ' ') <> '' THEN '<analysis>' || chr(10) || '- opens with: ' || substr(t, 1, 24) || chr(10) || chr(10)
    || '2) about ' || (length(t) // 100) || ' hundred characters' || chr(10) || chr(10)
    || '**Ends** on: ' || right(t, 24) || chr(10) || '</analysis>' END AS raw
  FROM {name}_asked
),
{name}_content AS (SELECT *, {sql_extract('raw')} AS content FROM {name}_raw),
{name}_clean AS (SELECT *, CASE WHEN content IS NOT NULL THEN {sql_clean('content')} END AS extracted FROM {name}_content),
{name} AS (
  SELECT doc_id, n_raw_tokens, detokenized_text_truncated, extracted AS api_explanation
  FROM {name}_clean WHERE {sql_features('extracted')} >= 2
)"""


def explained(spark, sf, per_doc=C.POSITIONS_PER_DOC):
    """Explained rows with the key of their text in its place."""
    return L.label(materialize(inputs.positions(spark, sf, per_doc), "positions"), stored=True, text=False)


def explained_and_vectors(spark, sf, per_doc=C.POSITIONS_PER_DOC):
    """Explained rows, with the key of their text in its place, and vectors of one stored positions table."""
    rows = materialize(inputs.positions(spark, sf, per_doc), "positions")
    return L.label(rows, stored=True, text=False), I.encode(rows)


SQL_EXPLAINED = (*SQL_POSITIONS, sql_labels())

# ---- text functions --------------------------------------------------------------------


@query("t5_instruction_prompt", f"""
    SELECT doc_id, sha256(replace({sql_text(C.INSTRUCTION_TEMPLATE)}, '{{text}}', text)) AS prompt_sha256 FROM documents""")
def t5(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2(T.instruction_prompt("text"), 256).alias("prompt_sha256"))


@query("t6_extract_answer", with_ctes(SQL_RAW, select="SELECT doc_id, content FROM answers"))
def t6(spark, sf):
    return raw_completions(spark, sf).select("doc_id", T.extract_answer("raw").alias("content"))


@query("t7_clean_list_markers", with_ctes(SQL_RAW, select="SELECT doc_id, extracted FROM cleaned"))
def t7(spark, sf):
    return raw_completions(spark, sf).select("doc_id", T.clean_list_markers(T.extract_answer("raw")).alias("extracted"))


@query("t8_feature_filter", with_ctes(SQL_RAW, select=f"""
    SELECT doc_id, {sql_features('extracted')} AS n_features FROM cleaned WHERE {sql_features('extracted')} >= 2"""))
def t8(spark, sf):
    rows = raw_completions(spark, sf).select("doc_id", T.clean_list_markers(T.extract_answer("raw")).alias("extracted"))
    return rows.filter(T.has_enough_features("extracted")).select("doc_id", T.feature_count("extracted").alias("n_features"))


@query("t9_drop_reason", with_ctes(SQL_RAW, select="SELECT doc_id, drop_reason FROM reasons"))
def t9(spark, sf):
    rows = raw_completions(spark, sf).withColumn("extracted", T.clean_list_markers(T.extract_answer("raw")))
    return rows.select("doc_id", T.drop_reason("raw", "extracted").alias("drop_reason"))


@query("t10_wrap_explanation", """
    SELECT conv_id, turn, '<explanation>' || chr(10) || text || chr(10) || '</explanation>' AS wrapped FROM conversations""")
def t10(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.wrap_explanation("text").alias("wrapped"))


SQL_RESPONSES = f"""
responses AS (
  SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 0 THEN '<explanation>' || text
    WHEN (conv_id + turn) % 3 = 0 THEN ' ' || text || chr(10)
    ELSE 'so <explanation>' || chr(10) || text || '  </explanation> and <explanation>b</explanation>' END AS response
  FROM conversations
),
extracted AS (
  SELECT *, CASE WHEN regexp_matches(response, {sql_text(C.EXPLANATION_PATTERN)})
    THEN trim(regexp_extract(response, {sql_text(C.EXPLANATION_PATTERN)}, 1), {sql_text(C.WHITESPACE)}) END AS explanation
  FROM responses
)"""


def responses(spark, sf):
    """Responses with a whole, a missing or a cut-off explanation."""
    k = F.col("conv_id") + F.col("turn")
    response = (
        F.when(k % 5 == 0, F.concat(F.lit("<explanation>"), "text"))
        .when(k % 3 == 0, F.concat(F.lit(" "), "text", F.lit("\n")))
        .otherwise(F.concat(F.lit("so <explanation>\n"), "text", F.lit("  </explanation> and <explanation>b</explanation>")))
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", response.alias("response"))


@query("t11_extract_explanation", with_ctes(SQL_RESPONSES, select="SELECT conv_id, turn, explanation FROM extracted"))
def t11(spark, sf):
    return responses(spark, sf).select("conv_id", "turn", T.extract_explanation("response").alias("explanation"))


@query("t12_explanation_or_raw", with_ctes(SQL_RESPONSES, select=f"""
    SELECT conv_id, turn, coalesce(explanation, trim(response, {sql_text(C.WHITESPACE)})) AS stripped FROM extracted"""))
def t12(spark, sf):
    return responses(spark, sf).select("conv_id", "turn", T.explanation_or_raw("response").alias("stripped"))


@query("a10_extraction_rate", with_ctes(SQL_RESPONSES, select="""
    SELECT round(avg((explanation IS NOT NULL)::INT), 6) AS extraction_rate FROM extracted"""))
def a10(spark, sf):
    return extraction_rate(responses(spark, sf)).select(F.round("extraction_rate", 6).alias("extraction_rate"))


SQL_ACTOR = sql_text(C.ACTOR_TEMPLATE.replace("{injection_char}", C.INJECT_PLACEHOLDER))


@query("t13_actor_prompt", f"SELECT vec_id, 'user' AS role, {SQL_ACTOR} AS content FROM embeddings")
def t13(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", T.actor_prompt().alias("prompt"))
    return rows.select("vec_id", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"))


@query("t14_critic_prompt", """
    SELECT conv_id, turn, 'Summary of the following text: <text>' || text || '</text> <summary>' AS prompt FROM conversations""")
def t14(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.critic_prompt("text").alias("prompt"))


@query("t15_swap_placeholder", f"SELECT vec_id, 'user' AS role, replace({SQL_ACTOR}, '<INJECT>', '㈎') AS content FROM embeddings")
def t15(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", T.swap_placeholder(T.actor_prompt(), "㈎").alias("prompt"))
    return rows.select("vec_id", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"))


@query("t16_prompt_tail_check", r"""
    SELECT count(*) AS n_prompts, count(*) FILTER (regexp_extract_all(
      'Summary of the following text: <text>' || text || '</text> <summary>', '[ \n\t\r]*[^ \n\t\r]+')[-1] <> ' <summary>') AS n_bad_tails
    FROM conversations""")
def t16(spark, sf):
    return TT.tail_violations(table(spark, sf, "conversations").select(T.critic_prompt("text").alias("prompt")))


@query("t19_text_key", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def t19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.text_key("text").alias("text_sha256"))


@query("t20_preview", 'SELECT doc_id, substr(text, 1, 200) AS head, right(text, 120) AS tail FROM documents')
def t20(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.preview("text").alias("head"), T.tail("text").alias("tail"))


SQL_VOCAB = r"""
vocab AS (
  SELECT token, count(*) AS n, row_number() OVER (ORDER BY token) - 1 AS token_id
  FROM (SELECT unnest(regexp_extract_all(text, '[ \n\t\r]*[^ \n\t\r]+')) AS token FROM documents) GROUP BY token
)"""


@query("t21_vocabulary", with_ctes(SQL_VOCAB, select="SELECT token, n, token_id FROM vocab"))
def t21(spark, sf):
    return VOC.vocabulary(with_tokens(inputs.corpus(spark, sf), max_length=None))


SQL_FINGERPRINT = """
leaf AS (SELECT sha256(token) AS h FROM vocab),
fine AS (SELECT substr(h, 1, 6) AS g, sha256(string_agg(h, '' ORDER BY h)) AS h FROM leaf GROUP BY 1),
coarse AS (SELECT substr(g, 1, 3) AS g, sha256(string_agg(h, '' ORDER BY g)) AS h FROM fine GROUP BY substr(g, 1, 3)),
fingerprint AS (SELECT sha256(string_agg(h, '' ORDER BY g) || '|<pad>') AS fingerprint FROM coarse)"""


@query("t21_vocabulary_fingerprint", with_ctes(SQL_VOCAB, SQL_FINGERPRINT, select="SELECT fingerprint FROM fingerprint"))
def t21_fingerprint(spark, sf):
    vocab = with_tokens(inputs.corpus(spark, sf), max_length=None).select(F.explode("tokens").alias("token")).distinct()
    return VOC.vocabulary_fingerprint(vocab, ("<pad>",))


@query("t22_fingerprint_check", with_ctes(SQL_VOCAB, SQL_FINGERPRINT, select="""
    SELECT fingerprint, true AS first_run, false AS second_run FROM fingerprint"""))
def t22(spark, sf):
    """Recorded on the first run, compared on the second."""
    frame = t21_fingerprint(spark, sf)
    value = frame.first()["fingerprint"]
    path = new_table_path(spark, "pool-meta")
    runs = [VOC.check_fingerprint(spark, path, value, "blank-splitter") for _ in range(2)]
    stored = SC.read_json(spark, path)[VOC.META_FINGERPRINT]
    return frame.select(F.lit(stored).alias("fingerprint"), F.lit(runs[0]).alias("first_run"), F.lit(runs[1]).alias("second_run"))


SQL_PAIRS = r"""
turns AS (
  SELECT a.conv_id, a.turn, a.text AS response,
         coalesce(string_agg('<|' || p.role || '|>' || chr(10) || p.text || chr(10), '' ORDER BY p.turn), '') || '<|assistant|>' || chr(10) AS rendered
  FROM conversations a LEFT JOIN conversations p ON p.conv_id = a.conv_id AND p.turn < a.turn WHERE a.role = 'assistant'
  GROUP BY a.conv_id, a.turn, a.text
),
chat AS (
  SELECT conv_id, turn, regexp_extract_all(rendered || response, '[ \n\t\r]*[^ \n\t\r]+')[1:2048] AS toks,
         len(regexp_extract_all(rendered, '[ \n\t\r]*[^ \n\t\r]+')[1:2048]) AS prompt_len
  FROM turns
)"""


def chat_rows(spark, sf):
    return TT.training_text(TT.conversation_rows(table(spark, sf, "conversations"), C.MAX_LENGTH))


@query("t25_conversation_text", with_ctes(SQL_PAIRS, select="""
    SELECT conv_id, turn, prompt_len, len(toks) AS n_tokens, sha256(array_to_string(toks, '|')) AS tokens_sha256 FROM chat"""))
def t25(spark, sf):
    return chat_rows(spark, sf).select(
        "conv_id", "turn", "prompt_len", F.size("tokens").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("tokens", "|"), 256).alias("tokens_sha256"),
    )


@query("t17_mask_prompt_labels", with_ctes(SQL_PAIRS, select="""
    SELECT conv_id, turn, array_to_string(list_transform(range(1, len(toks) + 1), lambda i:
      CASE WHEN i <= prompt_len THEN -100 ELSE length(toks[i]) END), ',') AS labels FROM chat"""))
def t17(spark, sf):
    ids = F.transform("tokens", lambda t: F.char_length(t).cast("bigint"))
    rows = chat_rows(spark, sf).select("conv_id", "turn", "prompt_len", ids.alias("ids"))
    labels = T.mask_prompt_labels("ids", "prompt_len")
    return rows.select("conv_id", "turn", F.array_join(labels.cast("array<string>"), ",").alias("labels"))


@query("t24_response_slice", with_ctes(SQL_PAIRS.replace("[1:2048]", ""), select="""
    SELECT conv_id, turn, array_to_string(toks[prompt_len + 1:], '') AS generated FROM chat"""))
def t24(spark, sf):
    """Generated tokens behind whole prompts; no length is a limit here."""
    rows = TT.training_text(TT.conversation_rows(table(spark, sf, "conversations")), max_length=None)
    return rows.select("conv_id", "turn", F.array_join(T.response_slice("tokens", "prompt_len"), "").alias("generated"))


# ---- provider, cache and labels ----------------------------------------------------------


@query("u1_provider", with_ctes(*SQL_EXPLAINED, select="""
    SELECT sha256(detokenized_text_truncated) AS text_sha256, any_value(raw) AS raw,
           CASE WHEN any_value(raw) IS NULL THEN 'refused' ELSE 'ok' END AS status
    FROM explained_raw GROUP BY sha256(detokenized_text_truncated)"""))
def u1(spark, sf):
    """The offline provider over every distinct prompt."""
    texts = L.distinct_texts(inputs.positions(spark, sf)).withColumn("prompt", T.instruction_prompt("text"))
    return I.complete(texts, "offline").select("text_sha256", "raw", "status")


SQL_WORDS_FIRST = r"""
tokens AS (
  SELECT 'documents:train:' || doc_id AS doc_id, (regexp_extract_all(text, '[^ \n\t\r]+[ \n\t\r]*|[ \n\t\r]+'))[1:2048] AS toks FROM documents
)"""


@query("u2_plugin_tokenizer", with_ctes(SQL_WORDS_FIRST, inputs.sql_positions(2), select="""
    SELECT doc_id, n_raw_tokens, sha256(detokenized_text_truncated) AS text_sha256 FROM positions"""))
def u2(spark, sf):
    """Position extraction with another tokenizer, given as a column expression: blanks end a token."""
    pattern = r"[^ \n\t\r]+[ \n\t\r]*|[ \n\t\r]+"
    rows = extract_positions(
        inputs.corpus(spark, sf), positions_per_doc=2, tokenizer=lambda text: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    )
    return rows.select("doc_id", "n_raw_tokens", F.sha2("detokenized_text_truncated", 256).alias("text_sha256"))


def sql_lattice(path: str) -> tuple[str, ...]:
    """Least sums over the edges of every distinct part, ends in order; the number of pieces is kept below the costs."""
    return (
        f"""
vocab AS (
  SELECT piece, round({LT.COST_UNIT} * ln(rank + 2))::BIGINT AS cost
  FROM (SELECT TRY(decode(from_base64(piece))) AS piece, rank
        FROM read_csv('{path}', delim = ' ', header = false, quote = '', escape = '', columns = {{'piece': 'VARCHAR', 'rank': 'BIGINT'}}))
  WHERE piece IS NOT NULL AND piece <> ''
)""",
        r"""
parts AS (SELECT doc_id, unnest(regexp_extract_all(text, '[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+\z')) AS part FROM documents)""",
        f"""
words AS (SELECT DISTINCT part, length(part) AS n FROM parts),
starts AS (SELECT part, n, unnest(range(n)) AS s FROM words),
spans AS (SELECT part, n, s, unnest(range(1, least(n - s, (SELECT max(length(piece)) FROM vocab)) + 1)) AS l FROM starts),
edges AS (
  SELECT part, s, s + l AS e, cost FROM spans JOIN vocab ON piece = substr(part, s + 1, l)
  UNION ALL SELECT part, s, s + 1, (SELECT max(cost) FROM vocab) + {LT.COST_UNIT} FROM starts
),
solved AS (
  SELECT part, list_reduce(
    list_prepend(list_prepend(0::BIGINT, list_transform(range(n), lambda i: 1::BIGINT << 60)), list([s, e, cost * {LT.PIECE_UNIT} + 1] ORDER BY e, s)),
    lambda best, x: list_transform(best, lambda v, i: CASE WHEN i = x[2] + 1 THEN least(v, best[x[1] + 1] + x[3]) ELSE v END)
  )[n + 1] % {LT.PIECE_UNIT} AS pieces
  FROM edges JOIN words USING (part) GROUP BY part, n
)""",
    )


@query("u2_lattice_tokenizer", with_ctes(*sql_lattice(inputs.vocabulary_path()), select="""
    SELECT d.doc_id, coalesce(t.n, 0)::BIGINT AS n_tokens, sha256(d.text) AS joined_sha256
    FROM documents d LEFT JOIN (SELECT doc_id, sum(pieces) AS n FROM parts JOIN solved USING (part) GROUP BY doc_id) t USING (doc_id) WHERE d.text IS NOT NULL"""))
def u2_lattice(spark, sf):
    """Every document by the pieces of a vocabulary; joined they are the text."""
    tokenizer = LT.lattice_tokenizer(spark, LT.read_ranked_pieces(spark, inputs.vocabulary_path()))
    docs = spread(table(spark, sf, "documents").select("doc_id", "text").filter("text is not null"), "doc_id")
    cut = with_tokens(docs, max_length=None, tokenizer=tokenizer)
    return cut.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("tokens", ""), 256).alias("joined_sha256"))


@query("l2_label", with_ctes(*SQL_EXPLAINED, select="""
    SELECT doc_id, n_raw_tokens, sha256(detokenized_text_truncated) AS text_sha256, api_explanation FROM explained"""))
def l2(spark, sf):
    return explained(spark, sf).select("doc_id", "n_raw_tokens", "text_sha256", "api_explanation")


SQL_HALF_CACHE = (*SQL_EXPLAINED, """
cache AS (
  SELECT DISTINCT sha256(detokenized_text_truncated) AS text_sha256, api_explanation AS explanation
  FROM explained WHERE n_raw_tokens % 2 = 0
)""")


def half_explained(spark, sf):
    return explained(spark, sf).filter("n_raw_tokens % 2 = 0")


def half_cache(spark, sf):
    """Cache built from the explained rows at even positions."""
    return LC.merge_caches([LC.cache_from_explained(half_explained(spark, sf))])


@query("j3_cache_lookup", with_ctes(*SQL_HALF_CACHE, select="""
    SELECT t.text_sha256, c.explanation AS cached
    FROM (SELECT DISTINCT sha256(detokenized_text_truncated) AS text_sha256 FROM positions) t LEFT JOIN cache c USING (text_sha256)"""))
def j3(spark, sf):
    cache = materialize(half_cache(spark, sf), "cache")
    texts = L.distinct_texts(inputs.positions(spark, sf)).select("text_sha256")
    return L.cache_lookup(texts, cache)


@query("j3_bucketed_lookup", with_ctes(*SQL_HALF_CACHE, select="""
    SELECT t.text_sha256, c.explanation AS cached
    FROM (SELECT DISTINCT sha256(detokenized_text_truncated) AS text_sha256 FROM positions) t LEFT JOIN cache c USING (text_sha256)"""))
def j3_bucketed(spark, sf):
    """The cache stored in buckets by key; only the texts to look up are dealt out."""
    half = half_explained(spark, sf)
    cache = LC.merge_caches([LC.cache_from_explained(half)])
    cache = write_bucketed(cache, new_table_path(spark, "bucketed-cache"), ["text_sha256"], buckets_for(half.count()))
    texts = L.distinct_texts(inputs.positions(spark, sf)).select("text_sha256")
    return L.cache_lookup(texts, cache)


@query("l2_label_with_cache", with_ctes(*SQL_HALF_CACHE, select="""
    SELECT status, count(*) AS n FROM (
      SELECT CASE WHEN text_sha256 IN (SELECT text_sha256 FROM cache) THEN 'cached' ELSE 'ok' END AS status
      FROM (SELECT DISTINCT sha256(detokenized_text_truncated) AS text_sha256 FROM positions))
    GROUP BY status"""))
def l2_cached(spark, sf):
    """Only cache misses reach the provider."""
    attempts = L.attempt_labels(inputs.positions(spark, sf), cache=half_cache(spark, sf))
    return L.outcome_counts(attempts)


@query("j5_skip_finished", with_ctes(*SQL_POSITIONS, select="""
    SELECT doc_id, n_raw_tokens FROM positions WHERE n_raw_tokens % 3 <> 0"""))
def j5(spark, sf):
    rows = inputs.positions(spark, sf).select("doc_id", "n_raw_tokens")
    return L.skip_finished(rows, rows.filter("n_raw_tokens % 3 = 0"))


def raw_attempts(spark, sf):
    """Positions and label attempts over them: the raw completions of each document's texts."""
    rows = extract_positions(inputs.corpus(spark, sf), positions_per_doc=3)
    number = F.substring_index("doc_id", ":", -1).cast("bigint")
    raws = raw_completions(spark, sf).withColumnRenamed("doc_id", "number")
    # One attempt per text, as labelling makes it: the completion of the last document that has the text.
    chosen = rows.groupBy(T.text_key(L.TEXT).alias("text_sha256")).agg(F.max(number).alias("number"))
    tried = chosen.join(raws, "number").drop("number")
    status = F.when(F.col("raw").isNull(), F.lit(I.EXHAUSTED)).otherwise(F.lit(I.OK))
    return rows, tried.withColumn("status", status).withColumn("extracted", T.clean_list_markers(T.extract_answer("raw")))


SQL_AUDIT = (inputs.SQL_TOKENS, inputs.sql_positions(3), SQL_RAW, """
keyed AS (SELECT *, sha256(detokenized_text_truncated) AS h, split_part(doc_id, ':', 3)::BIGINT AS number FROM positions),
audited AS (
  SELECT k.doc_id, k.n_raw_tokens, r.raw, r.extracted, r.drop_reason
  FROM keyed k JOIN (SELECT h, max(number) AS number FROM keyed GROUP BY h) c USING (h) JOIN reasons r ON r.doc_id = c.number
)""")


@query("l4_label_audit", with_ctes(*SQL_AUDIT, select="""
    SELECT doc_id, n_raw_tokens, raw, extracted, drop_reason IS NOT NULL AS dropped, drop_reason FROM audited"""))
def l4(spark, sf):
    return L.audit(*raw_attempts(spark, sf)).drop("text", "status")


@query("a6_drop_summary", with_ctes(*SQL_AUDIT, select="""
    SELECT coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS n FROM audited GROUP BY 1"""))
def a6(spark, sf):
    return L.drop_summary(L.audit(*raw_attempts(spark, sf)))


@query("s8_debug_dump", with_ctes(*SQL_AUDIT, select="""
    SELECT doc_id, n_raw_tokens, drop_reason FROM audited WHERE drop_reason IS NOT NULL"""))
def s8(spark, sf):
    """Audit records written as JSON lines; the dropped ones read back."""
    path = new_table_path(spark, "debug")
    L.audit(*raw_attempts(spark, sf)).write.json(path)
    back = spark.read.schema("doc_id string, n_raw_tokens bigint, dropped boolean, drop_reason string").json(path)
    return back.filter("dropped").drop("dropped")


@query("a20_provider_outcomes", with_ctes(*SQL_AUDIT, select="""
    SELECT CASE WHEN raw IS NULL THEN 'retries exhausted' ELSE 'ok' END AS status, count(*) AS n
    FROM (SELECT h, max(number) AS number FROM keyed GROUP BY h) c JOIN raws r ON r.doc_id = c.number GROUP BY 1"""))
def a20(spark, sf):
    return L.outcome_counts(raw_attempts(spark, sf)[1])


class Rehearsal(CallProvider):
    """A service with outages that the prompt's own hash decides: no answer for as many tries as its first digit, none ever
    where the second is zero, and no patience for more than eight tries."""

    in_flight = 8
    patience = Patience(tries=8, first_wait=0.0)

    def __init__(self) -> None:
        self.tried: dict[str, int] = {}

    def call(self, prompt: str) -> str:
        digits = hashlib.sha256(prompt.encode()).hexdigest()
        if digits[1] == "0":
            raise Declined
        tried = self.tried[digits] = self.tried.get(digits, 0) + 1
        if tried <= int(digits[0], 16):
            raise Busy(wait=0.0 if digits[2] < "8" else None)
        return f"<analysis>\n- {digits}\n\n- tried {tried} times\n</analysis>"


@query("a20_call_outcomes", with_ctes(*SQL_POSITIONS, select="""
    SELECT CASE WHEN h[2] = '0' THEN 'refused' WHEN ('0x' || h[1])::INTEGER >= 8 THEN 'retries exhausted' ELSE 'ok' END AS status, count(*) AS n
    FROM (SELECT DISTINCT sha256(detokenized_text_truncated) AS h FROM positions) GROUP BY 1"""))
def a20_calls(spark, sf):
    """Every distinct text through a window of calls that are tried again."""
    return L.outcome_counts(L.attempt_labels(inputs.positions(spark, sf), Rehearsal(), template="{text}"))


SQL_CACHES = """
later AS (SELECT sha256(text) AS text_sha256, max('v2 ' || doc_id) AS explanation FROM documents WHERE doc_id % 2 = 0 GROUP BY 1),
earlier AS (SELECT sha256(text) AS text_sha256, max('v1 ' || lang) AS explanation FROM documents GROUP BY 1),
merged AS (
  SELECT text_sha256, coalesce(l.explanation, e.explanation) AS explanation FROM earlier e FULL JOIN later l USING (text_sha256)
)"""


def two_caches(spark, sf):
    docs = table(spark, sf, "documents")
    first = docs.select(T.text_key("text").alias("text_sha256"), F.concat(F.lit("v1 "), "lang").alias("explanation"))
    second = docs.filter("doc_id % 2 = 0").select(
        T.text_key("text").alias("text_sha256"), F.concat(F.lit("v2 "), F.col("doc_id").cast("string")).alias("explanation")
    )
    return first, second


@query("o4_merge_caches", with_ctes(SQL_CACHES, select="SELECT text_sha256, explanation FROM merged"))
def o4(spark, sf):
    return LC.merge_caches(two_caches(spark, sf))


@query("s6_load_label_cache", with_ctes(SQL_CACHES, select="SELECT text_sha256, explanation FROM merged"))
def s6(spark, sf):
    """The later cache comes from a file in the exchange form: one JSON object, an entry per line."""
    first, second = two_caches(spark, sf)
    entry = F.to_json(F.create_map("text_sha256", "explanation"))
    lines = LC.merge_caches([second]).select(F.concat(F.lit("  "), entry.substr(F.lit(2), F.length(entry) - 2), F.lit(",")).alias("value"))
    path = new_table_path(spark, "cache-json")
    lines.write.text(path)
    return LC.merge_caches([first, LC.cache_from_json(spark, path)])


@query("s7_export_label_cache", with_ctes(SQL_CACHES, select="""
    SELECT text_sha256, explanation, (SELECT count(*) FROM merged) AS num_entries FROM merged"""))
def s7(spark, sf):
    first, second = two_caches(spark, sf)
    path = new_table_path(spark, "cache-export")
    LC.export_cache(first, path, new=second, fingerprint="f", tokenizer_name="blank-splitter")
    entries = SC.read_json(spark, f"{path}_meta.json")["num_entries"]
    return LC.cache_from_json(spark, path).withColumn("num_entries", F.lit(entries).cast("bigint"))


@query("s9_resumable_labels", with_ctes(*SQL_EXPLAINED, select="SELECT doc_id, n_raw_tokens, api_explanation FROM explained"))
def s9(spark, sf):
    """A third of the rows first, then all in two slices: finished rows are not asked again."""
    rows = materialize(inputs.positions(spark, sf), "positions")
    path = new_table_path(spark, "labels")
    L.label_into(spark, rows.filter("n_raw_tokens % 3 = 0"), path, stored=True)
    L.label_into(spark, rows, path, slices=2, stored=True)
    return L.labelled(spark, path).select("doc_id", "n_raw_tokens", "api_explanation")


# ---- vectors at positions and training tables -------------------------------------------------

SQL_ENCODED = r"""
prefixed AS (
  SELECT doc_id, max(n_raw_tokens) AS longest FROM positions GROUP BY doc_id
),
buckets AS (
  SELECT t.doc_id, i, ('0x' || substr(md5(toks[i]), 1, 8))::BIGINT % 64 AS b
  FROM (SELECT t.doc_id, toks, unnest(range(1, longest + 1)) AS i FROM tokens t JOIN prefixed USING (doc_id)) t
),
counts AS (
  SELECT p.doc_id, p.n_raw_tokens, b, count(*) AS c
  FROM positions p JOIN buckets k ON k.doc_id = p.doc_id AND k.i <= p.n_raw_tokens GROUP BY ALL
),
vectors AS (
  SELECT doc_id, n_raw_tokens, string_agg(b || ':' || c, ' ' ORDER BY b) AS bag FROM counts GROUP BY ALL
)"""


def bag_text(vector):
    """Non-zero entries of a count vector as text, for comparison with SQL."""
    pairs = F.transform(vector, lambda x, i: F.when(x > 0, F.concat_ws(":", i.cast("string"), x.cast("bigint").cast("string"))))
    return F.array_join(F.filter(pairs, lambda p: p.isNotNull()), " ")


def encoded(spark, sf, per_doc=C.POSITIONS_PER_DOC):
    return I.encode(inputs.positions(spark, sf, per_doc))


@query("u3_encode", with_ctes(*SQL_POSITIONS, SQL_ENCODED, select="SELECT doc_id, n_raw_tokens, bag FROM vectors"))
def u3(spark, sf):
    return encoded(spark, sf).select("doc_id", "n_raw_tokens", bag_text("activation_vector").alias("bag"))


@query("u3_encode_report", with_ctes(*SQL_POSITIONS, select="""
    SELECT count(*) FILTER (n_raw_tokens <= 200) AS n_written, count(*) FILTER (n_raw_tokens > 200) AS n_skipped FROM positions"""))
def u3_report(spark, sf):
    return I.encode_report(inputs.positions(spark, sf), max_length=200)


@query("u3_packed_batches", with_ctes(*SQL_POSITIONS, select="""
    SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, 0::BIGINT AS n_over, true AS padding_below_half
    FROM (SELECT doc_id, max(n_raw_tokens) AS n FROM positions GROUP BY doc_id)"""))
def u3_packed(spark, sf):
    """Batches of at most 4096 padded tokens; a lone longer document aside, none is over."""
    report = I.packing_report(inputs.positions(spark, sf), 4096)
    return report.select("n_docs", "n_tokens", "n_over", (F.col("n_padded") < 2 * F.col("n_tokens")).alias("padding_below_half"))


@query("j1_join_vectors", with_ctes(*SQL_EXPLAINED, SQL_ENCODED, select="""
    SELECT doc_id, n_raw_tokens, api_explanation, bag FROM explained JOIN vectors USING (doc_id, n_raw_tokens)"""))
def j1(spark, sf):
    rows, vectors = (materialize(t, "join-side") for t in explained_and_vectors(spark, sf))
    joined = J.join_vectors(rows, vectors)
    return joined.select("doc_id", "n_raw_tokens", "api_explanation", bag_text("activation_vector").alias("bag"))


@query("j1_bucketed_join", with_ctes(*SQL_EXPLAINED, SQL_ENCODED, select="""
    SELECT doc_id, n_raw_tokens, api_explanation, bag FROM explained JOIN vectors USING (doc_id, n_raw_tokens)"""))
def j1_bucketed(spark, sf):
    """Both sides stored in buckets by key: the join shuffles neither."""
    rows, vectors = explained_and_vectors(spark, sf)
    buckets = buckets_for(rows.count())
    sides = [write_bucketed(t, new_table_path(spark, "bucketed-side"), L.KEYS, buckets) for t in (rows, vectors)]
    joined = J.join_vectors(*sides)
    return joined.select("doc_id", "n_raw_tokens", "api_explanation", bag_text("activation_vector").alias("bag"))


def two_key_sets(spark, sf):
    rows = inputs.positions(spark, sf).select("doc_id", "n_raw_tokens")
    return rows.filter("n_raw_tokens % 5 <> 0"), rows.filter("n_raw_tokens % 7 <> 0")


@query("j2_key_completeness", with_ctes(*SQL_POSITIONS, select="""
    SELECT count(*) FILTER (n_raw_tokens % 5 <> 0 AND n_raw_tokens % 7 = 0) AS n_missing,
           count(*) FILTER (n_raw_tokens % 5 = 0 AND n_raw_tokens % 7 <> 0) AS n_extra,
           0::BIGINT AS n_repeated_left, 0::BIGINT AS n_repeated_right FROM positions"""))
def j2(spark, sf):
    return J.key_report(*two_key_sets(spark, sf))


@query("o3_key_difference", with_ctes(*SQL_POSITIONS, select="""
    SELECT doc_id, n_raw_tokens, CASE WHEN n_raw_tokens % 7 = 0 THEN 'missing' ELSE 'extra' END AS side
    FROM positions WHERE (n_raw_tokens % 5 = 0) <> (n_raw_tokens % 7 = 0)"""))
def o3(spark, sf):
    return J.key_difference(*two_key_sets(spark, sf))


@query("l8_split_vectors", with_ctes(*SQL_POSITIONS, SQL_ENCODED, sql_ranked("positions"), SQL_SPLIT, select="""
    SELECT doc_id, n_raw_tokens, bag FROM vectors WHERE doc_id IN (SELECT doc_id FROM split_docs WHERE split = 'ar_sft')"""))
def l8(spark, sf):
    parts = split_documents(materialize(inputs.positions(spark, sf).select("doc_id").distinct(), "split-documents"))
    return J.split_vectors(encoded(spark, sf), parts, "ar_sft").select("doc_id", "n_raw_tokens", bag_text("activation_vector").alias("bag"))


SQL_TRAINING = (*SQL_EXPLAINED, SQL_ENCODED, sql_ranked("explained"), SQL_SPLIT, f"""
training AS (
  SELECT s.split, e.doc_id, e.n_raw_tokens, v.bag,
    CASE s.split WHEN 'ar_sft' THEN 'Summary of the following text: <text>' || api_explanation || '</text> <summary>'
                 ELSE {SQL_ACTOR} END AS prompt,
    CASE s.split WHEN 'av_sft' THEN '<explanation>' || chr(10) || api_explanation || chr(10) || '</explanation>' END AS response
  FROM explained e JOIN split_docs s USING (doc_id) JOIN vectors v USING (doc_id, n_raw_tokens)
)""")


def built_tables(spark, sf, base):
    """Split the explained rows, attach the vectors, write the three training tables.

    Both tables are split by the same rule and stored by split, so each build
    opens only its own part.
    """
    rows, vectors = explained_and_vectors(spark, sf)
    rows = materialize(rows, "explained")
    rule = split_rule(rows)
    stored = TB.write_splits(rows.withColumn("split", rule), f"{base}/explained")
    stored_vectors = TB.write_splits(vectors.withColumn("split", rule), f"{base}/vectors")
    metas = {}
    for split in SPLITS:
        part, vecs = (t.filter(F.col("split") == split).drop("split") for t in (stored, stored_vectors))
        metas[split] = TT.build_training(part, vecs, split, f"{base}/{split}")
    return metas


@query("l5_build_training", with_ctes(*SQL_TRAINING, select="""
    SELECT split, doc_id, n_raw_tokens, bag, sha256(prompt) AS prompt_sha256, response, 0::BIGINT AS activation_layer FROM training"""))
def l5(spark, sf):
    base = new_table_path(spark, "training")
    built_tables(spark, sf, base)

    def read(split):
        rows = TB.read_table(spark, f"{base}/{split}", TT.SCHEMAS[split])
        prompt = F.col("prompt") if split == "ar_sft" else F.col("prompt")[0]["content"]
        response = F.col("response") if split == "av_sft" else F.lit(None).cast("string")
        return rows.select(
            F.lit(split).alias("split"), "doc_id", "n_raw_tokens", bag_text("activation_vector").alias("bag"),
            F.sha2(prompt, 256).alias("prompt_sha256"), response.alias("response"), "activation_layer",
        )

    return TB.merge_tables([read(s) for s in SPLITS])


@query("s12_sidecar", with_ctes(*SQL_TRAINING, select="""
    SELECT split AS split_type, count(*) AS row_count, 64::BIGINT AS d_model, 'sqrt_d_model' AS mse_scale, false AS missing_is_empty_failed
    FROM training GROUP BY split"""))
def s12(spark, sf):
    """Sidecars of the three tables, read back from where they were written."""
    base = new_table_path(spark, "training")
    built_tables(spark, sf, base)
    missing = SC.read_sidecar(spark, f"{base}/none") != {}
    metas = [SC.read_sidecar(spark, f"{base}/{s}") for s in SPLITS]
    rows = [(m["split_type"], m["row_count"], m["extraction"]["d_model"], m["extraction"]["mse_scale"], missing) for m in metas]
    return spark.createDataFrame(rows, "split_type string, row_count bigint, d_model bigint, mse_scale string, missing_is_empty_failed boolean")
