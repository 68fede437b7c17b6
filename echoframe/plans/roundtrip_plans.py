"""Registered queries: verbalise, reconstruct, evaluate, pools and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoframe.functions import text as T
from echoframe.operators import evaluation as E
from echoframe.operators import inference as I
from echoframe.operators import joins as J
from echoframe.operators import labelling as L
from echoframe.operators import nearest as N
from echoframe.operators import pool as PL
from echoframe.operators.ridge import fit_ridge_sparse
from echoframe.operators.sampling import bucket_needs
from echoframe.plans import inputs
from echoframe.plans.catalog import query, table, with_ctes
from echoframe.plans.label_plans import SQL_ENCODED, SQL_EXPLAINED, bag_text, explained_and_vectors, sql_labels
from echoframe.plans.sampling_plans import SQL_CORPUS, SQL_POSITIONS, sql_ranked
from echoframe.plans.vector_plans import r6
from echoframe.session import materialize, new_table_path
from echoframe.sources.commits import last_commit
from echoframe.sources.corpus import read_corpus
from echoframe.streaming import jobs

ANCHORS = 32
D = 64

# One position per document, its label and its vector; 32 anchors in seeded order.
SQL_ONE = (inputs.SQL_TOKENS, inputs.sql_positions(1), sql_labels(), SQL_ENCODED, """
vec_norm AS (SELECT doc_id, n_raw_tokens, sqrt(sum(c * c)) AS norm FROM counts GROUP BY ALL),
anchors AS (
  SELECT doc_id, n_raw_tokens, api_explanation,
         row_number() OVER (ORDER BY sha256('42|' || doc_id || '|' || n_raw_tokens)) - 1 AS rank
  FROM explained QUALIFY rank < 32
),
anchor_counts AS (SELECT a.rank, c.b, c.c FROM anchors a JOIN counts c USING (doc_id, n_raw_tokens)),
anchor_norm AS (SELECT rank, sqrt(sum(c * c)) AS norm FROM anchor_counts GROUP BY rank),
dots AS (
  SELECT c.doc_id, c.n_raw_tokens, a.rank, sum(c.c * a.c) AS dot FROM counts c JOIN anchor_counts a USING (b) GROUP BY ALL
),
nearest AS (
  SELECT d.doc_id, d.n_raw_tokens, d.rank,
         row_number() OVER (PARTITION BY d.doc_id, d.n_raw_tokens ORDER BY round(d.dot / (v.norm * n.norm), 9) DESC, d.rank) - 1 AS sample_id
  FROM dots d JOIN vec_norm v USING (doc_id, n_raw_tokens) JOIN anchor_norm n USING (rank)
),
spoken AS (
  SELECT n.doc_id, n.n_raw_tokens, n.sample_id, n.rank, a.api_explanation AS explanation,
         '<explanation>' || chr(10) || a.api_explanation || chr(10) || '</explanation>' AS response
  FROM nearest n JOIN anchors a USING (rank)
)""")


def sql_rebuilt(content: str) -> str:
    """Hashed bag of ``content`` per anchor, and its score against every vector."""
    return rf"""
rebuilt AS (
  SELECT rank, b, count(*) AS c FROM (
    SELECT rank, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS b
    FROM (SELECT rank, unnest(regexp_extract_all({content}, '[ \n\t\r]*[^ \n\t\r]+')) AS tok FROM anchors))
  GROUP BY ALL
),
rebuilt_norm AS (SELECT rank, sqrt(sum(c * c)) AS norm FROM rebuilt GROUP BY rank),
agreement AS (
  SELECT s.doc_id, s.n_raw_tokens, s.explanation, s.response, s.rank,
         coalesce(sum(c.c * r.c), 0) / (any_value(v.norm) * any_value(n.norm)) AS cos
  FROM spoken s JOIN vec_norm v USING (doc_id, n_raw_tokens) JOIN rebuilt_norm n ON n.rank = s.rank
  JOIN counts c ON c.doc_id = s.doc_id AND c.n_raw_tokens = s.n_raw_tokens LEFT JOIN rebuilt r ON r.rank = s.rank AND r.b = c.b
  WHERE s.sample_id = 0 GROUP BY ALL
)"""


def one_per_document(spark, sf):
    """Positions (one per document), their vectors and the codebook over their labels."""
    rows = materialize(inputs.positions(spark, sf, 1), "positions")
    vectors = materialize(I.encode(rows, D), "vectors")
    labelled = materialize(J.join_vectors(L.label(rows, stored=True, text=False), vectors, check=False), "labelled")
    book = I.fit_codebook(labelled, ["doc_id", "n_raw_tokens"], size=ANCHORS)
    return rows, vectors, book


@query("u4_verbalise", with_ctes(*SQL_ONE, select="""
    SELECT doc_id, n_raw_tokens, sample_id::INTEGER AS sample_id, response FROM spoken WHERE sample_id < 3"""))
def u4(spark, sf):
    _, vectors, book = one_per_document(spark, sf)
    return I.verbalise(vectors, book, samples=3).select("doc_id", "n_raw_tokens", "sample_id", "response")


@query("u4_nearest_label", with_ctes(*SQL_ONE[:4], """
    vec_norm AS (SELECT doc_id, n_raw_tokens, sqrt(sum(c * c)) AS norm FROM counts GROUP BY ALL),
    pairs AS (
      SELECT q.doc_id, q.n_raw_tokens, l.doc_id AS near_doc_id, l.n_raw_tokens AS near_n_raw_tokens, sum(q.c * l.c) AS dot
      FROM counts q JOIN (SELECT * FROM counts SEMI JOIN explained USING (doc_id, n_raw_tokens)) l USING (b) GROUP BY ALL
    ),
    scored AS (
      SELECT p.*, round(dot / a.norm / b.norm, 9) AS similarity FROM pairs p JOIN vec_norm a USING (doc_id, n_raw_tokens)
      JOIN vec_norm b ON b.doc_id = near_doc_id AND b.n_raw_tokens = near_n_raw_tokens
    ),
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id, n_raw_tokens ORDER BY similarity DESC, near_doc_id, near_n_raw_tokens) - 1 AS sample_id FROM scored
    )""", select="""
    SELECT doc_id, n_raw_tokens, sample_id::INTEGER AS sample_id, near_doc_id, near_n_raw_tokens, similarity FROM numbered WHERE sample_id < 3"""))
def u4_nearest(spark, sf):
    """The three nearest of all labelled vectors, exactly."""
    rows = materialize(inputs.positions(spark, sf, 1), "positions")
    vectors = materialize(I.encode(rows, D), "vectors")
    labelled = materialize(J.join_vectors(L.label(rows, stored=True, text=False), vectors, check=False), "labelled")
    near = N.nearest_labels(vectors, labelled, ["doc_id", "n_raw_tokens"], samples=3)
    return near.select("doc_id", "n_raw_tokens", "sample_id", "near_doc_id", "near_n_raw_tokens", "similarity")


@query("u5_reconstruct", r"""
    SELECT conv_id, turn, string_agg(b || ':' || c, ' ' ORDER BY b) AS bag FROM (
      SELECT conv_id, turn, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS b, count(*) AS c
      FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[ \n\t\r]*[^ \n\t\r]+')) AS tok FROM conversations)
      GROUP BY ALL) GROUP BY ALL""")
def u5(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", I.reconstruct_bag("text", D).alias("v"))
    return rows.select("conv_id", "turn", bag_text("v").alias("bag"))


# Sums of a ridge fit of the ten-position vectors on their explanations, eight features.
@query("u5_fit_sums", with_ctes(*SQL_EXPLAINED, SQL_ENCODED, r"""
    words AS (
      SELECT doc_id, n_raw_tokens, b, count(*) AS x FROM (
        SELECT doc_id, n_raw_tokens, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 8 AS b
        FROM (SELECT doc_id, n_raw_tokens, unnest(regexp_extract_all(api_explanation, '[ \n\t\r]*[^ \n\t\r]+')) AS tok FROM explained))
      GROUP BY ALL
      UNION ALL SELECT doc_id, n_raw_tokens, 8, 1 FROM explained
    ),
    both_sides AS (
      SELECT doc_id, n_raw_tokens, b AS j, x AS y FROM words
      UNION ALL SELECT doc_id, n_raw_tokens, b + 9, c FROM counts
    )""", select="""
    SELECT w.b * 73 + o.j AS cell, sum(w.x * o.y)::DOUBLE AS value FROM words w JOIN both_sides o USING (doc_id, n_raw_tokens) GROUP BY ALL"""))
def u5_fit(spark, sf):
    labelled = J.join_vectors(*explained_and_vectors(spark, sf), check=False)
    sums = I.gram_sums(labelled, "api_explanation", "activation_vector", 8, D)
    cells = sums.select(F.posexplode("gram").alias("cell", "value"))
    return cells.filter("value <> 0").select(F.col("cell").cast("bigint").alias("cell"), "value")


@query("u5_fit_ridge")
def u5_ridge(spark, sf):
    """Trained reconstruction of every labelled vector; solved outside SQL."""
    labelled = materialize(J.join_vectors(*explained_and_vectors(spark, sf, 2), check=False), "labelled")
    model = I.fit_ridge(labelled, features=64, d_model=D)
    return labelled.select("doc_id", "n_raw_tokens", model.predict("api_explanation").alias("predicted"))


@query("u5_ridge_residual", with_ctes(*SQL_ONE[:4], r"""
    words AS (
      SELECT doc_id, n_raw_tokens, f, count(*) AS x FROM (
        SELECT doc_id, n_raw_tokens, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 262144 AS f
        FROM (SELECT doc_id, n_raw_tokens, unnest(regexp_extract_all(api_explanation, '[ \n\t\r]*[^ \n\t\r]+')) AS tok FROM explained))
      GROUP BY ALL
      UNION ALL SELECT doc_id, n_raw_tokens, 262144, 1 FROM explained
    ),
    right_side AS (SELECT f, b AS dim, sum(x * c) AS v FROM words JOIN counts USING (doc_id, n_raw_tokens) GROUP BY ALL)""", select="""
    SELECT dim, round(sqrt(sum(v * v)), 6) AS right_norm, 0.0::DOUBLE AS residual, (SELECT count(DISTINCT f) - 1 FROM words) AS n_features
    FROM right_side GROUP BY dim"""))
def u5_residual(spark, sf):
    """A fit over 2^18 features: what is left of the normal equations, per output."""
    rows = materialize(inputs.positions(spark, sf, 1), "positions")
    vectors = materialize(I.encode(rows, D), "vectors")
    model = fit_ridge_sparse(J.join_vectors(L.label(rows, stored=True, text=False), vectors, check=False), penalty=100.0, tolerance=1e-7)
    table_ = [(k, float(n), float(r), len(model.active)) for k, (n, r) in enumerate(zip(model.right_norms, model.residuals, strict=True))]
    out = spark.createDataFrame(table_, "dim bigint, right_norm double, residual double, n_features bigint")
    return out.select("dim", r6("right_norm").alias("right_norm"), r6("residual").alias("residual"), "n_features")


@query("l12_roundtrip_eval", with_ctes(*SQL_ONE, sql_rebuilt("api_explanation"), select="""
    SELECT row_number() OVER (ORDER BY doc_id, n_raw_tokens) - 1 AS idx, doc_id, substr(detokenized_text_truncated, 1, 200) AS text,
           n_raw_tokens - 1 AS position, explanation, response AS raw_output, round(2 * (1 - cos), 6) AS mse, round(cos, 6) AS cos
    FROM agreement JOIN positions USING (doc_id, n_raw_tokens)"""))
def l12(spark, sf):
    rows, vectors, book = one_per_document(spark, sf)
    out = E.roundtrip_eval(rows, vectors, book, lambda c: I.reconstruct_bag(c, D))
    return out.select("idx", "doc_id", "text", "position", "explanation", "raw_output", r6("mse").alias("mse"), r6("cos").alias("cos"))


SQL_FVE = r"""
chosen AS (
  SELECT doc_id, n_raw_tokens FROM (
    SELECT doc_id, n_raw_tokens, row_number() OVER (ORDER BY sha256('7|' || doc_id || '|' || n_raw_tokens)) - 1 AS r, count(*) OVER () AS n
    FROM vec_norm) WHERE r < n // 2
),
unit AS (
  SELECT doc_id, n_raw_tokens, b, coalesce(c, 0) / (norm / 8.0) AS x
  FROM (SELECT c.doc_id, c.n_raw_tokens, v.norm, b FROM chosen c JOIN vec_norm v USING (doc_id, n_raw_tokens), range(64) t(b))
  LEFT JOIN counts USING (doc_id, n_raw_tokens, b)
),
mu AS (SELECT b, avg(x) AS m FROM unit GROUP BY b),
mu_norm AS (SELECT sqrt(sum(m * m)) AS nm FROM mu),
base AS (
  SELECT avg((x - m) ** 2) AS rawvar, avg((x - m / (nm / 8.0)) ** 2) AS meannorm FROM unit JOIN mu USING (b), mu_norm
)"""


@query("l13_fve_report", with_ctes(*SQL_ONE, sql_rebuilt("api_explanation"), SQL_FVE, select="""
    SELECT count(*) AS n_evaluated, 0::BIGINT AS n_failed, round(avg(2 * (1 - cos)), 6) AS mse, round(any_value(rawvar), 6) AS rawvar,
           round(any_value(meannorm), 6) AS meannorm, round(1 - avg(2 * (1 - cos)) / any_value(rawvar), 6) AS fve_nrm,
           round(1 - avg(2 * (1 - cos)) / any_value(meannorm), 6) AS fve_nrm_meannorm, round(-avg(2 * (1 - cos)), 6) AS reward_equivalent
    FROM agreement JOIN chosen USING (doc_id, n_raw_tokens), base"""))
def l13(spark, sf):
    """Half of the vectors, sampled by seed, described, reconstructed and scored."""
    _, vectors, book = one_per_document(spark, sf)
    results = E.evaluate_vectors(vectors, book, ["doc_id", "n_raw_tokens"], lambda n: n // 2, lambda c: I.reconstruct_bag(c, D), seed=7)
    report = E.fve_report(results)
    return report.select("n_evaluated", "n_failed", *[r6(c).alias(c) for c in report.columns[2:]])


@query("s11_results_jsonl", with_ctes(*SQL_ONE, sql_rebuilt("api_explanation"), select="""
    SELECT doc_id, n_raw_tokens, explanation, (SELECT string_agg(b || ':' || c, ' ' ORDER BY b) FROM rebuilt r WHERE r.rank = agreement.rank) AS bag
    FROM agreement"""))
def s11(spark, sf):
    """Per-sample results as JSON lines, read back."""
    _, vectors, book = one_per_document(spark, sf)
    path = new_table_path(spark, "results")
    E.write_results(E.evaluate_vectors(vectors, book, ["doc_id", "n_raw_tokens"], None, lambda c: I.reconstruct_bag(c, D)), path)
    back = spark.read.schema("doc_id string, n_raw_tokens bigint, explanation string, ar_vector array<float>").json(path)
    return back.select("doc_id", "n_raw_tokens", "explanation", bag_text("ar_vector").alias("bag"))


@query("l14_translate", with_ctes(*SQL_ONE, sql_rebuilt("'Summary of the following text: <text>' || api_explanation || '</text> <summary>'"), select="""
    SELECT doc_id, n_raw_tokens, response AS actor_output, explanation, round(norm, 6) AS ar_vector_norm
    FROM agreement JOIN rebuilt_norm USING (rank)"""))
def l14(spark, sf):
    _, vectors, book = one_per_document(spark, sf)
    out = E.translate(vectors, book, D)
    return out.select("doc_id", "n_raw_tokens", "actor_output", "explanation", r6("ar_vector_norm").alias("ar_vector_norm"))


# ---- pools and streams -----------------------------------------------------------------------

# First run: needs of n/4 documents from the start of the corpus. Second run: needs
# of n/2; each bucket is filled up from the next documents.
SQL_POOL = (SQL_CORPUS, """
sizes AS (SELECT count(*) // 4 AS d1, count(*) // 2 AS d2 FROM corpus),
needs AS (
  SELECT d1, floor(d1 * 0.25) AS av1, d1 - 2 * floor(d1 * 0.25) AS rl1, floor(d2 * 0.25) AS av2, d2 - 2 * floor(d2 * 0.25) AS rl2
  FROM sizes
),
usable AS (
  SELECT 'documents:train:' || doc_id AS doc_id, doc_id AS i FROM documents
  WHERE len(regexp_extract_all(text, '[ \\n\\t\\r]*[^ \\n\\t\\r]+')) > 50
),
first_ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY sha256('42|' || doc_id)) - 1 AS r FROM usable, needs WHERE i < d1
),
first_pool AS (
  SELECT doc_id, CASE WHEN r < av1 THEN 'av' WHEN r < 2 * av1 THEN 'ar' ELSE 'rl' END AS bucket FROM first_ranked, needs
),
have AS (
  SELECT count(*) FILTER (bucket = 'av') AS av, count(*) FILTER (bucket = 'ar') AS ar, count(*) FILTER (bucket = 'rl') AS rl FROM first_pool
),
lack AS (
  SELECT greatest(0, av2 - av) AS av, greatest(0, av2 - ar) AS ar, greatest(0, rl2 - rl) AS rl, d1 FROM needs, have
),
second_ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY sha256('42|' || doc_id)) - 1 AS r FROM usable, lack
  WHERE i >= d1 AND i < d1 + av + ar + rl
),
second_pool AS (
  SELECT doc_id, CASE WHEN r < av THEN 'av' WHEN r < av + ar THEN 'ar' ELSE 'rl' END AS bucket FROM second_ranked, lack
),
pool AS (SELECT * FROM first_pool UNION ALL SELECT * FROM second_pool)""")


def grown_pool(spark, sf):
    path = f"{sf}/documents.parquet"

    def window(start, length):
        return read_corpus(spark, path, "documents", start=start, length=length, index="doc_id")

    n = table(spark, sf, "documents").count()
    pool = new_table_path(spark, "pool")
    for docs in (n // 4, n // 2):
        PL.grow_pool(spark, pool, window, bucket_needs(docs), positions_per_doc=2)
    return pool


@query("l6_grow_pool", with_ctes(*SQL_POOL, select="SELECT doc_id, bucket, (SELECT d1 + av + ar + rl FROM lack)::BIGINT AS next_start FROM pool"))
def l6(spark, sf):
    """Two runs with growing needs; a document never changes its bucket."""
    pool = grown_pool(spark, sf)
    cursor = last_commit(spark, pool)["facts"][PL.CURSOR]
    rows = PL.pool_positions(spark, pool).select("doc_id", "bucket").distinct()
    return rows.withColumn("next_start", F.lit(cursor).cast("bigint"))


@query("l7_model_output", with_ctes(*SQL_POOL, """
    counted AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sha256('42|' || doc_id)) - 1 AS r FROM pool)""", select="""
    SELECT doc_id, bucket, bucket = 'av' AS has_explanation FROM counted, needs WHERE bucket <> 'ar' AND r < av1"""))
def l7(spark, sf):
    """Outputs of a labelled and an unlabelled bucket, downsampled by document."""
    pool = grown_pool(spark, sf)
    PL.label_pool(spark, pool)
    need = bucket_needs(table(spark, sf, "documents").count() // 4)["av"]

    def out(bucket):
        rows = PL.model_output(spark, pool, bucket, need)
        flag = F.lit("api_explanation" in rows.columns)
        return rows.select("doc_id", F.lit(bucket).alias("bucket"), flag.alias("has_explanation")).distinct()

    return out("av").unionByName(out("rl"))


@query("st1_ingest_stream", with_ctes(inputs.SQL_TOKENS, """
    usable AS (SELECT doc_id FROM tokens WHERE len(toks) > 50)""", sql_ranked("usable"), """
    needs AS (SELECT count(*) // 2 AS d FROM documents)""", select="""
    SELECT doc_id, CASE WHEN rank < floor(d * 0.25) THEN 'av' WHEN rank < 2 * floor(d * 0.25) THEN 'ar' ELSE 'rl' END AS bucket
    FROM ranked, needs WHERE rank < d"""))
def st1(spark, sf):
    """The documents, one file or a folder of them, streamed into a pool, twice with the same checkpoint."""
    docs = table(spark, sf, "documents")
    needs = bucket_needs(docs.count() // 2)
    pool, checkpoint = new_table_path(spark, "stream-pool"), new_table_path(spark, "stream-checkpoint")
    source = f"{sf}/{{documents.parquet}}"  # a pattern: a plain path of a stream has to be a folder
    for _ in range(2):
        jobs.ingest_corpus(
            spark, source, docs.schema, pool, needs, checkpoint, corpus="documents", positions_per_doc=1
        ).awaitTermination()
    return PL.pool_positions(spark, pool).select("doc_id", "bucket")


@query("st2_label_stream", with_ctes(inputs.SQL_TOKENS, inputs.sql_positions(2), sql_labels(), select="""
    SELECT doc_id, n_raw_tokens, api_explanation FROM explained"""))
def st2(spark, sf):
    """Positions arriving in two deliveries, the second repeating the first; each is labelled once."""
    rows = materialize(inputs.positions(spark, sf, 2), "positions")
    source, target = new_table_path(spark, "arriving"), new_table_path(spark, "stream-labels")
    checkpoint = new_table_path(spark, "stream-checkpoint")
    for part in (rows.filter("n_raw_tokens % 2 = 0"), rows):
        part.write.mode("append").parquet(source)
        jobs.label_stream(spark, source, target, checkpoint).awaitTermination()
    return L.labelled(spark, target).select("doc_id", "n_raw_tokens", "api_explanation")
