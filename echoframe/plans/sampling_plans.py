"""Registered queries: deterministic order, samples, splits, sets of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoframe.operators import aggregates as A
from echoframe.operators import joins as J
from echoframe.operators import sampling as S
from echoframe.plans import inputs
from echoframe.plans.catalog import query, table, with_ctes
from echoframe.session import new_table_path
from echoframe.sources import tables as TB
from echoframe.sources.corpus import read_corpus

SQL_CORPUS = "corpus AS (SELECT 'documents:train:' || doc_id AS doc_id, text FROM documents)"


def sql_ranked(source: str, name: str = "ranked", seed: str = "42", key: str = "doc_id") -> str:
    return f"""
{name} AS (
  SELECT k AS {key}, row_number() OVER (ORDER BY sha256('{seed}|' || k)) - 1 AS rank, count(*) OVER () AS n
  FROM (SELECT DISTINCT {key} AS k FROM {source})
)"""


SQL_SPLIT = """
split_docs AS (
  SELECT doc_id, CASE WHEN rank < floor(n * 0.25) THEN 'av_sft'
                      WHEN rank < floor(n * 0.25) + floor(n * 0.25) THEN 'ar_sft' ELSE 'rl' END AS split
  FROM ranked
)"""
SQL_POSITIONS = (inputs.SQL_TOKENS, inputs.sql_positions())


@query("r0_seeded_rank", with_ctes(SQL_CORPUS, sql_ranked("corpus"), select="SELECT doc_id, rank FROM ranked"))
def r0(spark, sf):
    return S.seeded_rank(inputs.documents(spark, sf).select("doc_id"), ["doc_id"])


@query("r2_split_documents", with_ctes(SQL_CORPUS, sql_ranked("corpus"), SQL_SPLIT, select="SELECT doc_id, split FROM split_docs"))
def r2(spark, sf):
    return S.split_documents(inputs.documents(spark, sf).select("doc_id"))


@query("r3_assign_by_deficit", with_ctes(SQL_CORPUS, sql_ranked("corpus"), """
    needs AS (SELECT count(*) // 2 AS d FROM corpus),
    bounds AS (SELECT greatest(0, floor(d * 0.25) - 10) AS av, greatest(0, floor(d * 0.25) - 20) AS ar,
                      d - 2 * floor(d * 0.25) AS rl FROM needs)""", select="""
    SELECT doc_id, CASE WHEN rank < av THEN 'av' WHEN rank < av + ar THEN 'ar' WHEN rank < av + ar + rl THEN 'rl' END AS bucket
    FROM ranked, bounds"""))
def r3(spark, sf):
    """New documents against the needs of a pool that already holds a few."""
    docs = inputs.documents(spark, sf).select("doc_id")
    needs = S.bucket_needs(docs.count() // 2)
    return S.assign_by_deficit(docs, S.deficits(needs, {"av": 10, "ar": 20}))


@query("r4_downsample_documents", with_ctes(*SQL_POSITIONS, sql_ranked("positions"), select="""
    SELECT p.doc_id, p.n_raw_tokens FROM positions p JOIN ranked r USING (doc_id) WHERE r.rank < r.n * 2 // 5"""))
def r4(spark, sf):
    rows = inputs.positions(spark, sf).select("doc_id", "n_raw_tokens")
    return S.sample_documents(rows, lambda n: n * 2 // 5)


@query("r5_half_of_documents", with_ctes(*SQL_POSITIONS, sql_ranked("positions"), select="""
    SELECT p.doc_id, p.n_raw_tokens FROM positions p JOIN ranked r USING (doc_id) WHERE r.rank < r.n // 2"""))
def r5(spark, sf):
    return S.half_of_documents(inputs.positions(spark, sf).select("doc_id", "n_raw_tokens"))


@query("r7_range_shards", with_ctes(SQL_CORPUS, """
    sorted AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM corpus)""", select="""
    SELECT doc_id, (SELECT min(s) FROM range(7) t(s) WHERE (s + 1) * n // 7 > r)::INTEGER AS shard_id FROM sorted"""))
def r7(spark, sf):
    return S.range_shards(inputs.documents(spark, sf).select("doc_id"), 7)


@query("r8_sample_rows", """
    SELECT vec_id, label FROM (
      SELECT vec_id, label, row_number() OVER (ORDER BY sha256('42|' || vec_id)) - 1 AS r, count(*) OVER () AS n FROM embeddings)
    WHERE r < n // 4""")
def r8(spark, sf):
    return S.sample_rows(table(spark, sf, "embeddings").select("vec_id", "label"), lambda n: n // 4, ["vec_id"])


@query("r9_chunk_numbers", with_ctes(*SQL_POSITIONS, select="""
    SELECT doc_id, n_raw_tokens, (row_number() OVER (ORDER BY doc_id, n_raw_tokens) - 1) // 512 * 512 AS chunk_start
    FROM positions"""))
def r9(spark, sf):
    rows = inputs.positions(spark, sf).select("doc_id", "n_raw_tokens")
    return S.chunk_starts(rows, ["doc_id", "n_raw_tokens"])


@query("r10_epoch_batches", """
    SELECT vec_id, r % 4 AS worker, r // 4 // 16 AS batch_id FROM (
      SELECT vec_id, row_number() OVER (ORDER BY sha256('42|1|' || vec_id)) - 1 AS r, count(*) OVER () AS n FROM embeddings)
    WHERE r // 4 // 16 < n // 4 // 16""")
def r10(spark, sf):
    return S.epoch_batches(table(spark, sf, "embeddings").select("vec_id"), ["vec_id"], world=4, batch=16, epoch=1)


@query("j4_keep_documents", """
    SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def j4(spark, sf):
    chosen = table(spark, sf, "labels").filter("quality = 1")
    return J.keep_documents(table(spark, sf, "documents").select("doc_id", "lang", "source"), chosen)


@query("j4_sketched_documents", """
    SELECT doc_id, sha256(text) AS text_sha256 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def j4_sketched(spark, sf):
    """The same of wide rows: a sketch of the ids goes ahead of the join."""
    chosen = table(spark, sf, "labels").filter("quality = 1")
    rows = J.keep_documents(table(spark, sf, "documents").select("doc_id", "text"), chosen, sketched=True)
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("o2_distinct_documents", with_ctes(*SQL_POSITIONS, select="SELECT DISTINCT doc_id FROM positions"))
def o2(spark, sf):
    return inputs.positions(spark, sf).select("doc_id").distinct()


@query("a1_document_count", with_ctes(*SQL_POSITIONS, select="SELECT count(DISTINCT doc_id) AS n_docs FROM positions"))
def a1(spark, sf):
    return TB.distinct_count(inputs.positions(spark, sf))


@query("a2_positions_by_document", with_ctes(*SQL_POSITIONS, select="""
    SELECT doc_id, string_agg(n_raw_tokens, ',' ORDER BY n_raw_tokens) AS positions, max(n_raw_tokens) AS max_n_raw_tokens,
           sha256(max_by(detokenized_text_truncated, n_raw_tokens)) AS longest_sha256
    FROM positions GROUP BY doc_id"""))
def a2(spark, sf):
    docs = A.positions_by_document(inputs.positions(spark, sf))
    return docs.select(
        "doc_id",
        F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"),
        "max_n_raw_tokens",
        F.sha2("longest_text", 256).alias("longest_sha256"),
    )


@query("a5_split_counts", with_ctes(*SQL_POSITIONS, sql_ranked("positions"), SQL_SPLIT, select="""
    SELECT split, count(DISTINCT doc_id) AS n_docs, count(*) AS n_rows
    FROM positions JOIN split_docs USING (doc_id) GROUP BY split"""))
def a5(spark, sf):
    return A.split_counts(S.split_documents(inputs.positions(spark, sf).select("doc_id")))


@query("l3_write_splits", with_ctes(*SQL_POSITIONS, sql_ranked("positions"), SQL_SPLIT, select="""
    SELECT doc_id, n_raw_tokens, sha256(detokenized_text_truncated) AS text_sha256, split
    FROM positions JOIN split_docs USING (doc_id)"""))
def l3(spark, sf):
    """Split and write every split in one partitioned job, then read the table back."""
    rows = S.split_documents(inputs.positions(spark, sf))
    written = TB.write_splits(rows, new_table_path(spark, "splits"))
    return written.select("doc_id", "n_raw_tokens", F.sha2("detokenized_text_truncated", 256).alias("text_sha256"), "split")


@query("s13_split_sink_counts", with_ctes(SQL_CORPUS, sql_ranked("corpus"), SQL_SPLIT, select="""
    SELECT split, count(*) AS n_docs FROM split_docs GROUP BY split"""))
def s13(spark, sf):
    """One sink for all splits, read back per split directory."""
    docs = S.split_documents(inputs.documents(spark, sf).select("doc_id"))
    written = TB.write_splits(docs, new_table_path(spark, "split-sink"))
    return written.groupBy("split").agg(F.count(F.lit(1)).alias("n_docs"))


@query("k1_sorted_output", with_ctes(*SQL_POSITIONS, select="""
    SELECT doc_id, n_raw_tokens, row_number() OVER (ORDER BY doc_id, n_raw_tokens) - 1 AS place FROM positions"""))
def k1(spark, sf):
    """The place of every row in the written files, read in file order."""
    rows, path = inputs.positions(spark, sf).select("doc_id", "n_raw_tokens"), new_table_path(spark, "sorted")
    TB.sorted_by(rows, "doc_id", "n_raw_tokens").select(F.struct("doc_id", "n_raw_tokens").alias("row")).write.parquet(path)
    back = read_corpus(spark, path, "sorted", text="row")
    return back.select("text.doc_id", "text.n_raw_tokens", F.col("corpus_index").alias("place"))


@query("s2_table_scan", "SELECT vec_id, label, embedding[1] AS first_value, len(embedding) AS width FROM embeddings")
def s2(spark, sf):
    rows = TB.read_table(spark, f"{sf}/embeddings.parquet")
    return rows.select("vec_id", "label", F.get("embedding", F.lit(0)).alias("first_value"), F.size("embedding").cast("bigint").alias("width"))


@query("s5_write_declared_schema", with_ctes(*SQL_POSITIONS, select="""
    SELECT doc_id, n_raw_tokens, sha256(detokenized_text_truncated) AS text_sha256 FROM positions"""))
def s5(spark, sf):
    written = TB.write_table(inputs.positions(spark, sf), new_table_path(spark, "positions"), TB.POSITIONS)
    return written.select("doc_id", "n_raw_tokens", F.sha2("detokenized_text_truncated", 256).alias("text_sha256"))


@query("s10_merge_shards", with_ctes(SQL_CORPUS, select="SELECT doc_id, sha256(text) AS text_sha256 FROM corpus"))
def s10(spark, sf):
    """Four shard tables, merged again with a row-count check."""
    docs = S.range_shards(inputs.documents(spark, sf).select("doc_id", F.sha2("text", 256).alias("text_sha256")), 4)
    base = new_table_path(spark, "shards")
    docs.write.partitionBy("shard_id").parquet(base)
    parts = [spark.read.parquet(f"{base}/shard_id={i}") for i in range(4)]
    return TB.merge_tables(parts, expected_rows=docs.count())


@query("o1_append_rows", with_ctes(SQL_CORPUS, select="SELECT doc_id FROM corpus"))
def o1(spark, sf):
    """Half of the rows, then all of them: the second append adds only what is new."""
    docs = inputs.documents(spark, sf).select("doc_id")
    path = new_table_path(spark, "appended")
    TB.append_rows(spark, S.half_of_documents(docs), path, ["doc_id"])
    return TB.append_rows(spark, docs, path, ["doc_id"])
