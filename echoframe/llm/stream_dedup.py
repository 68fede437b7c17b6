"""Exact deduplication by a stream whose keyed state lives on disk and never expires.

Files of documents arrive as a stream. The state holds one entry per digest of
the normalised text: the stable identifier and the content locator (file and
row in it) of the row that stays, and the number of rows seen. It is kept in
RocksDB and checkpointed to the shared folder, without a watermark, so a copy
is found however much later it comes. Copies combine inside the tasks before
they meet, so a text of any number of copies is one update per task.

A digest that was met before is a hit, not yet a copy: the rows of all digests
with several rows are opened again by their locators and grouped by their full
normalised bytes. Where two texts of one digest differ, each gets a group of
its own.

Everything here is DataFrame and SQL functions; no Python runs in a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoframe.llm.ngram_join import marked
from echoframe.session import materialize
from echoframe.streaming.state import STATE_CONF, settings

#: What equality ignores.
BLANKS = r"[\x20\x09-\x0D]"
FILES_PER_BATCH = 1000

Digest = Callable[[Column], Column]


def sha256(normal: Column) -> Column:
    return F.sha2(normal, 256)


def normal_text(text: str = "text") -> Column:
    """The text without blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def fingerprints(docs: DataFrame, digest: Digest = sha256, *more: Column) -> DataFrame:
    """``digest, text_sha256, place`` of rows of files, streaming or not, and ``more`` of each.

    ``place`` orders the rows of a text, the one that stays last: most code
    points, then an id before none, the smallest id, the last file and row.
    """
    normal = normal_text()
    place = F.struct(
        F.char_length(F.coalesce(F.col("text"), F.lit(""))).alias("points"), F.col("doc_id").isNotNull().alias("named"),
        F.bitwise_not(F.col("doc_id").cast("long")).alias("inverse"),  # descending, without the overflow of a minus
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    return docs.select(digest(normal).alias("digest"), F.sha2(normal, 256).alias("text_sha256"), place.alias("place"), *more)


def ingest(
    spark: SparkSession, path: str, checkpoint: str, digest: Digest = sha256, files_per_batch: int = FILES_PER_BATCH,
    state_partitions: int | None = None,
) -> None:
    """Take every file under ``path`` that the state under ``checkpoint`` has not seen into it.

    Run again with new files it reads those alone; after a crash the same call
    goes on with the batch that was open. ``state_partitions`` is fixed by the
    first call for the life of the state.
    """
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    # a pattern that fits this path alone: a stream takes a pattern where it refuses a lone file
    pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    groups = fingerprints(docs, digest).groupBy("digest").agg(F.max("place").alias("stays"), F.count(F.lit(1)).alias("rows"))
    partitions = {"spark.sql.shuffle.partitions": str(state_partitions)} if state_partitions else {}
    with settings(spark, STATE_CONF | partitions):
        stream = (
            groups.writeStream.outputMode("update").format("noop")  # the state itself is the result
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    stream.awaitTermination()


def state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``digest, stays, rows`` of every entry of the state as of the last batch."""
    entries = spark.read.format("statestore").option("path", checkpoint).load()
    return entries.select("key.digest", F.col("value.max").alias("stays"), F.col("value.count").alias("rows"))


def _answer(rows: DataFrame) -> DataFrame:
    kept = (F.col("place.file") == F.col("stays.file")) & (F.col("place.row") == F.col("stays.row"))
    return rows.select(
        F.bitwise_not("place.inverse").alias("doc_id"), F.bitwise_not("stays.inverse").alias("keep_id"), F.col("rows").alias("group_size"),
        kept.alias("kept"), "text_sha256",
    )


def decide(spark: SparkSession, path: str, checkpoint: str, digest: Digest = sha256) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row under ``path``, by the state under ``checkpoint``.

    One row of each group has ``kept``, also where ids are null or repeat: rows
    are told apart by file and place in it. A null text counts as empty; empty
    and blank texts are equal to each other. Columns other than ``doc_id`` and
    ``text`` are not looked at. An empty table gives no rows.
    """
    docs = spark.read.parquet(path).select("doc_id", "text", "_metadata")
    rows = materialize(fingerprints(docs, digest), "dedup-rows")
    entries = materialize(state(spark, checkpoint), "dedup-state")
    grouped = rows.join(entries, "digest")
    hits = grouped.filter(F.col("rows") > 1).select(F.xxhash64("place.file", "place.row").alias("at_"))
    texts = docs.select(normal_text().alias("normal"), F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("at_"))
    opened = marked(texts, hits, "at_").select(digest(F.col("normal")).alias("digest"), "normal")
    # equal texts combine inside the tasks: what meets is each text once per task, not its copies
    different = opened.groupBy("digest", "normal").count().groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    clashes = materialize(different.select("digest"), "dedup-clashes")
    if clashes.limit(1).count() == 0:
        return _answer(grouped)
    # digests of several texts: their rows go by the texts themselves
    apart = fingerprints(docs, digest, normal_text().alias("normal"))
    apart = marked(apart, clashes, "digest").join(clashes, "digest", "left_semi")
    exact = apart.groupBy("digest", "normal").agg(F.max("place").alias("stays"), F.count(F.lit(1)).alias("rows"))
    return _answer(grouped.join(clashes, "digest", "left_anti")).union(_answer(apart.join(exact, ["digest", "normal"])))


def deduplicate(spark: SparkSession, path: str, checkpoint: str, digest: Digest = sha256) -> DataFrame:
    """Take in what is new under ``path`` and decide on all its rows."""
    ingest(spark, path, checkpoint, digest)
    return decide(spark, path, checkpoint, digest)


#: The same rows in SQL.
DEDUP_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(normal) AS text_sha256
FROM t WINDOW w AS (PARTITION BY normal ORDER BY length(text) DESC, doc_id NULLS LAST)
"""
