"""Corpus scans: a window of documents by index, with provenance ids."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoframe.session import materialize

MAX_BROADCAST_FILES = 200_000


def provenance_id(corpus: str, split: str, index: Column) -> Column:
    return F.concat(F.lit(f"{corpus}:{split}:"), index.cast("string"))


def read_corpus(
    spark: SparkSession,
    path: str,
    corpus: str,
    split: str = "train",
    start: int = 0,
    length: int | None = None,
    text: str = "text",
    index: str | None = None,
) -> DataFrame:
    """Documents ``start .. start + length - 1`` as ``doc_id, text, corpus_index``.

    With an ``index`` column the window becomes a filter pushed into the scan.
    Without one the index is the position in file order: each file's own row
    index plus the rows of the files before it. Only the per-file counts are
    aggregated, from the footers; no document is shuffled, and of a window only
    the files that it touches are opened.
    """
    table = spark.read.parquet(path)
    if index is not None:
        rows = table.select(F.col(index).cast("bigint").alias("corpus_index"), F.col(text).alias("text"))
    else:
        offsets = _file_offsets(table)
        if start or length is not None:
            table = _files_of_window(table, offsets, start, length)
        located = table.select(
            F.col(text).alias("text"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
        )
        # one short row per file; checked, so that a scan of very many files falls back to a join
        small = offsets if offsets.count() > MAX_BROADCAST_FILES else F.broadcast(offsets)
        rows = located.join(small.select("_file", "_offset"), "_file").select(
            (F.col("_offset") + F.col("_row")).alias("corpus_index"), "text"
        )
    if start:
        rows = rows.filter(F.col("corpus_index") >= start)
    if length is not None:
        rows = rows.filter(F.col("corpus_index") < start + length)
    return rows.select(
        provenance_id(corpus, split, F.col("corpus_index")).alias("doc_id"), "text", "corpus_index"
    )


def _file_offsets(table: DataFrame) -> DataFrame:
    """``_file, _offset, count``: rows of a file and of all before it, a row per file."""
    files = table.groupBy(F.col("_metadata.file_path").alias("_file")).count()
    return materialize(files.withColumn("_offset", F.sum("count").over(W.orderBy("_file")) - F.col("count")), "corpus-files")


def _files_of_window(table: DataFrame, offsets: DataFrame, start: int, length: int | None) -> DataFrame:
    """The table over those of its files that hold a row of the window; over all where these are too many to list."""
    spark = table.sparkSession
    touched = offsets.filter(F.col("_offset") + F.col("count") > start)
    if length is not None:
        touched = touched.filter(F.col("_offset") < start + length)
    names = [r["_file"] for r in touched.select("_file").limit(MAX_BROADCAST_FILES + 1).collect()]
    names = names or [r["_file"] for r in offsets.select("_file").limit(1).collect()]  # a window behind the end opens one file in vain
    if not names or len(names) > MAX_BROADCAST_FILES:
        return table
    return spark.read.schema(table.schema).parquet(*(_as_path(n) for n in names))


def _as_path(url: str) -> str:
    """A file's path from the address that scans report, in which odd signs are percent-encoded."""
    return unquote(url).translate({ord(c): f"\\{c}" for c in "{}[]*?"})


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hand the rows of a small input to every core.

    A table whose scan has fewer splits than there are cores is redistributed
    before costly per-row work; a large one already has its splits and is left
    where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def first_rows(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """First ``n`` rows in key order: a per-partition top-n, then one merge of n rows each."""
    return df.orderBy(*keys).limit(n)
