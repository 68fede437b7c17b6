"""From raw documents to token counts in five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir); its rows are written as Parquet and read
again as the documents of the next. Models are fitted on the labelled rows of
the corpus in ``sf_dir``; everything else looks at the stage's own input.
Rows keep the columns of ``documents`` up to the last stage, whatever their
names; null and empty texts are scored like any other, and repeated rows stay
or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoframe.llm import bpe, decontamination, ngram_join, quality, toxicity
from echoframe.llm.queries import table, tokenizer_path
from echoframe.session import configure, materialize, new_table_path


def _with_row(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and all columns as one, so that no name can clash."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row_"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose id is not in ``gone``, a stored table of ids. Rows without an id stay; texts that stay are hardly moved."""
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("row_"))
    return ngram_join.without(rows, gone, "doc_id").select("row_.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored like others, rows of one id each by its own
    text, very long texts whole; an empty table stays empty.
    """
    weights = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(_with_row(docs), weights, keep=["row_"]).filter("predicted = 1").select("row_.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject.

    Null and empty texts have no hits and stay; rows of one id go by their own
    texts, very long texts are read whole; an empty table stays empty.
    """
    terms = toxicity.learn_lexicon(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(_with_row(docs), terms, keep=["row_"]).filter("predicted = 0").select("row_.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the row whose id names the group.

    Of several rows of that id all stay, as the join knows rows by their id;
    rows without an id are in no group and stay.
    """
    groups = ngram_join.join_documents(docs)
    return _without(docs, materialize(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "pipeline-copies"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark; one with a passage goes as a whole.

    All rows of an id with a passage go; rows without an id stay. Null and empty
    texts have no words and stay; an empty table stays empty.
    """
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, materialize(found.filter("n_hit > 0 and doc_id is not null").select("doc_id").distinct(), "pipeline-leaks"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left: a row per row, null texts as empty ones; an empty table gives no rows."""
    return bpe.encode_decode(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Classifiers, connected components and BPE merges are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_table_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
