"""Permanent pools of documents that grow on demand, and outputs drawn from them.

Layout: ``<pool>/positions/batch=<n>/bucket=<b>/`` with a commit record a batch,
``<pool>/labels/<b>/`` with the batches of a labelling job, and
``<pool>/pool_meta.json``. The record holds the documents per bucket, the corpus
cursor and the writers so far: they change with the rows, and counting reads no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from echoframe.functions import constants as C
from echoframe.operators.inference import Provider
from echoframe.operators.labelling import label_into, labelled
from echoframe.operators.positions import extract_positions
from echoframe.operators.sampling import assign_by_deficit, deficits, sample_documents
from echoframe.session import materialize
from echoframe.sources.commits import commit, last_commit, read_committed
from echoframe.sources.sidecar import read_json, write_json
from echoframe.sources.tables import POSITIONS

BUCKETS = ("av", "ar", "rl")
LABELLED = ("av", "ar")
CURSOR = "corpus_next_start"
POOL = StructType([*POSITIONS.fields, StructField("bucket", StringType())])

CorpusWindow = Callable[[int, int], DataFrame]


def meta_path(pool: str) -> str:
    return f"{pool}/pool_meta.json"


def pool_positions(spark: SparkSession, pool: str) -> DataFrame | None:
    return read_committed(spark, pool, "positions", POOL)


def pool_counts(spark: SparkSession, pool: str) -> dict[str, int]:
    """Documents per bucket; zero for a bucket that does not exist."""
    return dict.fromkeys(BUCKETS, 0) | last_commit(spark, pool)["facts"].get("documents", {})


def add_to_pool(
    spark: SparkSession, pool: str, positions: DataFrame, needs: dict[str, int], seed: int = C.SEED, facts: dict | None = None, known_new: bool = False
) -> int:
    """Assign new documents to the buckets that lack them and commit them with ``facts``. Returns the rows added.

    A document already in the pool is left where it is, so a repeated call after
    a crash adds nothing twice. Where the caller has stored the positions and
    knows that all are new the pool is not read.
    """
    have = pool_counts(spark, pool)
    lacking = deficits(needs, have)
    if not sum(lacking.values()):
        if facts:
            commit(spark, pool, {}, facts)
        return 0
    fresh = positions
    if not known_new:
        known = pool_positions(spark, pool)
        fresh = positions if known is None else positions.join(known.select("doc_id").distinct(), "doc_id", "left_anti")
        fresh = materialize(fresh.select(*POSITIONS.names), "pool-batch")
    assigned = materialize(assign_by_deficit(fresh, lacking, seed).filter(F.col("bucket").isNotNull()), "pool-assigned")
    added = {r["bucket"]: r["n"] for r in assigned.groupBy("bucket").agg(F.countDistinct("doc_id").alias("n")).collect()}
    documents = {b: have[b] + added.get(b, 0) for b in have}
    record = commit(spark, pool, {"positions": assigned}, {**(facts or {}), "documents": documents}, {"positions": ["bucket"]})
    return record["rows"]["positions"]


def grow_pool(
    spark: SparkSession,
    pool: str,
    corpus: CorpusWindow,
    needs: dict[str, int],
    seed: int = C.SEED,
    start: int = 0,
    **extraction,
) -> dict[str, int]:
    """Fill the buckets up to ``needs`` from the next part of the corpus.

    ``corpus(start, length)`` reads a window. Exactly as many documents as are
    lacking are read; documents too short to sample leave a rest for the next
    run. The cursor is committed with the rows and then noted in the meta file.
    """
    lacking = deficits(needs, pool_counts(spark, pool))
    total = sum(lacking.values())
    if total:
        facts = last_commit(spark, pool)["facts"]
        begin = facts.get(CURSOR, start)
        batch = extract_positions(corpus(begin, total), seed=seed, **extraction)
        writers = sorted({*facts.get("writers", []), "grow_pool"})
        add_to_pool(spark, pool, batch, needs, seed, {CURSOR: begin + total, "writers": writers})
        write_json(spark, meta_path(pool), {**read_json(spark, meta_path(pool)), CURSOR: begin + total})
    return pool_counts(spark, pool)


def label_pool(spark: SparkSession, pool: str, provider: Provider | str = "offline", **options) -> dict[str, dict[str, int]]:
    """Label the buckets that need explanations; finished rows are skipped."""
    rows = pool_positions(spark, pool)
    if rows is None:
        return {}
    return {
        b: label_into(spark, rows.filter(F.col("bucket") == b).drop("bucket"), f"{pool}/labels/{b}", provider, **options)
        for b in LABELLED
    }


def model_output(spark: SparkSession, pool: str, bucket: str, need: int, seed: int = C.SEED) -> DataFrame:
    """Rows of ``need`` documents of a bucket: explained rows when there are any, else positions."""
    rows = labelled(spark, f"{pool}/labels/{bucket}")
    if rows is None:
        everything = pool_positions(spark, pool)
        if everything is None:
            raise FileNotFoundError(f"no positions in pool {pool}")
        rows = everything.filter(F.col("bucket") == bucket).drop("bucket")
    return sample_documents(rows, need, seed)
