"""Incremental jobs: corpus files into a pool, and positions into labels.

What a stream has seen is keyed state on disk, so a micro-batch reads nothing
of what earlier ones wrote. Every micro-batch is one committed batch of its
target, with the number of the micro-batch in the record; one that is played
again after a crash rebuilds its state and commits nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.streaming import StreamingQuery

from echoframe.functions import constants as C
from echoframe.functions import text as T
from echoframe.operators.inference import Provider
from echoframe.operators.labelling import CACHED, KEYS, TEXT
from echoframe.operators.pool import add_to_pool
from echoframe.operators.positions import extract_positions
from echoframe.session import materialize
from echoframe.sources.commits import commit, last_commit
from echoframe.sources.corpus import provenance_id
from echoframe.sources.tables import POSITIONS
from echoframe.streaming.labeller import answered, labels_of
from echoframe.streaming.state import STATE_CONF, settings

STREAMS = "streams"
#: Most rows are new: counting those in the store would look up each key again before it is put.
LABEL_CONF = {**STATE_CONF, "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}
#: A stream's own session plans without adaptive execution; what follows its state is an ordinary join, with hot texts to split.
ADAPTIVE = {"spark.sql.adaptive.enabled": "true"}


def _start(spark: SparkSession, rows: DataFrame, step, checkpoint: str, mode: str, conf: dict[str, str] = STATE_CONF) -> StreamingQuery:  # noqa: ANN001
    with settings(spark, conf):
        return (
            rows.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )


def _played(facts: dict, checkpoint: str, number: int) -> bool:
    return facts.get(STREAMS, {}).get(checkpoint, -1) >= number


def _noted(facts: dict, checkpoint: str, number: int) -> dict:
    return {STREAMS: {**facts.get(STREAMS, {}), checkpoint: number}}


def ingest_corpus(
    spark: SparkSession,
    source: str,
    schema: Ty.StructType,
    pool: str,
    needs: dict[str, int],
    checkpoint: str,
    corpus: str = "corpus",
    split: str = "train",
    index: str = "doc_id",
    glob: str | None = None,
    files_per_batch: int = 1000,
    **extraction,
) -> StreamingQuery:
    """New corpus files go to the buckets that still need documents; the stream checkpoint is the cursor.

    Documents are told apart by state, so the pool is read only where somebody
    else wrote to it, too.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    docs = reader.parquet(source).select(provenance_id(corpus, split, F.col(index)).alias("doc_id"), "text").dropDuplicates(["doc_id"])

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = materialize(extract_positions(batch, **extraction).select(*POSITIONS.names), "pool-batch")  # this also runs the state
        facts = last_commit(session, pool)["facts"]
        if _played(facts, checkpoint, number):
            return
        writers = sorted({*facts.get("writers", []), checkpoint})
        add_to_pool(session, pool, rows, needs, facts={"writers": writers, **_noted(facts, checkpoint, number)}, known_new=writers == [checkpoint])

    return _start(spark, docs, step, checkpoint, "append")


def label_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    provider: Provider | str = "offline",
    files_per_batch: int = 1000,
    cache: DataFrame | None = None,
    template: str = C.INSTRUCTION_TEMPLATE,
    pattern: str = C.ANALYSIS_PATTERN,
    min_features: int = C.MIN_FEATURES,
    chunk_rows: int = C.CHUNK_ROWS,
) -> StreamingQuery:
    """Positions arriving as parquet files are answered once each, and each text is asked once.

    The answers are state, so a later copy of a text costs no call and a
    repeated position no row, and the target is never read. The target is that
    of ``label_into``: read it by ``labelled`` and ``audited``. After a crash
    between the commit and the checkpoint the texts of that one batch are asked again.
    """
    rows = spark.readStream.schema(POSITIONS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    found = answered(rows, provider, cache, template, chunk_rows)

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        stored = materialize(batch, "label-batch")  # this also runs the state
        facts = last_commit(session, target)["facts"]
        if _played(facts, checkpoint, number):
            return
        cleaned = F.coalesce("cached", T.clean_list_markers(T.extract_answer("raw", pattern)))
        reason = T.drop_reason("raw", "extracted", min_features)
        with settings(session, ADAPTIVE):
            each = materialize(labels_of(stored).withColumn("extracted", cleaned), "label-rows")
            explained = each.filter(T.has_enough_features("extracted", min_features)).select(
                *KEYS, F.col("text").alias(TEXT), F.col("extracted").alias("api_explanation")
            )
            records = each.filter(F.col("status") != CACHED).withColumn("drop_reason", reason).select(
                *KEYS, "text", "raw", "extracted", F.col("drop_reason").isNotNull().alias("dropped"), "drop_reason", "status"
            )
            commit(session, target, {"explained": explained, "audit": records}, _noted(facts, checkpoint, number))

    return _start(spark, found, step, checkpoint, "update", LABEL_CONF)
