"""Labels of texts as keyed state: every text is asked once, every position answered once, however often they come.

Three keyed states, all kept by Spark's own stateful operators: the positions
that were answered, the texts that were asked, and what the provider said to
each. Python runs for the fold of copies and the calls only, batch by batch; no
row of a state passes through it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoframe.functions import constants as C
from echoframe.functions import text as T
from echoframe.operators.inference import Provider, complete
from echoframe.operators.labelling import CACHED, KEYS, TEXT

SAID = "struct<raw:string,status:string>"


def fold_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text of an Arrow batch: the copies of a frequent text are not moved."""
    for batch in batches:
        if not batch.num_rows:
            continue
        by_text = pa.Table.from_batches([batch]).group_by("text_sha256", use_threads=False).aggregate([("text", "first")])
        yield from by_text.select(["text_sha256", "text_first"]).rename_columns(["text_sha256", "text"]).combine_chunks().to_batches()


def answered(positions: DataFrame, provider: Provider | str, cache: DataFrame | None = None, template: str = C.INSTRUCTION_TEMPLATE,
             chunk_rows: int = C.CHUNK_ROWS) -> DataFrame:
    """A stream of positions as those not answered before, and the answers to their texts; ``labels_of`` brings both together.

    A row with ``said`` is the answer to a text, new or known; one without is a
    position with its text. To be run in update mode.
    """
    rows = positions.select(*KEYS, F.col(TEXT).alias("text"), T.text_key(TEXT).alias("text_sha256"))
    if cache is None:
        rows = rows.withColumn("cached", F.lit(None).cast("string"))
    else:
        rows = rows.join(cache.select("text_sha256", F.col("explanation").alias("cached")), "text_sha256", "left")
    missed = rows.filter(F.col("cached").isNull())
    texts = missed.select("text_sha256", "text").mapInArrow(fold_copies, "text_sha256 string, text string").dropDuplicates(["text_sha256"])
    asked = complete(texts.select("text_sha256", T.instruction_prompt("text", template).alias("prompt")), provider, "prompt", chunk_rows)
    met = missed.select("text_sha256", F.lit(None).cast(SAID).alias("said"))
    known = met.unionByName(asked.select("text_sha256", F.struct("raw", "status").alias("said")))
    labels = known.groupBy("text_sha256").agg(F.first("said", ignorenulls=True).alias("said"))
    new = rows.dropDuplicates(["text_sha256", *KEYS])  # the key of the text too: a key that comes with two texts is two positions
    return new.unionByName(labels, allowMissingColumns=True)


def labels_of(stored: DataFrame) -> DataFrame:
    """``doc_id, n_raw_tokens, text, raw, status, cached`` of a stored batch of ``answered``, a row per position."""
    labels = stored.filter("said IS NOT NULL").select("text_sha256", "said.*")
    missed = F.col("cached").isNull()
    return stored.filter("said IS NULL").select("text_sha256", *KEYS, "text", "cached").join(labels, "text_sha256", "left").select(
        *KEYS, "text", F.when(missed, F.col("raw")).alias("raw"), F.when(missed, F.col("status")).otherwise(CACHED).alias("status"), "cached"
    )
