"""From corpus to outputs: the four stages of data generation in order.

Every stage reads and writes tables, so a run that stops can be started again;
stages whose output exists only add what is missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from echoframe.functions import constants as C
from echoframe.operators.inference import Encoder, Provider, encode
from echoframe.operators.pool import BUCKETS, CorpusWindow, grow_pool, label_pool, meta_path, model_output
from echoframe.operators.sampling import bucket_needs
from echoframe.operators.vocabulary import check_fingerprint
from echoframe.sources.tables import VECTORS, conform, table_exists

STAGES = ("extract", "explain", "output", "vectors")


def generate(
    spark: SparkSession,
    pool: str,
    output: str,
    corpus: CorpusWindow,
    num_docs: int,
    fingerprint: str,
    tokenizer_name: str = "",
    fractions: Sequence[float] = C.SPLIT_FRACTIONS,
    seed: int = C.SEED,
    provider: Provider | str = "offline",
    encoder: Encoder | None = None,
    d_model: int = 64,
    layer: int = 0,
    stages: Sequence[str] = STAGES,
    **extraction,
) -> dict[str, str]:
    """Fill the pool, label it, draw each bucket's output and encode it. Returns the output paths.

    A pool made with another tokenizer is refused before anything is read.
    """
    unknown = [s for s in stages if s not in STAGES]
    if unknown:
        raise ValueError(f"unknown stages {unknown}, expected some of {STAGES}")
    check_fingerprint(spark, meta_path(pool), fingerprint, tokenizer_name)
    needs = bucket_needs(num_docs, fractions)
    paths = {b: f"{output}/{b}" for b in BUCKETS}
    if "extract" in stages:
        grow_pool(spark, pool, corpus, needs, seed, **extraction)
    if "explain" in stages:
        label_pool(spark, pool, provider)
    if "output" in stages:
        for bucket, path in paths.items():
            model_output(spark, pool, bucket, needs[bucket], seed).write.mode("overwrite").parquet(path)
    if "vectors" in stages:
        for path in paths.values():
            target = f"{path}_vectors"
            if table_exists(spark, path) and not table_exists(spark, target):
                rows = spark.read.parquet(path)
                conform(encode(rows, d_model, layer=layer, encoder=encoder), VECTORS).write.parquet(target)
    return paths
