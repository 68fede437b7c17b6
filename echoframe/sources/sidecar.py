"""Dataset sidecars and small JSON state, written next to the table through Hadoop's file API."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoframe.functions import constants as C
from echoframe.operators.positions import DataCheckError

SIDECAR_NAME = "_dataset_meta.json"  # a leading underscore keeps it out of table scans
SCHEMA_VERSION = 2


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = location.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(location, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2), "utf-8"))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    """The stored object, or an empty one when the file is missing."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(location):
        return {}
    stream = fs.open(location)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def sidecar_path(table_path: str) -> str:
    """Inside the table directory; a row-range suffix ``@[..]`` is not part of the path."""
    return f"{table_path.split('@[')[0].rstrip('/')}/{SIDECAR_NAME}"


def vector_width(df: DataFrame, column: str = "activation_vector") -> DataFrame:
    """Rows and smallest/largest vector length, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size(column)).cast("bigint").alias("min_width"),
        F.max(F.size(column)).cast("bigint").alias("max_width"),
    )


def check_vector_width(df: DataFrame, column: str = "activation_vector", expected: int | None = None) -> tuple[int, int]:
    """(rows, width); vectors of different or unexpected length are an error."""
    row = vector_width(df, column).first()
    if row["n_rows"] and row["min_width"] != row["max_width"]:
        raise DataCheckError(f"vector lengths differ: {row['min_width']} to {row['max_width']}")
    if expected is not None and row["n_rows"] and row["max_width"] != expected:
        raise DataCheckError(f"vector length {row['max_width']}, expected {expected}")
    return row["n_rows"], row["max_width"] or 0


def write_sidecar(
    spark: SparkSession,
    table_path: str,
    split: str,
    row_count: int,
    d_model: int,
    marker: dict | None = None,
    injection_scale: float | str | None = None,
    mse_scale: float | str | None = "sqrt_d_model",
    critic_suffix: list[str] | None = None,
    extra: dict | None = None,
    corpus: str | None = None,
    actor_template: str = C.ACTOR_TEMPLATE,
    critic_template: str = C.CRITIC_TEMPLATE,
) -> dict:
    """Metadata of a training table: kind, split, rows, width, scales, marker, corpus and the templates in use.

    The keys are fixed values of the file contract.
    """
    tokens = dict(marker or {})
    templates = {"actor": actor_template}
    if split == "ar_sft":
        templates["critic"] = critic_template
    if critic_suffix is not None:
        tokens["critic_suffix"] = critic_suffix
    meta = {
        "kind": "roundtrip_dataset",
        "schema_version": SCHEMA_VERSION,
        "dataset_id": table_path.rstrip("/").rsplit("/", 1)[-1],
        "split_type": split,
        "row_count": row_count,
        "extraction": {
            "d_model": d_model,
            **({"corpus": corpus} if corpus is not None else {}),
            "injection_scale": injection_scale,
            "mse_scale": mse_scale,
            "norm": "none",
        },
        "tokens": tokens,
        "prompt_templates": templates,
        **(extra or {}),
    }
    write_json(spark, sidecar_path(table_path), meta)
    return meta


def read_sidecar(spark: SparkSession, table_path: str) -> dict:
    return read_json(spark, sidecar_path(table_path))
