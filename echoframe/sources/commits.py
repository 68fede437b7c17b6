"""Tables that change together, batch by batch.

Layout under one path: ``<table>/batch=<n>/`` for every table and
``_commits/<n>.json``, which is written last. A batch is there for readers once
its record is; numbers are dealt in order, so the last record tells all that is
there. What a job that stopped has left of a batch without a record is removed
when the batch is written anew. Facts that belong to the rows (a cursor,
counts) are part of the record and change with them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from echoframe.sources.sidecar import read_json

COMMITS, BATCH = "_commits", "batch"
#: Committed tables are kept: pages of texts that extend each other are larger and packed a little harder than intermediate ones.
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6", "parquet.page.size": str(8 << 20)}


def _files(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, location = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(location)] if fs.exists(location) else []


def committed_batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{path}/{COMMITS}") if n.endswith(".json") and n[:1] != ".")


def last_commit(spark: SparkSession, path: str) -> dict:
    """The latest record: ``batch``, ``rows`` of it by table, and its facts; batch -1 where nothing is committed."""
    batches = committed_batches(spark, path)
    if not batches:
        return {BATCH: -1, "rows": {}, "facts": {}}
    return read_json(spark, f"{path}/{COMMITS}/{batches[-1]}.json")


def _publish(spark: SparkSession, path: str, record: dict) -> None:
    """The record appears whole or not at all, and never over another one."""
    fs, folder = _files(spark, f"{path}/{COMMITS}")
    fs.mkdirs(folder)
    _, final = _files(spark, f"{path}/{COMMITS}/{record[BATCH]}.json")
    _, draft = _files(spark, f"{path}/{COMMITS}/.{record[BATCH]}.draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(record, ensure_ascii=False), "utf-8"))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"batch {record[BATCH]} of {path} was committed by another writer")


Stored = Mapping[str, DataFrame]


def commit(
    spark: SparkSession,
    path: str,
    tables: Mapping[str, DataFrame | Callable[[Stored], DataFrame]],
    facts: Mapping | Callable[[Stored], Mapping] | None = None,
    partition_by: Mapping[str, Sequence[str]] | None = None,
) -> dict:
    """Write one batch of every table and make all of them visible at once. Returns the record.

    The tables should be stored already, or cheap: they are written one after
    the other. A table may be a function of those of the batch that are stored
    before it, so that what is dear to make is written once; so may the facts.
    Facts of earlier records that are not named again stay. One writer at a
    time: a second one fails at its record and changes nothing.
    """
    last = last_commit(spark, path)
    batch = last[BATCH] + 1
    for name in _names(spark, path):  # what a stopped job has left of this batch, in any table
        fs, rest = _files(spark, f"{path}/{name}/{BATCH}={batch}")
        if name[:1] not in "_." and fs.exists(rest):
            fs.delete(rest, True)
    rows, stored = {}, {}
    for name, table in tables.items():
        df = table(stored) if callable(table) else table
        at = f"{path}/{name}/{BATCH}={batch}"
        df.write.mode("overwrite").options(**STORED).partitionBy(*(partition_by or {}).get(name, ())).parquet(at)
        stored[name] = spark.read.schema(df.schema).parquet(at)
        rows[name] = stored[name].count()  # from the footers
    record = {BATCH: batch, "rows": rows, "facts": {**last["facts"], **((facts(stored) if callable(facts) else facts) or {})}}
    _publish(spark, path, record)
    return record


def read_committed(spark: SparkSession, path: str, table: str, schema: Ty.StructType | None = None, batches: Sequence[int] | None = None) -> DataFrame | None:
    """Rows of all committed batches, or of some of them; None where there are none yet.

    Only folders of these batches are listed into the scan.
    """
    last = last_commit(spark, path)[BATCH]
    fs, location = _files(spark, f"{path}/{table}")
    if last < 0 or not fs.exists(location):
        return None
    reader = spark.read if schema is None else spark.read.schema(Ty.StructType([*schema.fields, Ty.StructField(BATCH, Ty.LongType())]))
    rows = reader.parquet(f"{path}/{table}").filter(F.col(BATCH) <= last)
    if batches is not None:
        rows = rows.filter(F.col(BATCH).isin([int(b) for b in batches]))
    return rows.drop(BATCH)
