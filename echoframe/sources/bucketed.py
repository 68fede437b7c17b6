"""Stored tables that are dealt into sorted buckets by key once, so that joins by this key leave them where they are.

Spark keeps the layout of a bucketed table in its catalog. Here it also stands
next to the files, so that any session can open the table by its path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from echoframe.sources.sidecar import read_json, write_json

LAYOUT = "_buckets.json"
#: Rows of a bucket, and the fewest buckets of a table.
BUCKET_ROWS, FEWEST = 1 << 18, 8


def buckets_for(rows: int) -> int:
    """Buckets of a table, so that one stays the same size as the table grows."""
    return max(FEWEST, -(-rows // BUCKET_ROWS))


def _name(path: str) -> str:
    return "bucketed_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:24]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write ``df`` to ``path`` in ``buckets`` buckets by ``keys``, sorted in each, and open it.

    The rows are shuffled by key first, so a bucket is one file however many
    tasks the input has. Choose the number for the table's growth: a bucket is
    one task of every later join.
    """
    spark = df.sparkSession
    name = _name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # the catalog's entry; files of an outside table stay
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("errorifexists").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    columns = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    write_json(spark, f"{path.rstrip('/')}/{LAYOUT}", {"keys": list(keys), "buckets": buckets, "columns": columns})
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` with its layout, also in a session that did not write it."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        layout = read_json(spark, f"{path.rstrip('/')}/{LAYOUT}")
        if not layout:
            raise FileNotFoundError(f"no bucketed table at {path}")
        columns = ", ".join(f"{_quoted(n)} {kind}" for n, kind in layout["columns"])
        keys = ", ".join(_quoted(k) for k in layout["keys"])
        location = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout['buckets']} BUCKETS LOCATION '{location}'")
    return spark.table(name)
