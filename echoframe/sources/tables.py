"""Table schemas, checked writes and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from echoframe.operators.positions import DataCheckError

MESSAGE = Ty.StructType([Ty.StructField("role", Ty.StringType()), Ty.StructField("content", Ty.StringType())])
_KEYS = [Ty.StructField("doc_id", Ty.StringType()), Ty.StructField("n_raw_tokens", Ty.LongType())]
_VECTOR = Ty.StructField("activation_vector", Ty.ArrayType(Ty.FloatType()))
_LAYER = Ty.StructField("activation_layer", Ty.LongType())

POSITIONS = Ty.StructType([*_KEYS, Ty.StructField("detokenized_text_truncated", Ty.StringType())])
EXPLAINED = Ty.StructType([*POSITIONS.fields, Ty.StructField("api_explanation", Ty.StringType())])
VECTORS = Ty.StructType([*_KEYS, _VECTOR, _LAYER])
AV_SFT = Ty.StructType(
    [Ty.StructField("prompt", Ty.ArrayType(MESSAGE)), Ty.StructField("response", Ty.StringType()), _VECTOR, *_KEYS, _LAYER]
)
AR_SFT = Ty.StructType([Ty.StructField("prompt", Ty.StringType()), _VECTOR, *_KEYS, _LAYER])
RL = Ty.StructType([Ty.StructField("prompt", Ty.ArrayType(MESSAGE)), _VECTOR, *_KEYS, _LAYER])
LABEL_CACHE = Ty.StructType(
    [Ty.StructField("text_sha256", Ty.StringType()), Ty.StructField("explanation", Ty.StringType())]
)


def read_table(spark: SparkSession, path: str, schema: Ty.StructType | None = None) -> DataFrame:
    """Parquet scan; a declared schema saves footer reads and fixes the types.

    Column tags are part of the stored schema: leave ``schema`` out to see them.
    """
    return spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def conform(df: DataFrame, schema: Ty.StructType) -> DataFrame:
    """Columns in declared order; wrong or missing ones are an error."""
    kinds = dict(df.dtypes)
    wrong = [
        f"{f.name}: {kinds.get(f.name, 'missing')} instead of {f.dataType.simpleString()}"
        for f in schema.fields
        if kinds.get(f.name) != f.dataType.simpleString()
    ]
    if wrong:
        raise DataCheckError("schema mismatch: " + "; ".join(wrong))
    return df.select(*schema.names)


def write_table(
    df: DataFrame, path: str, schema: Ty.StructType | None = None, mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Write parquet after a schema check and return the written table."""
    spark = df.sparkSession
    out = df if schema is None else conform(df, schema)
    out.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def write_splits(df: DataFrame, path: str, column: str = "split") -> DataFrame:
    """All splits in one job: one directory per value, one pass over the input."""
    return write_table(df, path, mode="overwrite", partition_by=[column])


def merge_tables(tables: Sequence[DataFrame], expected_rows: int | None = None) -> DataFrame:
    """Shards as one table, by column name; optionally with a row-count check."""
    if not tables:
        raise ValueError("nothing to merge")
    merged = tables[0]
    for t in tables[1:]:
        merged = merged.unionByName(t)
    if expected_rows is not None:
        rows = merged.count()
        if rows != expected_rows:
            raise DataCheckError(f"merged {rows} rows, expected {expected_rows}")
    return merged


def append_rows(spark: SparkSession, new: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Append the rows whose key is not in the table yet; running it twice changes nothing."""
    if table_exists(spark, path):
        new = new.join(read_table(spark, path, new.schema).select(*keys), list(keys), "left_anti").select(*new.columns)
    new.write.mode("append").parquet(path)
    return read_table(spark, path, new.schema)


def sorted_by(df: DataFrame, *keys: str) -> DataFrame:
    """Total order over the output files: range partitions, each sorted."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def distinct_count(df: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """Number of distinct keys as ``n_docs``; zero for an empty table."""
    return df.agg(F.countDistinct(key).alias("n_docs"))


def bucket_doc_count(spark: SparkSession, path: str) -> int:
    """Distinct documents of a stored table, 0 when it does not exist."""
    if not table_exists(spark, path):
        return 0
    return distinct_count(spark.read.parquet(path).select("doc_id")).first()["n_docs"]
