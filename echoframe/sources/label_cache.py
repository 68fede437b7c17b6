"""Label cache: sha256 of a text -> its explanation.

Kept as a table. The published exchange form is one JSON object with an entry
per line; it is read line by line, so a large file still splits across tasks.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoframe.functions.text import text_key
from echoframe.sources.sidecar import write_json
from echoframe.sources.tables import LABEL_CACHE

KEY_PATTERN = "^[0-9a-f]{64}$"
ENTRY_PATTERN = r'^\s*("[0-9a-f]{64}"\s*:\s*".*")\s*,?\s*$'

#: Lines of an exported object that hold no entry: braces, blanks, and fields whose name is no key.
PASSED_PATTERN = r'^\s*([{}\[\]]*\s*,?|"(?![0-9a-f]{64}")[^"]*"\s*:.*)\s*$'


def cache_from_explained(explained: DataFrame) -> DataFrame:
    """Cache of an explained table, which has the texts or their keys."""
    key = F.col("text_sha256") if "text_sha256" in explained.columns else text_key("detokenized_text_truncated")
    return explained.select(key.alias("text_sha256"), F.col("api_explanation").alias("explanation"))


def cache_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Read an exported cache: JSON lines, an indented object, or an object on one line.

    Braces, blank lines and fields of ``_meta`` are passed over. Any other line
    that is no entry, a cut-off one for instance, is an error: a cache that
    shrinks unseen would have its texts labelled again.
    """
    lines = spark.read.text(path)
    entry = F.concat(F.lit("{"), F.regexp_extract("value", ENTRY_PATTERN, 1), F.lit("}"))
    as_map = F.from_json(
        F.when(F.col("value").rlike(ENTRY_PATTERN), entry).otherwise(F.col("value")), "map<string,string>"
    )
    known = F.col("value").rlike(PASSED_PATTERN) | F.col("value").rlike(ENTRY_PATTERN)
    broken = F.raise_error(F.concat(F.lit("unreadable line in the label cache: "), F.substring("value", 1, 80))).cast("map<string,string>")
    parsed = lines.select(F.when(as_map.isNull() & ~known, broken).otherwise(as_map).alias("m")).filter(F.col("m").isNotNull())
    pairs = parsed.select(
        F.explode(
            F.when(
                F.map_contains_key("m", "text_sha256"),
                F.map_from_arrays(
                    F.array(F.try_element_at("m", F.lit("text_sha256"))),
                    F.array(F.try_element_at("m", F.lit("explanation"))),
                ),
            ).otherwise(F.col("m"))
        ).alias("text_sha256", "explanation")
    )
    return pairs.filter(F.col("text_sha256").rlike(KEY_PATTERN))


def merge_caches(sources: Sequence[DataFrame]) -> DataFrame:
    """One row per key; a later source wins.

    Within one source the largest explanation stands, so the result does not
    depend on row order. ``max_by`` combines map-side: copies of a text do not
    travel.
    """
    if not sources:
        raise ValueError("no cache sources")
    tagged = [s.select("text_sha256", "explanation", F.lit(i).alias("_i")) for i, s in enumerate(sources)]
    merged = tagged[0]
    for t in tagged[1:]:
        merged = merged.unionByName(t)
    return (
        merged.filter(F.col("explanation").isNotNull())
        .groupBy("text_sha256")
        .agg(F.max_by("explanation", F.struct("_i", "explanation")).alias("explanation"))
    )


def export_cache(
    cache: DataFrame, path: str, new: DataFrame | None = None, fingerprint: str = "", tokenizer_name: str = ""
) -> int:
    """Write the cache, with new labels merged in, as JSON lines plus ``<path>_meta.json``."""
    spark = cache.sparkSession
    merged = merge_caches([cache] if new is None else [cache, new])
    merged.write.mode("overwrite").json(path)
    entries = spark.read.schema(LABEL_CACHE).json(path).count()
    meta: dict = {
        "description": "explanation cache, keyed by sha256(detokenized_text_truncated)",
        "num_entries": entries,
    }
    if fingerprint:
        meta |= {"tokenizer_fingerprint": fingerprint, "tokenizer_name": tokenizer_name}
    write_json(spark, f"{path.rstrip('/')}_meta.json", meta)
    return entries


def cache_to_json_object(entries: dict[str, str], meta: dict) -> str:
    """Text of the single-object exchange form, for small hand-made caches."""
    return json.dumps({"_meta": meta, **entries}, ensure_ascii=False, indent=2)
