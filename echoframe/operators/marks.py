"""A sketch of a set of keys that is sent before a join, so that rows which cannot match are not moved.

The sketch is a Bloom filter kept as a table: words of 64 bits, 64 of them in a
row. Sketches of parts are merged by OR, by whatever tasks hold the parts, and
the whole is broadcast, two megabytes for any number of keys unless more words
are asked for, and 32 at most. A key of the set is never missed; others pass by
chance and are left to the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a sketch, 64 bits each: two megabytes; the most there are, and words of a row.
WORDS, MOST_WORDS, ROW_WORDS = 1 << 18, 1 << 22, 64


def words_for(keys: int) -> int:
    """Words that hold four keys each, of which one other key in fifty passes by chance, as far as they may grow."""
    words = WORDS
    while words < min(keys // 4, MOST_WORDS):
        words *= 2
    return words


def _place(keys: Sequence[Column], words: int) -> tuple[Column, Column]:
    """The word of the sketch that a key marks, and two bits in it."""
    h = F.xxhash64(*keys)
    shift = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, by), F.lit(64)).cast("int"))
    return F.pmod(h, F.lit(words)), shift(24).bitwiseOR(shift(40))


def _row(word: Column) -> tuple[Column, Column]:
    return F.floor(word / ROW_WORDS), F.pmod(word, F.lit(ROW_WORDS)).cast("int")


def sketch(df: DataFrame, keys: Sequence[str], words: int = WORDS) -> DataFrame:
    """``row_, bits_``: marks of the keys. Combined in the tasks before they meet."""
    word, bits = _place([F.col(k) for k in keys], words)
    merged = df.select(word.alias("word_"), bits.alias("bits_")).groupBy("word_").agg(F.bit_or("bits_").alias("bits_"))
    row, at = _row(F.col("word_"))
    held = merged.groupBy(row.alias("row_")).agg(F.map_from_entries(F.collect_list(F.struct(at, "bits_"))).alias("held_"))
    bits_of = lambda k: F.coalesce(F.element_at("held_", k), F.lit(0).cast("long"))
    return held.select("row_", F.transform(F.sequence(F.lit(0), F.lit(ROW_WORDS - 1)), bits_of).alias("bits_"))


def _joined(rows: DataFrame, marks: DataFrame, keys: Sequence[str], words: int, how: str) -> DataFrame:
    word, bits = _place([rows[k] for k in keys], words)
    row, at = _row(word)
    return rows.join(F.broadcast(marks), (row == F.col("row_")) & (bits.bitwiseAND(F.get("bits_", at)) == bits), how)


def may_match(rows: DataFrame, marks: DataFrame, keys: Sequence[str], words: int = WORDS) -> DataFrame:
    """Rows whose keys may be in the sketch; the others are dropped where they are read."""
    return _joined(rows, marks, keys, words, "left_semi")


def cannot_match(rows: DataFrame, marks: DataFrame, keys: Sequence[str], words: int = WORDS) -> DataFrame:
    """The other rows: their keys are not in the set."""
    return _joined(rows, marks, keys, words, "left_anti")
