"""Deterministic order, sampling and splitting.

Every choice is keyed by ``sha256(seed|key)``: it depends on the seed and the
key alone, never on partitioning, row order or the number of executors.

Exact counts at scale come from *cuts*: the k-th smallest hash is found by
radix selection (a few passes over hash prefixes, at most 4096 counts on the
driver), and membership is then the row-local test ``hash < cut``. Splitting or
downsampling a table therefore moves no row of it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoframe.functions import constants as C
from echoframe.functions.text import ColumnLike, _col, candidate_positions, let
from echoframe.session import materialize


class DataCheckError(ValueError):
    """A table breaks a rule the next step counts on."""


PREFIX_DIGITS = 3
SETTLE_ROWS = 2048
HASH_DIGITS = 64
#: Keys that are looked at for each range of an order.
SAMPLES_PER_RANGE = 32
LOWEST, HIGHEST = "", "g"  # below and above every hexadecimal string
SPLITS = ("av_sft", "ar_sft", "rl")


def seeded_hash(seed: int | str, *keys: ColumnLike) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[_col(k).cast("string") for k in keys]), 256)


# ---- cuts -------------------------------------------------------------------


def hash_cuts(hashes: DataFrame, ranks: Callable[[int], Sequence[int]]) -> tuple[int, list[str]]:
    """Order statistics of distinct hashes.

    ``hashes`` has one column; ``ranks`` maps the number of hashes to the wanted
    ranks. Returns that number and one cut per rank: exactly ``rank`` hashes are
    smaller than its cut. Repeated hashes at a cut are an error.
    """
    name = hashes.columns[0]
    hashes = materialize(hashes, "hashes")  # narrow; the input behind it is evaluated once

    def counts(frame: DataFrame, digits: int) -> dict[str, int]:
        grouped = frame.groupBy(F.substring(name, 1, digits).alias("p")).count()
        return {r["p"]: r["count"] for r in grouped.collect()}

    first = counts(hashes, PREFIX_DIGITS)
    total = sum(first.values())
    wanted = list(ranks(total))
    cuts: dict[int, str] = {r: LOWEST for r in wanted if r <= 0}
    cuts.update({r: HIGHEST for r in wanted if r >= total})

    # open: rank -> (prefix holding it, rank inside that prefix, rows of the prefix)
    open_ranks = {
        r: _locate(first, "", r, PREFIX_DIGITS) for r in set(wanted) if 0 < r < total
    }
    digits = PREFIX_DIGITS
    while open_ranks:
        large = {r: v for r, v in open_ranks.items() if v[2] > SETTLE_ROWS}
        small = {r: v for r, v in open_ranks.items() if r not in large}
        if small:
            prefixes = {v[0] for v in small.values()}
            rows = hashes.filter(F.substring(name, 1, digits).isin(list(prefixes))).collect()
            by_prefix: dict[str, list[str]] = {}
            for row in rows:
                by_prefix.setdefault(row[0][:digits], []).append(row[0])
            for r, (prefix, inner, _) in small.items():
                ordered = sorted(by_prefix[prefix])
                if inner and ordered[inner - 1] == ordered[inner]:
                    raise DataCheckError("keys repeat: no cut separates rows of equal hash")
                cuts[r] = ordered[inner]
        if large:
            if digits >= HASH_DIGITS:
                raise DataCheckError("keys repeat: no cut separates rows of equal hash")
            prefixes = {v[0] for v in large.values()}
            deeper = counts(
                hashes.filter(F.substring(name, 1, digits).isin(list(prefixes))),
                digits + PREFIX_DIGITS,
            )
            large = {r: _locate(deeper, v[0], v[1], digits + PREFIX_DIGITS) for r, v in large.items()}
        open_ranks = large
        digits += PREFIX_DIGITS
    return total, [cuts[r] for r in wanted]


def _locate(counts: dict[str, int], prefix: str, rank: int, digits: int) -> tuple[str, int, int]:
    for key in sorted(k for k in counts if k.startswith(prefix)):
        if rank < counts[key]:
            return key[:digits], rank, counts[key]
        rank -= counts[key]
    raise ValueError("rank beyond the number of keys")


def _key_hashes(df: DataFrame, seed: int | str, keys: Sequence[str]) -> DataFrame:
    return df.select(seeded_hash(seed, *keys).alias("h")).distinct()


# ---- splits and samples -----------------------------------------------------


def check_fractions(fractions: Sequence[float]) -> None:
    if any(f < 0 for f in fractions):
        raise ValueError(f"fractions must not be negative, got {tuple(fractions)}")
    if abs(sum(fractions) - 1.0) > 1e-6:
        raise ValueError(f"fractions must sum to 1.0, got {sum(fractions)}")


def split_rule(
    df: DataFrame,
    fractions: Sequence[float] = C.SPLIT_FRACTIONS,
    seed: int = C.SEED,
    key: str = "doc_id",
    names: Sequence[str] = SPLITS,
) -> Column:
    """The split as a column of ``key`` alone: whole documents, floor counts, the last split takes the rest.

    The cuts come from the documents of ``df``. The rule can be applied to any
    table with the same documents, say their vectors, without joining them.
    """
    check_fractions(fractions)

    def bounds(n: int) -> list[int]:
        ends, end = [], 0
        for f in fractions[:-1]:
            end += int(n * f)
            ends.append(end)
        return ends

    _, cuts = hash_cuts(_key_hashes(df, seed, [key]), bounds)
    h = seeded_hash(seed, key)
    split = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        split = F.when(h < cut, F.lit(name)).otherwise(split)
    return split


def split_documents(
    df: DataFrame,
    fractions: Sequence[float] = C.SPLIT_FRACTIONS,
    seed: int = C.SEED,
    key: str = "doc_id",
    names: Sequence[str] = SPLITS,
) -> DataFrame:
    """Add ``split`` by :func:`split_rule`."""
    return df.withColumn("split", split_rule(df, fractions, seed, key, names))


def assign_by_deficit(
    df: DataFrame, deficits: dict[str, int], seed: int = C.SEED, key: str = "doc_id"
) -> DataFrame:
    """Add ``bucket``: buckets filled in the order given; documents beyond every need get NULL."""

    def bounds(n: int) -> list[int]:
        ends, end = [], 0
        for need in deficits.values():
            end = min(n, end + max(0, need))
            ends.append(end)
        return ends

    _, cuts = hash_cuts(_key_hashes(df, seed, [key]), bounds)
    h = seeded_hash(seed, key)
    bucket = F.lit(None).cast("string")
    for cut, name in reversed(list(zip(cuts, deficits))):
        bucket = F.when(h < cut, F.lit(name)).otherwise(bucket)
    return df.withColumn("bucket", bucket)


def bucket_needs(num_docs: int, fractions: Sequence[float] = C.SPLIT_FRACTIONS) -> dict[str, int]:
    check_fractions(fractions)
    av, ar = int(num_docs * fractions[0]), int(num_docs * fractions[1])
    return {"av": av, "ar": ar, "rl": num_docs - av - ar}


def deficits(needs: dict[str, int], have: dict[str, int]) -> dict[str, int]:
    return {k: max(0, need - have.get(k, 0)) for k, need in needs.items()}


def sample_documents(
    df: DataFrame, need: int | Callable[[int], int], seed: int = C.SEED, key: str = "doc_id"
) -> DataFrame:
    """Rows of ``need`` documents, of all when there are fewer. ``need`` may depend on their number."""
    rank = need if callable(need) else (lambda n: need)
    _, (cut,) = hash_cuts(_key_hashes(df, seed, [key]), lambda n: [rank(n)])
    return df.filter(seeded_hash(seed, key) < cut)


def half_of_documents(df: DataFrame, seed: int = C.SEED, key: str = "doc_id") -> DataFrame:
    return sample_documents(df, lambda n: n // 2, seed, key)


def sample_rows(
    df: DataFrame, n: int | Callable[[int], int], keys: Sequence[str], seed: int = C.SEED
) -> DataFrame:
    """``n`` rows of a table that ``keys`` identify; the same rows under any partitioning."""
    hashes = df.select(seeded_hash(seed, *keys).alias("h"))
    rank = n if callable(n) else (lambda _: n)
    _, (cut,) = hash_cuts(hashes, lambda total: [rank(total)])
    return df.filter(seeded_hash(seed, *keys) < cut)


def sample_indices(count: Column, k: int, seed: int | str, key: ColumnLike) -> Column:
    """``min(k, count)`` distinct indices below ``count``, keyed by (seed, key), ascending.

    Floyd's method: every k-subset is equally likely and only k hashes are
    taken, however long the document is.
    """
    size = F.least(F.lit(k), count).cast("bigint")
    draws = F.when(size > 0, F.sequence(F.lit(0).cast("bigint"), size - 1)).otherwise(
        F.array().cast("array<bigint>")
    )

    def step(chosen: Column, i: Column) -> Column:
        top = count.cast("bigint") - size + i
        drawn = F.conv(F.substring(seeded_hash(seed, key, i), 1, 15), 16, 10).cast("bigint") % (top + 1)
        return F.array_append(chosen, F.when(F.array_contains(chosen, drawn), top).otherwise(drawn))

    return F.array_sort(F.aggregate(draws, F.array().cast("array<bigint>"), step))


def sample_positions(
    tokens: ColumnLike,
    doc_key: ColumnLike,
    k: int = C.POSITIONS_PER_DOC,
    seed: int = C.SEED,
    min_position: int = C.MIN_POSITION,
    specials: Sequence[str] = (),
) -> Column:
    """Sampled 0-based token positions of one document, ascending."""

    def pick(toks: Column) -> Column:
        if not specials:  # candidates are a plain range: no need to list them
            count = F.greatest(F.size(toks) - min_position, F.lit(0))
            return F.transform(sample_indices(count, k, seed, doc_key), lambda i: i + min_position)
        return let(
            candidate_positions(toks, min_position, specials),
            lambda c: F.transform(
                sample_indices(F.size(c), k, seed, doc_key), lambda i: F.get(c, i.cast("int"))
            ),
        )

    return let(_col(tokens), pick)


# ---- ranks ------------------------------------------------------------------


def seeded_rank(df: DataFrame, keys: Sequence[str], seed: int | str = C.SEED, name: str = "rank") -> DataFrame:
    """Exact 0-based rank in hash order, without moving all rows to one task.

    4096 buckets by hash prefix are ranked side by side; at 10^10 keys one holds
    about 2.4 million. The bucket table has 4096 rows at any size, so its running
    sum and its broadcast stay small.
    """
    hashed = df.withColumn("_h", seeded_hash(seed, *keys)).withColumn(
        "_bucket", F.substring("_h", 1, PREFIX_DIGITS)
    )
    offsets = (
        hashed.groupBy("_bucket")
        .count()
        .select("_bucket", (F.sum("count").over(W.orderBy("_bucket")) - F.col("count")).alias("_offset"))
    )
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy("_h")) - 1
    return (
        hashed.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("bigint"))
        .drop("_bucket", "_h", "_offset", "_inside")
    )


def natural_rank(df: DataFrame, keys: Sequence[str], name: str = "rank", stored: bool = False) -> DataFrame:
    """Exact 0-based rank by ``keys``, which should identify the rows.

    A sample of the keys, chosen by hash and bounded in number, cuts their order
    into ranges of about one size, one per shuffle partition; ranges are counted
    and numbered side by side, and the rows before a range are a sum of those
    counts. So the rank needs neither a global sort in one task nor a copy of
    the rows. The input is read several times and written first for that; say so
    where it is ``stored`` already.
    """
    df = df if stored else materialize(df, "to-rank")
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, df.count() // (SAMPLES_PER_RANGE * ranges))
    sample = df.select(*keys).filter(F.pmod(F.xxhash64(*keys), F.lit(every)) == 0).distinct().orderBy(*keys).collect()
    starts = [sample[k * len(sample) // ranges] for k in range(1, ranges)] if len(sample) >= ranges else sample[1:]
    kinds = dict(df.dtypes)
    row = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    constants = [F.struct(*[F.lit(s[k]).cast(kinds[k]).alias(f"k{i}") for i, k in enumerate(keys)]) for s in starts]
    placed = df.withColumn("_range", places_in(row, constants))
    counts = {r["_range"]: r["count"] for r in placed.select("_range").groupBy("_range").count().collect()}  # one per range
    before = [0]
    for k in range(max(counts, default=0)):
        before.append(before[-1] + counts.get(k, 0))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*keys)) - 1
    offset = F.get(F.array(*(F.lit(b) for b in before)), F.col("_range"))
    return placed.withColumn(name, (offset + inside).cast("bigint")).drop("_range")


def range_shards(df: DataFrame, num_shards: int, key: str = "doc_id") -> DataFrame:
    """Add ``shard_id``: contiguous ranges of the sorted documents, shard s starting at s*n//num.

    Only the start key of each shard is needed; rows then find their place
    among those ``num_shards - 1`` keys where they are.
    """
    if num_shards < 1:
        raise ValueError("num_shards must be positive")
    docs = df.select(key).distinct()
    n = docs.count()
    starts = [s * n // num_shards for s in range(1, num_shards)]
    ranked = natural_rank(docs, [key])
    wanted = df.sparkSession.createDataFrame([(s,) for s in sorted(set(starts))], "rank bigint") if starts else None
    first = {r["rank"]: r[key] for r in ranked.join(F.broadcast(wanted), "rank").collect()} if starts else {}
    # A start equal to n names no document: that shard and the later ones are empty.
    keys = [first[s] for s in starts if s in first]

    return df.withColumn("shard_id", places_in(F.col(key), keys))


def places_in(value: Column, starts: Sequence) -> Column:
    """How many of the sorted ``starts`` are at or below the value: a binary search in one constant array.

    The expression has one size, whatever the number of starts.
    """
    if not starts:
        return F.lit(0)
    array = F.array(*(s if isinstance(s, Column) else F.lit(s) for s in starts))  # folded into one constant

    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.floor((low + high) / 2).cast("int")
        above = F.get(array, middle) <= value
        open_ = low < high
        return F.struct(
            F.when(open_ & above, middle + 1).otherwise(low).alias("low"), F.when(open_ & ~above, middle).otherwise(high).alias("high")
        )

    steps = F.sequence(F.lit(1), F.lit(len(starts).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(starts)).alias("high")), halve, lambda state: state["low"])


def chunk_starts(df: DataFrame, keys: Sequence[str], chunk_rows: int = C.CHUNK_ROWS, stored: bool = False) -> DataFrame:
    """Add ``chunk_start``: first row number of the fixed-size chunk a row falls in."""
    ranked = natural_rank(df, keys, "_row", stored)
    return ranked.withColumn("chunk_start", F.col("_row") - F.col("_row") % chunk_rows).drop("_row")


def epoch_batches(
    df: DataFrame, keys: Sequence[str], world: int, batch: int, epoch: int = 0, seed: int = C.SEED
) -> DataFrame:
    """Add ``worker`` and ``batch_id`` for one shuffled epoch.

    Every worker takes each ``world``-th row of the shuffled order and the same
    number of full batches; the rest of the epoch is left out.
    """
    if world < 1 or batch < 1:
        raise ValueError("world and batch must be positive")
    n = df.count()
    full = n // world // batch
    ranked = seeded_rank(df, keys, f"{seed}|{epoch}", "_rank")
    return (
        ranked.withColumn("worker", F.col("_rank") % world)
        .withColumn("batch_id", F.expr(f"_rank div {world} div {batch}"))
        .filter(F.col("batch_id") < full)
        .drop("_rank")
    )


def running_mean(df: DataFrame, index: str, value: str, every: int, buckets: int = 1024) -> DataFrame:
    """Mean of ``value`` over indices 0..i at every ``every``-th row of a dense 0-based index.

    NULL values are passed over. Bucket totals are summed first, so no task sees
    more than its share of rows.
    """
    n = df.count()
    width = max(1, -(-n // buckets))
    rows = df.withColumn("_b", F.expr(f"`{index}` div {width}"))
    totals = rows.groupBy("_b").agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        "_b",
        F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("_s"),
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_c"),
    )
    inside = W.partitionBy("_b").orderBy(index).rowsBetween(W.unboundedPreceding, 0)
    total = F.col("_s") + F.coalesce(F.sum(value).over(inside), F.lit(0.0))
    count = F.col("_c") + F.count(value).over(inside)
    return (
        rows.join(F.broadcast(carried), "_b")
        .withColumn("n_valid", count)
        .withColumn("running_mean", F.when(count > 0, total / F.greatest(count, F.lit(1))))
        .filter((F.col(index) + 1) % every == 0)
        .drop("_b", "_s", "_c")
    )
