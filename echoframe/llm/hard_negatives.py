"""Hard negatives of anchors by a secondary-sort shuffle.

The score of a row for an anchor is the inner product of their integer codes.
Every pair that can matter is one packed key (anchor, descending score, kind,
id). The shuffle deals keys by anchor and sorts them inside the partitions, so
an anchor arrives as a run in the order of its scores: an iterator opens a
window for each positive it meets, hands negatives to the windows that are open
for them and forgets the anchor when the next begins. It holds the windows of
one anchor and never its rows.

Anchors are a stated query set. They are sent to the tasks in blocks of bounded
size, a pass each, and compared with all rows where those are read. A task
gives on what can be among an anchor's first positives, and in a second pass,
with their windows known, the first negatives of each window; this loses
nothing, as the first of all are among the first of every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoframe.operators.positions import DataCheckError
from echoframe.session import materialize

SCALE = 256
#: Bytes of the anchors of one pass; vectors as doubles.
PASS_BYTES = 32 << 20
#: Cells of a block of scores in a task.
CELLS = 2 << 20
#: Sums below this are exact in a double.
EXACT = float(1 << 53)

_POSITIVE, _NEGATIVE = 0, 1
_KEY = np.dtype([("anchor", ">i8"), ("falling", ">u8"), ("kind", "u1"), ("id", ">u8"), ("at", ">i8")])
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_KEYED = "anchor long, anchor_id long, key binary"
_SIGN = np.uint64(1 << 63)


def pack(anchor: np.ndarray, score: np.ndarray, kind: np.ndarray | int, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Keys whose bytes sort by anchor, falling score, positives first, rising id and place."""
    keys = np.zeros(len(anchor), _KEY)
    keys["anchor"], keys["kind"], keys["at"] = anchor, kind, at
    keys["falling"] = ~(score.astype(np.int64).view(np.uint64) ^ _SIGN)
    keys["id"] = ids.astype(np.int64).view(np.uint64) ^ _SIGN
    width = _KEY.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def unpack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _KEY)


def scores_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of packed keys."""
    score = ((~keys["falling"].astype(np.uint64)) ^ _SIGN).view(np.int64)
    return score, (keys["id"].astype(np.uint64) ^ _SIGN).view(np.int64)


def codes(column: pa.Array) -> np.ndarray:
    """Whole-number components as doubles, a row per vector."""
    flat = np.asarray(column.flatten()).astype(np.float64)
    return np.floor(SCALE * flat.reshape(len(column), -1))


def _largest(x: np.ndarray) -> float:
    return float(np.abs(x).max(initial=0.0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of code rows."""
    bound = a.shape[1] * _largest(a) * _largest(b)
    if bound >= EXACT:
        raise DataCheckError("components too large: a score could leave 53 bits")
    kind = np.float32 if bound < (1 << 24) else np.float64
    return np.rint(a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first ``k`` of each group: falling scores, ties by id, then place."""
    order = np.lexsort((at, ids, -score, group))
    g = group[order]
    begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    inside = np.arange(len(g)) - np.repeat(begins, np.diff(np.append(begins, len(g))))
    return order[inside < k]


class Block:
    """The anchors of a pass: places, ids, labels, codes, and once known the windows of their positives."""

    def __init__(self, at: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        self.at, self.ids, self.labels, self.x = at, ids, labels, x
        self.low = self.high = np.zeros((len(at), 0), np.int64)

    def blocks(self, rows: int) -> Iterator[slice]:
        step = max(1, CELLS // max(rows, 1))
        return (slice(k, min(k + step, len(self.at))) for k in range(0, len(self.at), step))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at, ids, labels = (np.asarray(batch.column(c)) for c in ("at", "id", "label"))
    return at, ids, labels, codes(batch.column("v"))


def near_positives(block: Block, batches: Iterator[pa.RecordBatch], k: int) -> tuple[np.ndarray, ...]:
    """Of these rows the first ``k`` of each anchor's label: anchor number, score, id, place."""
    held = tuple(np.zeros(0, np.int64) for _ in range(4))
    for batch in batches:
        at, ids, labels, x = _columns(batch)
        found = [held]
        for part in block.blocks(len(at)):
            for label in np.unique(block.labels[part]):
                a, r = np.flatnonzero(block.labels[part] == label) + part.start, np.flatnonzero(labels == label)
                if not len(r):
                    continue
                s = products(block.x[a], x[r])
                other = block.at[a][:, None] != at[r][None, :]
                if len(r) > 4 * k:  # nothing below the k-th best of the block, itself aside, is among the first k
                    bar = np.partition(np.where(other, s, np.iinfo(np.int64).min), len(r) - k, axis=1)[:, len(r) - k]
                    other &= s >= bar[:, None]
                i, j = np.nonzero(other)
                chosen = first_of(i, s[i, j], ids[r][j], at[r][j], k)
                i, j = i[chosen], j[chosen]
                found.append((a[i], s[i, j], ids[r][j], at[r][j]))
        held = tuple(np.concatenate(c) for c in zip(*found, strict=True))
        keep = first_of(*held, k)
        held = tuple(c[keep] for c in held)
    return held


def near_negatives(block: Block, batches: Iterator[pa.RecordBatch], k: int) -> tuple[np.ndarray, ...]:
    """Of these rows of other labels the first ``k`` of each anchor's windows: anchor number, score, id, place, each once."""
    windows = block.low.shape[1]
    held = tuple(np.zeros(0, np.int64) for _ in range(5))
    open_ = block.low <= block.high
    least = np.where(open_, block.low, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
    most = np.where(open_, block.high, np.iinfo(np.int64).min).max(axis=1, initial=np.iinfo(np.int64).min)
    for batch in batches:
        at, ids, labels, x = _columns(batch)
        found = [held]
        for part in block.blocks(len(at)):
            s = products(block.x[part], x)
            i, j = np.nonzero((s >= least[part, None]) & (s <= most[part, None]) & (block.labels[part, None] != labels[None, :]))
            score, i = s[i, j], i + part.start
            for w in range(windows):
                inside = np.flatnonzero((score >= block.low[i, w]) & (score <= block.high[i, w]))
                a, v, b, p = i[inside], score[inside], ids[j[inside]], at[j[inside]]
                chosen = first_of(a, v, b, p, k)
                found.append((a[chosen] * windows + w, a[chosen], v[chosen], b[chosen], p[chosen]))
        held = tuple(np.concatenate(c) for c in zip(*found, strict=True))
        keep = first_of(held[0], *held[2:], k)
        held = tuple(c[keep] for c in held)
    _, a, score, ids, place = held
    _, once = np.unique(np.stack([a, place]), axis=1, return_index=True) if len(a) else (None, np.zeros(0, np.int64))
    return a[once], score[once], ids[once], place[once]


def _keys(block: Block, kind: int, rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    a, score, ids, at = rows
    return pa.RecordBatch.from_arrays(
        [pa.array(block.at[a]), pa.array(block.ids[a]), pack(block.at[a], score, kind, ids, at)], names=["anchor", "anchor_id", "key"]
    )


def shuffled(keys: DataFrame) -> DataFrame:
    """Dealt by anchor and sorted inside the partitions by the packed key."""
    return keys.repartition("anchor").sortWithinPartitions("key")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield np.asarray(batch.column("anchor_id")), unpack(batch.column("key"))


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``id, label, vector``.

    Rows that fit ``anchor`` are the queries. An anchor's positives are the
    first ``positives`` other rows of its label; to each belong the first
    ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent
    of its own. Higher scores come first, ties by id. Rows without an id or a
    label, without a vector, or with a null or non-finite component take no
    part. Rows of one id are rows of their own, as anchors too, ties among them
    in the order of the table; vectors meet those of their own length only.
    Columns of other names are not read; an empty table, or one without
    anchors, gives no rows. Components so large that a score could leave 53
    bits are an error.
    """
    spark = rows.sparkSession
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    taking = (
        rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable)
    )
    stored = materialize(taking.withColumn("at", F.monotonically_increasing_id()).withColumn("width", F.size("v")), "mine-rows")
    out = None
    for width, n in sorted((r["width"], r["n"]) for r in stored.filter("asks").groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()):
        passes = -(-n * 8 * max(width, 1) // pass_bytes)
        same_width = stored.filter(F.col("width") == width)
        for number in range(passes):
            asked = same_width.filter(F.col("asks") & (F.pmod(F.xxhash64("at"), F.lit(passes)) == number)).select("at", "id", "label", "v").toArrow()
            if not asked.num_rows:
                continue
            at, ids, labels, x = _columns(asked.combine_chunks().to_batches()[0])
            order = np.argsort(at)
            found = _one_pass(same_width, Block(at[order], ids[order], labels[order], x[order]), positives, negatives, low, high)
            out = found if out is None else out.union(found)
    return spark.createDataFrame([], OUT) if out is None else out


def _one_pass(rows: DataFrame, block: Block, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(block)

    def positive_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _keys(sent.value, _POSITIVE, near_positives(sent.value, batches, positives))

    def first_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_anchor, taken = None, 0
        for ids, keys in _runs(batches):
            keep = []
            for k, a in enumerate(keys["anchor"].tolist()):
                if a != open_anchor:
                    open_anchor, taken = a, 0
                if taken < positives:
                    keep.append(k)
                    taken += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys["anchor"][keep].astype(np.int64)), pa.array(ids[keep]), pa.array([keys[k].tobytes() for k in keep], pa.binary())], names=["anchor", "anchor_id", "key"]
            )

    source = rows.select("at", "id", "label", "v")
    firsts = materialize(shuffled(source.mapInArrow(positive_keys, _KEYED)).mapInArrow(first_positives, _KEYED), "mine-positives")
    # the windows of this pass's anchors: at most `positives` a anchor
    known = unpack(firsts.select("key").toArrow().column("key").combine_chunks()) if block.at.size else np.zeros(0, _KEY)
    known = np.sort(known, order=["anchor", "falling", "id", "at"])
    score, _ = scores_of(known)
    at = np.searchsorted(block.at, known["anchor"].astype(np.int64))
    begins = np.searchsorted(at, np.arange(len(block.at)))
    nth = np.arange(len(at)) - begins[at]
    windowed = Block(block.at, block.ids, block.labels, block.x)
    windowed.low, windowed.high = np.ones((len(block.at), positives), np.int64), np.zeros((len(block.at), positives), np.int64)
    windowed.low[at, nth], windowed.high[at, nth] = -(-low * score // 100), high * score // 100
    sent_windows = spark.sparkContext.broadcast(windowed)

    def negative_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _keys(sent_windows.value, _NEGATIVE, near_negatives(sent_windows.value, batches, negatives))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_anchor, opened = None, []
        for ids, keys in _runs(batches):
            score, other = scores_of(keys)
            found = []
            for a, name, kind, s, o in zip(keys["anchor"].tolist(), ids.tolist(), keys["kind"].tolist(), score.tolist(), other.tolist(), strict=True):
                if a != open_anchor:
                    open_anchor, opened = a, []
                if kind == _POSITIVE:
                    opened.append([o, s, 0])
                    continue
                for window in opened:
                    if window[2] < negatives and low * window[1] <= 100 * s <= high * window[1]:
                        window[2] += 1
                        found.append((name, window[0], window[2], o, window[1], s))
            columns = list(zip(*found, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
            )

    keys = firsts.union(source.mapInArrow(negative_keys, _KEYED))
    return materialize(shuffled(keys).mapInArrow(windows, OUT), "mine-negatives")


#: The contract's rows in SQL.
MINE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.c, b.c) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
