"""Exact nearest labelled vectors by cosine, over all labels.

An inverted file with bounds: labels go to the cell of their nearest pivot and,
in it, to a ring by their angle to the pivot. Angles obey the triangle
inequality, so the angles of a query to the pivots bound its angle to every
ring from below. Rings are packed into parts of bounded size, queries too, and
each pair of parts meets in a task of its own, which sends on the best of its
labels. In it the labels of a cell lie in tiles of neighbouring rings, and some
queries of one neighbourhood at a time open the tiles of the lowest bounds
first; after every round the worst answer so far of each query rules out the
tiles that cannot hold a better one: a few tiles, some more, and all that are
left in reach. A tile is compared in single precision, whose error has a bound
too; what may be among the best by it is compared again in double precision.
What is ruled out is ruled out by a bound, so the answers are those of a
comparison with every label, with ties by key.

Where no bound holds, as in many dimensions, this is a comparison of all pairs:
a row is sent once for each part of the other side, memory is that of two parts
and the work grows with the product of both numbers. Pivots and ring sizes are
fitted to the table (a square root of it, bounded in bytes) and change the work
only. Labels of equal vectors are one label as far as answers can tell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoframe.functions import text as T
from echoframe.operators.sampling import natural_rank
from echoframe.session import materialize

#: Tiles opened by the end of a round, by rising bounds; the last round has no end.
ROUNDS = (4, 32, None)
RING = 0.02
PIVOT_BYTES = 8 << 20
#: Labels of a part, queries of a part, and queries compared at once.
RING_ROWS, QUERY_ROWS, BATCH_ROWS = 1 << 16, 1 << 16, 2048
#: Labels of a tile.
TILE_ROWS = 1024
#: Bytes of the vectors of a part, and numbers in a table of angles or similarities.
PART_BYTES, CELLS = 32 << 20, 2 << 20
DIGITS = 9
#: Far above what arithmetic and the rounding of similarities can move an angle by.
SLACK = 1e-6


@dataclass(frozen=True)
class Rings:
    """Unit pivots, and per ring its cell and the angles it spans."""

    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def angles(self, unit: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(unit @ self.pivots.T, -1.0, 1.0))

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """Least angle between each vector and any label of each ring."""
        to = self.angles(unit)[:, self.cell]
        return np.maximum(0.0, np.maximum(to - self.high, self.low - to))


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _cosines(dots: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Rounded, so that ties do not hang on the order of a sum; ``q`` and ``m`` are norms."""
    return np.round(dots / q / m, DIGITS)


def similarities(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Rounded cosines of all pairs."""
    return _cosines(q @ m.T, np.linalg.norm(q, axis=1)[:, None], np.linalg.norm(m, axis=1)[None, :])


def _screen(width: int) -> float:
    """Far above what single precision can move a cosine of vectors of ``width`` numbers by, and the rounding of similarities."""
    return (width + 16) * 2.0**-23 + 10.0**-DIGITS * 2


def _directed(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has a direction, as doubles in ``v``."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.withColumn("v", v).filter(finite & F.exists("v", lambda x: x != 0))


def _best(rows: DataFrame, samples: int) -> DataFrame:
    order = W.partitionBy("qid").orderBy(F.col("similarity").desc(), "lid")
    return rows.withColumn("sample_id", F.row_number().over(order) - 1).filter(F.col("sample_id") < samples)


def _rings_of(labels: DataFrame, n: int, width: int) -> tuple[DataFrame, Rings, list[int]]:
    """Labels with ``ring``, the rings, and the number of labels in each."""
    wanted = max(1, min(int(np.ceil(np.sqrt(n))), PIVOT_BYTES // (8 * width)))
    chosen = labels.select("v").orderBy(F.xxhash64("lid"), "lid").limit(wanted).toArrow().column("v").combine_chunks()
    pivots = _unit(_rows(chosen))
    sent = labels.sparkSession.sparkContext.broadcast(pivots)  # arrays only: the package need not be on the executors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Rings(sent.value, *[np.zeros(0)] * 3)
        for batch in batches:
            rows = max(1, min(BATCH_ROWS, CELLS // len(here.pivots)))
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                angle = here.angles(_unit(_rows(part.column("v"))))
                cell = angle.argmin(axis=1)
                own = angle[np.arange(len(cell)), cell]
                yield pa.RecordBatch.from_arrays(
                    [part.column("lid"), part.column("v"), pa.array(cell), pa.array((own / RING).astype(np.int64)), pa.array(own)],
                    names=["lid", "v", "cell", "band", "angle"],
                )

    placed = materialize(labels.mapInArrow(place, "lid long, v array<double>, cell long, band long, angle double"), "nearest-placed")
    spans = placed.groupBy("cell", "band").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    # at most pi / RING rings a pivot, whatever the number of labels
    table = sorted(spans.collect(), key=lambda r: (r["cell"], r["band"]))
    rings = Rings(pivots, *(np.array([r[c] for r in table]) for c in ("cell", "low", "high")))
    numbers = labels.sparkSession.createDataFrame(
        pa.table({"ring": pa.array(range(len(table)), pa.int64()), **{c: pa.array([r[c] for r in table], pa.int64()) for c in ("cell", "band")}})
    )
    return placed.join(F.broadcast(numbers), ["cell", "band"]).select("lid", "v", "ring"), rings, [r["n"] for r in table]


def nearest_labels(vectors: DataFrame, labelled: DataFrame, keys: Sequence[str], samples: int = 1, vector: str = "activation_vector") -> DataFrame:
    """``vectors`` with ``sample_id``, ``similarity`` and the ``keys`` of the nearest labelled vectors as ``near_<key>``.

    ``keys`` identify the labelled rows; the nearest come first, ties by key. A
    vector without a direction (null, empty, all zero, or with null or
    non-finite parts) is near to nothing, as is one of another length than the
    labels. With fewer labels than ``samples`` a vector gets all of them.
    """
    spark = vectors.sparkSession
    labels = natural_rank(_directed(labelled.select(*keys, vector), vector).select(*keys, "v"), list(keys), "lid")
    labels = materialize(labels, "nearest-labels")
    # of equal vectors only the first can be among the answers
    equal = W.partitionBy(F.xxhash64("v"), "v").orderBy("lid")
    kept = materialize(labels.withColumn("nth", F.row_number().over(equal)).filter(F.col("nth") <= samples).select("lid", "v"), "nearest-distinct")
    asked = materialize(vectors.withColumn("qid", F.monotonically_increasing_id()), "nearest-queries")
    found = None
    for row in kept.groupBy(F.size("v").alias("width")).count().collect():
        same = _directed(asked, vector).filter(F.size("v") == row["width"]).select("qid", "v")
        part = _nearest(same, kept.filter(F.size("v") == row["width"]), row["count"], row["width"], samples)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "qid long, similarity double, lid long, sample_id int")
    names = labels.select("lid", *(F.col(k).alias(f"near_{k}") for k in keys))
    return asked.join(found.join(names, "lid").drop("lid"), "qid").drop("qid")


def _parts(sizes: Sequence[int], most: int) -> list[tuple[int, int]]:
    """Per ring its first part and the number of its parts: small rings share one, large ones are split."""
    out, part, held = [], 0, 0
    for size in sizes:
        if held and held + size > most:
            part, held = part + 1, 0
        own = max(1, -(-size // most))
        out.append((part, own))
        part, held = (part + own, 0) if own > 1 else (part, held + size)
    return out


def _nearest(queries: DataFrame, labels: DataFrame, n: int, width: int, samples: int) -> DataFrame:
    """``qid, similarity, lid, sample_id`` of vectors of one length."""
    spark = queries.sparkSession
    placed, rings, sizes = _rings_of(labels, n, width)
    room = max(1, PART_BYTES // (8 * width))
    parts = _parts(sizes, min(RING_ROWS, room))
    total = max(first + own for first, own in parts)
    asked = queries.count()
    shares = max(-(-asked // min(QUERY_ROWS, room)), min(-(-2 * spark.sparkContext.defaultParallelism // total), -(-asked // BATCH_ROWS)), 1)
    found = _compare(queries, placed, rings, parts, total, shares, samples)
    return materialize(_best(found, samples), "nearest-best")


def _slots(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that hash partitioning deals to ``n`` different partitions."""
    found: dict[int, int] = {}
    begin, size = 0, 16 * n
    while len(found) < n:
        ids = spark.range(begin, begin + size, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("at"))
        found = {**{r["at"]: r["id"] for r in ids.groupBy("at").agg(F.min("id").alias("id")).collect()}, **found}
        begin, size = begin + size, size * 2
    return [found[k] for k in range(n)]


def _compare(queries: DataFrame, placed: DataFrame, rings: Rings, parts: list[tuple[int, int]], total: int, shares: int, samples: int) -> DataFrame:
    """``qid, similarity, lid``: the best of every part of the labels for each query."""
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast((rings.pivots, rings.cell, rings.low, rings.high))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    long_ = lambda values: pa.array(values, pa.int64())
    places = spark.createDataFrame(pa.table({"ring": long_(range(len(parts))), "first": long_([p[0] for p in parts]), "own": long_([p[1] for p in parts])}))
    slots = spark.createDataFrame(pa.table({"pair": long_(range(total * shares)), "slot": long_(_slots(spark, total * shares))}))
    q = queries.withColumn("b", F.pmod(F.xxhash64("qid"), F.lit(shares).cast("long"))).withColumn("a", numbers(total))
    m = placed.join(F.broadcast(places), "ring").withColumn("a", F.col("first") + F.pmod(F.xxhash64("lid"), F.col("own"))).withColumn("b", numbers(shares))

    def dealt(rows: DataFrame, *columns: str) -> DataFrame:
        """A pair of parts is a task, whatever its bytes: its work is the product of its rows."""
        slotted = rows.withColumn("pair", F.col("a") * shares + F.col("b")).join(F.broadcast(slots), "pair")
        return slotted.select(F.col("slot").alias("task"), *columns).repartition(total * shares, "task")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"qid": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64()), "lid": pa.array([], pa.int64())})
        right = right.sort_by([("ring", "ascending"), ("lid", "ascending")])
        lid, qid = np.asarray(right.column("lid")), np.asarray(left.column("qid"))
        x, y = _rows(left.column("v").combine_chunks()), _rows(right.column("v").combine_chunks())
        tiles = _tiles(np.asarray(right.column("ring")), Rings(*sent.value))
        labels = Labels(lid, y, np.linalg.norm(y, axis=1), _unit(y).astype(np.float32))
        unit = _unit(x)
        rows = max(1, min(BATCH_ROWS, CELLS // max(TILE_ROWS, len(tiles.low))))
        near = np.concatenate([(unit[k : k + rows] @ tiles.pivots.T).argmax(axis=1) for k in range(0, len(x), rows)])
        order = np.argsort(near, kind="stable")
        out = []
        for k in range(0, len(x), rows):
            at = order[k : k + rows]
            s, names = _opened(x[at], unit[at], labels, tiles, samples)
            some = names >= 0
            out.append((np.repeat(qid[at], some.sum(axis=1)), s[some], names[some]))
        qs, ss, ls = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"qid": qs, "similarity": ss, "lid": ls})

    left, right = dealt(q, "qid", "v").groupBy("task"), dealt(m, "lid", "ring", "v").groupBy("task")
    return left.cogroup(right).applyInArrow(best, "qid long, similarity double, lid long")


@dataclass(frozen=True)
class Labels:
    """Labels of a part in the order of their rings: numbers, vectors, norms, and unit vectors in single precision."""

    lid: np.ndarray
    v: np.ndarray
    norm: np.ndarray
    unit: np.ndarray


@dataclass(frozen=True)
class Tiles(Rings):
    """Rings of one cell that lie one after the other, and the rows that they take."""

    begin: np.ndarray
    end: np.ndarray


def _tiles(ring: np.ndarray, rings: Rings) -> Tiles:
    """Tiles over labels that are sorted by ``ring``; of the pivots only those of cells that are met."""
    met, cell = np.unique(rings.cell[ring], return_inverse=True)
    edges = np.flatnonzero(np.diff(cell, prepend=-1))
    begin = np.concatenate([np.arange(a, b, TILE_ROWS) for a, b in zip(edges, np.append(edges[1:], len(ring)), strict=True)])
    end = np.append(begin[1:], len(ring))
    return Tiles(rings.pivots[met], cell[begin], rings.low[ring[begin]], rings.high[ring[end - 1]], begin, end)


def _opened(q: np.ndarray, unit: np.ndarray, labels: Labels, tiles: Tiles, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Best similarities of some queries among the labels of tiles, with the labels' numbers; -1 where there are too few."""
    top, names = np.full((len(q), samples), -np.inf), np.full((len(q), samples), -1, np.int64)
    bounds, norm, single = tiles.bounds(unit), np.linalg.norm(q, axis=1), unit.astype(np.float32)
    rising, opened = np.argsort(bounds.min(axis=0), kind="stable"), 0
    table = np.empty(len(q) * int((tiles.end - tiles.begin).max()), np.float32)
    for stop in ROUNDS:
        chosen = rising[opened:stop]
        opened = len(rising) if stop is None else min(stop, len(rising))
        reach = np.arccos(np.clip(top[:, -1] - 10.0**-DIGITS * 2, -1.0, 1.0)) + SLACK
        wanted = bounds[:, chosen].T <= reach
        for tile, asked in zip(chosen, wanted, strict=True):
            rows = np.flatnonzero(asked)
            if not len(rows):
                continue
            begin, end = tiles.begin[tile], tiles.end[tile]
            s = table[: len(rows) * (end - begin)].reshape(len(rows), -1)
            np.matmul(single if len(rows) == len(q) else single[rows], labels.unit[begin:end].T, out=s)
            i, j = _candidates(s, top[rows, -1], samples, _screen(q.shape[1]))
            if len(i):
                _merge(top, names, rows[i], begin + j, q, norm, labels)
    return top, names


def _candidates(s: np.ndarray, last: np.ndarray, samples: int, error: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of a table of similarities that may be as good as the last answer of their row, or as the last of the table's own best."""
    floor = (last - error).astype(np.float32)
    hit = np.flatnonzero(s.max(axis=1) >= floor)
    some = s[hit]
    good = some >= floor[hit, None]
    many = np.flatnonzero(np.count_nonzero(good, axis=1) > 2 * samples)  # more than can stay: as good as the table's own best
    if len(many):
        own = np.partition(some[many], s.shape[1] - samples, axis=1)[:, -samples] - np.float32(2 * error)
        good[many] &= some[many] >= own[:, None]
    i, j = np.nonzero(good)
    return hit[i], j


def _merge(top: np.ndarray, names: np.ndarray, i: np.ndarray, j: np.ndarray, q: np.ndarray, norm: np.ndarray, labels: Labels) -> None:
    """Compare queries ``i`` with labels ``j`` in double precision and keep the best of each query, in place."""
    samples, most = top.shape[1], np.iinfo(np.int64).max
    step = max(1, CELLS // q.shape[1])
    for k in range(0, len(i), step):
        a, b = i[k : k + step], j[k : k + step]
        value, name = _cosines(np.einsum("nd,nd->n", q[a], labels.v[b]), norm[a], labels.norm[b]), labels.lid[b]
        last = names[a, -1]
        better = (value > top[a, -1]) | (value == top[a, -1]) & ((last < 0) | (name < last))
        if not better.any():
            continue
        met, a = np.unique(a[better], return_inverse=True)
        a = np.concatenate([np.repeat(np.arange(len(met)), samples), a])
        value, name = np.concatenate([top[met].ravel(), value[better]]), np.concatenate([names[met].ravel(), name[better]])
        by = np.lexsort((np.where(name < 0, most, name), -value, a))
        kept = by[np.arange(len(by)) - np.searchsorted(a[by], a[by], side="left") < samples]
        top[met], names[met] = value[kept].reshape(-1, samples), name[kept].reshape(-1, samples)


def verbalise_nearest(
    vectors: DataFrame, labelled: DataFrame, keys: Sequence[str], samples: int = 1, vector: str = "activation_vector", explanation: str = "api_explanation"
) -> DataFrame:
    """Add ``sample_id`` and ``response``: descriptions of the nearest labelled vectors, nearest first."""
    near = nearest_labels(vectors, labelled, keys, samples, vector)
    texts = labelled.select(*(F.col(k).alias(f"near_{k}") for k in keys), T.wrap_explanation(explanation).alias("response"))
    return near.join(texts, [f"near_{k}" for k in keys]).select(*vectors.columns, "sample_id", "response")
