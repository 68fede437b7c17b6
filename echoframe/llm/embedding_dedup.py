"""Near-duplicate embeddings by int8 tile products with error bounds.

Every vector is scaled to unit length and rounded to 8-bit codes; the length of
what rounding lost is kept per vector. For codes q, r with scales s, t and lost
parts of lengths e, f the cosine differs from s t (q . r) by at most
|sq| f + |tr| e + e f. Only pairs whose bound reaches the threshold are
computed again in double precision, so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoframe.llm.components import components, roots
from echoframe.session import materialize

THRESHOLD = 0.9
#: Vectors of a block, and bytes of them as doubles; a tile compares two blocks. Bounds memory of a task.
BLOCK, BLOCK_BYTES = 8192, 32 << 20
ROWS = 512
#: Rounding of the products themselves, far above what float arithmetic loses here.
SLACK = 1e-4


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and lengths of the lost parts of unit row vectors."""
    scale = np.maximum(np.abs(x).max(axis=1, initial=0.0), 1e-300) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(x - codes * scale[:, None], axis=1)
    return codes, scale, lost


class Tile:
    """One block: ids, copies, vectors as given, and their quantised unit form."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, raw: np.ndarray) -> None:
        self.ids, self.copies = ids, copies
        peak = np.abs(raw).max(axis=1, keepdims=True, initial=0.0)
        x = raw / np.where(peak > 0, peak, 1.0)  # neither overflow nor underflow of squares
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.codes, self.scale, self.lost = quantise(self.unit)
        self.reach = np.linalg.norm(self.codes * self.scale[:, None], axis=1)


def tile_links(a: Tile, b: Tile, same: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Linked vectors per vector of both blocks, copies included, and a spanning forest of the links."""
    count_a, count_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    forest: list[tuple[np.ndarray, np.ndarray]] = []
    right = b.codes.astype(np.float32).T.copy()
    # products of codes are whole numbers below 2**24 for up to 1000 dimensions: exact in single precision
    worst = a.reach.max() * b.lost.max() + b.reach.max() * a.lost.max() + a.lost.max() * b.lost.max()
    for k in range(0, len(a.ids), ROWS):
        rows = slice(k, min(k + ROWS, len(a.ids)))
        product = a.codes[rows].astype(np.float32) @ right
        product *= a.scale[rows, None].astype(np.float32)
        need = ((threshold - SLACK - worst) / b.scale).astype(np.float32)
        i, j = np.nonzero(product >= need)
        if not len(i):
            continue
        if len(i) > 0.02 * product.size:  # many: all of these rows in full precision
            link = a.unit[rows] @ b.unit.T >= threshold
            i, j = np.nonzero(link)
            i = i + k
        else:
            i = i + k
            bound = a.reach[i] * b.lost[j] + b.reach[j] * a.lost[i] + a.lost[i] * b.lost[j] + SLACK
            maybe = product[i - k, j] * b.scale[j] + bound >= threshold
            i, j = i[maybe], j[maybe]
            exact = np.concatenate([np.einsum("ij,ij->i", a.unit[i[s : s + 65536]], b.unit[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
            i, j = i[exact >= threshold], j[exact >= threshold]
        if same:
            i, j = i[i != j], j[i != j]
        count_a += np.bincount(i, b.copies[j], len(a.ids)).astype(np.int64)
        if not same:
            count_b += np.bincount(j, a.copies[i], len(b.ids)).astype(np.int64)
        if len(i):
            nodes, low = roots(a.ids[i], b.ids[j])
            forest.append((nodes[nodes != low], low[nodes != low]))
    u = np.concatenate([f[0] for f in forest] or [np.zeros(0, np.int64)])
    v = np.concatenate([f[1] for f in forest] or [np.zeros(0, np.int64)])
    if len(u):
        nodes, low = roots(u, v)
        u, v = nodes[nodes != low], low[nodes != low]
    return count_a, count_b, u, v


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    values = np.asarray(whole.flatten()).astype(np.float64)
    return values.reshape(len(whole), -1)


def _tile(table: pa.Table) -> pa.Table:
    """Counts (``b`` null) and forest edges of one tile."""
    side = np.asarray(table.column("side"))
    ids, copies, raw = np.asarray(table.column("rep")), np.asarray(table.column("copies")), _matrix(table.column("v"))
    order = np.argsort(ids, kind="stable")
    pick = lambda k: order[side[order] == k]
    first = pick(0)
    same = not (side == 1).any()
    second = first if same else pick(1)
    if not len(first) or not len(second):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    a = Tile(ids[first], copies[first], raw[first])
    b = a if same else Tile(ids[second], copies[second], raw[second])
    count_a, count_b, u, v = tile_links(a, b, same)
    ids_n = a.ids if same else np.concatenate([a.ids, b.ids])
    n = count_a if same else np.concatenate([count_a, count_b])
    has = n > 0
    return pa.table({
        "a": np.concatenate([ids_n[has], u]),
        "b": pa.concat_arrays([pa.nulls(int(has.sum()), pa.int64()), pa.array(v)]),
        "n": np.concatenate([n[has], np.zeros(len(u), np.int64)]),
    })


def near_duplicates(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding``.

    Vectors with a cosine of at least ``THRESHOLD`` link. A vector that is
    null, empty, all zero, or holds null, NaN or infinite components links with
    nothing, nor does a row without an id; vectors of different lengths never
    link. Equal vectors are compared once and counted as often as they occur,
    repeated ids included. An empty table gives no rows.

    All pairs are compared, by tiles of two blocks: a block meets every other
    block once, tasks hold two blocks, and what leaves a tile is one count per
    vector and a spanning forest, never all pairs.
    """
    usable = F.coalesce(
        (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    rows = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        .withColumn("usable", usable & F.col("vec_id").isNotNull())
        .withColumn("h1", F.when(F.col("usable"), F.xxhash64("v"))).withColumn("h2", F.when(F.col("usable"), F.xxhash64(F.lit(11), F.reverse("v"))))
    )
    keys = materialize(rows.select("vec_id", "usable", "h1", "h2"), "embedding-keys")
    reps = materialize(
        rows.filter("usable").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")),
        "embedding-reps",
    )
    total, widest = reps.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, -(-total // max(1, min(block, BLOCK_BYTES // (8 * (widest or 1))))))
    placed = reps.withColumn("at", F.pmod(F.xxhash64("h1", F.lit(5)), F.lit(blocks)).cast("int")).withColumn("width", F.size("v"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    tiles = placed.withColumn("other", F.explode(others)).select(
        F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "width",
        F.when(F.col("at") <= F.col("other"), 0).otherwise(1).alias("side"), "rep", "copies", "v",
    )
    found = materialize(tiles.groupBy("width", "i", "j").applyInArrow(_tile, "a long, b long, n long"), "embedding-links")
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    linked = components(found.filter("b is not null").select("a", "b"), "embedding-components")
    state = (
        reps.select("h1", "h2", "rep", "copies")
        .join(counts, F.col("rep") == F.col("a"), "left").join(linked, F.col("rep") == F.col("node"), "left")
        .select("h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = keys.join(state, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
