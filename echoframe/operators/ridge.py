"""Ridge regression from words to vectors without the matrix of features squared.

The normal equations are solved by conjugate gradients: every step needs the
product of the rows' matrix, and then of its transpose, with one block of
directions, and rows are sparse. A step is one pass over the words of the stored
rows; a task adds up its share of the product and gives on the features it met,
shares are added per block of features across the cluster, and what the driver
holds are a few matrices of the weights' own size. Output columns are solved in
blocks whose bytes are bounded, each with its own step lengths. What makes steps
many are the words of many rows, as they come together; the preconditioner solves
the equations of the most frequent ones, a bounded number, and the diagonal of the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoframe.functions import text as T
from echoframe.functions.vectors import as_matrix
from echoframe.operators.inference import token_buckets
from echoframe.operators.positions import DataCheckError
from echoframe.session import materialize

FEATURES = 1 << 18
#: Bytes of one block of weights, and features of a block in which shares are added.
BLOCK_BYTES, SUM_FEATURES = 32 << 20, 4096
#: Features whose equations the preconditioner solves: at most so many, and at most this part of all.
FREQUENT, FREQUENT_PART = 2048, 16
#: Words, or pairs of words, that a task looks at together (those of a single row aside).
AT_ONCE = 1 << 18

SHARES = "block bigint, place binary, part binary"

@dataclass(frozen=True)
class SparseRidge:
    """Weights of the features that occur, and of the constant in the last row."""

    features: int
    active: np.ndarray
    weights: np.ndarray
    residuals: np.ndarray  # relative, per output column
    right_norms: np.ndarray  # of the right sides that they are relative to
    steps: int

    def predict(self, explanation: str | Column) -> Column:
        """The vector for a text; NULL stays NULL, words that the fit never saw weigh nothing."""
        active, weights = self.active, self.weights
        buckets = token_buckets(T.tokenize(explanation, None), self.features)

        @F.arrow_udf("array<double>")
        def apply(b: pa.Array) -> pa.Array:
            present = np.asarray(b.is_valid())
            word, begin = _words(b.drop_null(), active)
            rows = _sums(np.vstack([weights[:-1], np.zeros((1, weights.shape[1]))])[word], begin) + weights[-1]
            offsets = np.concatenate([[0], np.cumsum(np.where(present, weights.shape[1], 0))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)), mask=pa.array(~present))

        return apply(buckets)


def _words(lists: pa.Array, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all words among the active features (their number where a word is none), and where rows begin, one more at the end."""
    flat = np.asarray(lists.flatten()).astype(np.int64)
    sizes = np.asarray(lists.value_lengths()).astype(np.int64)
    at = np.searchsorted(active, flat)
    known = (at < len(active)) & (active[np.minimum(at, max(len(active) - 1, 0))] == flat) if len(active) else np.zeros(len(flat), bool)
    return np.where(known, at, len(active)), np.concatenate([[0], np.cumsum(sizes)])


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; empty stretches sum to zero."""
    total, some = np.zeros((len(begin) - 1, values.shape[1])), np.diff(begin) > 0
    if some.any():
        total[some] = np.add.reduceat(values, begin[:-1][some], axis=0)
    return total


def _slices(begin: np.ndarray) -> Iterator[slice]:
    """Consecutive rows that hold ``AT_ONCE`` together, or one row."""
    at = 0
    while at < len(begin) - 1:
        end = max(at + 1, int(np.searchsorted(begin, begin[at] + AT_ONCE, side="right")) - 1)
        yield slice(at, end)
        at = end


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all lists in a row, and where lists begin, one more at the end."""
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    return np.asarray(column.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def _add(shares: DataFrame, size: int, columns: int) -> np.ndarray:
    """The sum of ``SHARES``, a matrix of ``size`` rows. A task adds the blocks that it is dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, place, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = sums.setdefault(block, np.zeros((min(SUM_FEATURES, size - block * SUM_FEATURES), columns)))
                at[np.frombuffer(place, np.int32)] += np.frombuffer(part).reshape(-1, columns)
        for block, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["block", "part"])

    out = np.zeros((size, columns))
    sums = shares.repartition("block").mapInArrow(run, "block bigint, part binary").toArrow()
    for block, part in zip(sums.column("block").to_pylist(), sums.column("part"), strict=True):
        rows = np.frombuffer(part.as_buffer()).reshape(-1, columns)
        out[block * SUM_FEATURES : block * SUM_FEATURES + len(rows)] += rows
    return out


def _shares(total: np.ndarray, met: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``SHARES`` of a task: the rows of its matrix that it met."""
    for k in range(0, len(total), SUM_FEATURES):
        place = np.flatnonzero(met[k : k + SUM_FEATURES])
        if len(place):
            part = [[k // SUM_FEATURES], [place.astype(np.int32).tobytes()], [total[k + place].tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(part, (pa.int64(), pa.binary(), pa.binary()))], names=["block", "place", "part"])


class Rows:
    """Stored rows ``b, y`` as a sparse matrix with a constant column, and sums over it.

    The words are written once more as their places among the active features: steps read nothing else.
    """

    def __init__(self, stored: DataFrame, active: np.ndarray) -> None:
        sent, self.size = stored.sparkSession.sparkContext.broadcast(active), len(active) + 1

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                word, begin = _words(batch.column(0), sent.value)
                words = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(word.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([words, batch.column(1)], names=["word", "y"])

        self.active, self.spark = active, stored.sparkSession
        self.stored = materialize(stored.mapInArrow(placed, "word array<int>, y array<double>"), "ridge-words")
        sent.destroy()

    def transposed(self, of_rows: Callable[..., np.ndarray], columns: int, outputs: bool = False) -> np.ndarray:
        """X' Z, where ``of_rows(word, begin)`` gives the rows of Z for some rows; with ``outputs`` it gets their y as well."""
        size = self.size

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, met = np.zeros((size, columns)), np.zeros(size, bool)
            for batch in batches:
                words, begins = _lists(batch.column(0))
                y = as_matrix(batch.column(1))[1] if outputs and batch.num_rows else None
                for rows in _slices(begins):
                    begin = begins[rows.start : rows.stop + 1]
                    word, begin = words[begin[0] : begin[-1]], begin - begin[0]
                    z = of_rows(word, begin, y[rows]) if outputs else of_rows(word, begin)
                    order = np.argsort(word, kind="stable")
                    found, first = np.unique(word[order], return_index=True)
                    row = np.repeat(np.arange(len(z)), np.diff(begin))[order]
                    total[found] += _sums(z[row], np.append(first, len(row)))
                    total[-1] += z.sum(axis=0)
                    met[found] = met[-1] = True
            yield from _shares(total, met)

        return _add(self.stored.select("word", *["y"] * outputs).mapInArrow(fold, SHARES), size, columns)

    def normal(self, directions: np.ndarray) -> np.ndarray:
        """X' X P, in one pass."""
        sent = self.spark.sparkContext.broadcast(directions)
        out = self.transposed(lambda word, begin: _sums(sent.value[word], begin) + sent.value[-1], directions.shape[1])
        sent.destroy()
        return out

    def gram(self, chosen: np.ndarray) -> np.ndarray:
        """X' X of the chosen columns, of which the last is the constant, over the pairs of words in each row."""
        place, k = np.full(self.size, -1, np.int32), len(chosen)
        place[chosen] = np.arange(k)
        sent = self.spark.sparkContext.broadcast(place)

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k * k)
            for batch in batches:
                words, begin = _lists(batch.column(0))
                at, row = sent.value[words], np.repeat(np.arange(batch.num_rows), np.diff(begin))
                constant = np.arange(batch.num_rows) * k + k - 1
                cell, times = np.unique(np.concatenate([(row * k + at)[at >= 0], constant]), return_counts=True)
                row, at = cell // k, cell % k
                sizes = np.bincount(row, minlength=batch.num_rows)
                ends, pairs = np.cumsum(sizes), np.concatenate([[0], np.cumsum(sizes**2)])
                for rows in _slices(pairs):
                    own = np.arange(ends[rows.start] - sizes[rows.start], ends[rows.stop - 1])
                    many = sizes[row[own]]
                    left = np.repeat(own, many)
                    right = np.repeat(ends[row[own]] - np.cumsum(many), many) + np.arange(len(left))
                    cells, which = np.unique(at[left] * k + at[right], return_inverse=True)
                    total[cells] += np.bincount(which, times[left] * times[right])
            square = total.reshape(k, k)
            yield from _shares(square, square.any(axis=1))

        out = _add(self.stored.select("word").mapInArrow(fold, SHARES), k, k)
        sent.destroy()
        return out


def fit_ridge_sparse(
    labelled: DataFrame,
    explanation: str = "api_explanation",
    vector: str = "activation_vector",
    features: int = FEATURES,
    penalty: float = 1.0,
    tolerance: float = 1e-9,
    most_steps: int = 500,
) -> SparseRidge:
    """Weights that minimise squared error plus ``penalty`` times the squared weights, the constant's aside.

    Rows without a text or a vector are left out. Stops when the residual of
    every output is ``tolerance`` of the right side, or after ``most_steps``;
    ``residuals`` tells how far it came.
    """
    pairs = labelled.filter(F.col(explanation).isNotNull() & F.col(vector).isNotNull())
    stored = materialize(
        pairs.select(token_buckets(T.tokenize(explanation, None), features).alias("b"), F.col(vector).cast("array<double>").alias("y")), "ridge-rows"
    )
    found = stored.select(F.explode(F.array_distinct("b")).alias("f")).distinct().toArrow().column("f")  # at most `features` numbers
    widths = [r[0] for r in stored.select(F.size("y")).distinct().limit(2).collect()]
    if len(widths) != 1:
        raise DataCheckError("nothing to fit: no labelled vectors" if not widths else f"vector lengths differ: {sorted(widths)}")
    rows = Rows(stored, np.sort(np.asarray(found).astype(np.int64)))
    size, width = len(rows.active) + 1, widths[0]

    ridge = np.full((size, 1), float(penalty))
    ridge[-1] = 0.0  # the constant is not penalised
    often = rows.transposed(lambda w, b: np.ones((len(b) - 1, 1)), 1)  # how often a word occurs
    solve = _preconditioner(rows, often, ridge)
    columns = max(1, min(width, BLOCK_BYTES // (8 * size)))
    solved, residuals, norms, steps = [], [], [], 0
    for k in range(0, width, columns):
        part = slice(k, min(k + columns, width))
        right = rows.transposed(lambda w, b, y, part=part: y[:, part], part.stop - part.start, outputs=True)
        weights, rest, n = _conjugate(lambda p: rows.normal(p) + ridge * p, right, solve, tolerance, most_steps)
        solved.append(weights)
        residuals.append(rest)
        norms.append(np.linalg.norm(right, axis=0))
        steps = max(steps, n)
    return SparseRidge(features, rows.active, np.hstack(solved), np.concatenate(residuals), np.concatenate(norms), steps)


def _preconditioner(rows: Rows, often: np.ndarray, ridge: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Solves the equations of the most frequent words and the constant among themselves, and the diagonal of the others."""
    scale = 1.0 / np.maximum(often + ridge, 1e-12)
    some = np.argsort(-often[:-1, 0], kind="stable")[: min(FREQUENT, len(often) // FREQUENT_PART)]
    chosen = np.append(some, len(often) - 1)
    values, sides = np.linalg.eigh(rows.gram(chosen) + np.diag(ridge[chosen, 0]))
    inverse = (sides / np.maximum(values, 1e-10 * values[-1])) @ sides.T

    def solve(r: np.ndarray) -> np.ndarray:
        out = scale * r
        out[chosen] = inverse @ r[chosen]
        return out

    return solve


def _conjugate(
    product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, solve: Callable[[np.ndarray], np.ndarray], tolerance: float, most: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """Solutions, relative residuals and steps; every column has its own step lengths and rests once it is solved."""
    norm = np.maximum(np.linalg.norm(right, axis=0), 1e-300)
    x, r = np.zeros_like(right), right.copy()
    z = solve(r)
    p, rz = z.copy(), (r * z).sum(axis=0)
    for step in range(most):
        rest = np.linalg.norm(r, axis=0) / norm
        if (rest <= tolerance).all():
            break
        q = product(p)
        curve = (p * q).sum(axis=0)
        a = np.where((rest > tolerance) & (curve > 0), rz / np.where(curve > 0, curve, 1.0), 0.0)
        x += a * p
        r -= a * q
        z = solve(r)
        new = (r * z).sum(axis=0)
        p = z + np.where(rz > 0, new / np.where(rz > 0, rz, 1.0), 0.0) * p
        rz = new
    else:
        step = most
    r = right - product(x)  # the true residual, not the updated one
    return x, np.linalg.norm(r, axis=0) / norm, step
