"""Tokenizer over a vocabulary: the cheapest way through the lattice of pieces.

A text is cut where white space begins, which no piece may reach across, and
every part is covered by pieces of the vocabulary with the least sum of costs;
of equal sums the one with fewer pieces, then the one whose last pieces are
longest. A sign that no piece covers is a piece of its own at a cost above all
others. The pieces of a text joined are the text.

The vocabulary is compiled into a trie of arrays once per worker. A batch's
distinct parts are solved side by side, by length: one step of the trie and one
comparison for all of them at once.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import sys
import types
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Parts of a text: white space with what follows it, and white space at the end.
PARTS = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+\Z")
#: Costs are whole numbers, so that sums compare alike wherever they are made; a piece more costs one unit below them.
COST_UNIT, PIECE_UNIT = 1000, 1 << 20
#: Cells of the table that solves parts side by side, and distinct parts remembered by a worker, in signs.
CELLS, REMEMBERED = 4 << 20, 1 << 20
#: Texts cut at once: their pieces are Python objects until they are an Arrow array.
TEXTS = 128
_FAR = np.iinfo(np.int64).max // 4


def rank_costs(pieces: Iterable[str]) -> dict[str, int]:
    """Costs of pieces given from the most to the least frequent: the logarithm of the rank, as frequencies of words fall."""
    return {p: round(COST_UNIT * math.log(rank + 2)) for rank, p in enumerate(pieces)}


def read_ranked_pieces(spark: SparkSession, path: str) -> dict[str, int]:
    """Costs from a vocabulary of lines ``base64-of-piece rank``; pieces that are no whole UTF-8 text are left out.

    A vocabulary is a model parameter of fixed size and is sent to every task.
    """
    costs = {}
    for row in spark.read.text(path).collect():
        piece, _, rank = row["value"].partition(" ")
        try:
            costs[base64.b64decode(piece).decode("utf-8")] = round(COST_UNIT * math.log(int(rank) + 2))
        except UnicodeDecodeError:
            continue
    return costs


class Lattice:
    """A compiled vocabulary. Nodes of the trie are numbers; an edge is found by node and sign in one sorted array."""

    def __init__(self, costs: Mapping[str, int]) -> None:
        children: dict[tuple[int, int], int] = {}
        cost = {0: _FAR}
        deepest = 1
        for piece, c in costs.items():
            node = 0
            for sign in piece:
                node = children.setdefault((node, ord(sign)), len(children) + 1)
            if node:
                cost[node] = min(cost.get(node, _FAR), c * PIECE_UNIT + 1)
                deepest = max(deepest, len(piece))
        keys = np.array([a << 21 | s for a, s in children], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.nodes = np.fromiter(children.values(), np.int64, len(children))[order]
        self.cost = np.array([cost.get(n, _FAR) for n in range(len(children) + 1)], np.int64)
        self.deepest = deepest
        self.unknown = (max(costs.values(), default=0) + COST_UNIT) * PIECE_UNIT + 1

    def step(self, node: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Next nodes; -1 where the trie has none, or had none before."""
        if not len(self.keys):
            return np.full(len(node), -1)
        key = np.where(node < 0, -1, node << 21 | sign)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nodes[at], -1)

    def solve(self, parts: np.ndarray) -> np.ndarray:
        """For parts of one length, a row of code points each: per end the length of the last piece of the best way there."""
        count, length = parts.shape
        best = np.full((length + 1, count), _FAR, np.int64)
        last = np.zeros((length + 1, count), np.int64)
        best[0] = 0
        for begin in range(length):
            reached = best[begin]
            node = np.zeros(count, np.int64)
            for end in range(begin + 1, min(begin + self.deepest, length) + 1):
                node = self.step(node, parts[:, end - 1])
                if end > begin + 1 and not (node >= 0).any():
                    break
                cost = np.where(node >= 0, self.cost[node], _FAR)
                if end == begin + 1:
                    cost = np.minimum(cost, self.unknown)
                total = np.where(cost < _FAR, reached + cost, _FAR)
                better = total < best[end]  # begins come in order, so of equal sums the longest last piece stays
                best[end][better] = total[better]
                last[end][better] = end - begin
        return last.T

    def cut(self, parts: list[str]) -> list[list[str]]:
        """Pieces of every part."""
        by_length: dict[int, list[int]] = {}
        for k, part in enumerate(parts):
            by_length.setdefault(len(part), []).append(k)
        out: list[list[str]] = [[] for _ in parts]
        for length, places in by_length.items():
            rows = max(1, CELLS // (length + 1))
            for begin in range(0, len(places) if length else 0, rows):
                some = places[begin : begin + rows]
                points = np.frombuffer("".join(parts[k] for k in some).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
                for k, last in zip(some, self.solve(points.reshape(len(some), length)).tolist(), strict=True):
                    end, pieces = length, []
                    while end:
                        pieces.append(parts[k][end - last[end] : end])
                        end -= last[end]
                    out[k] = pieces[::-1]
        return out


class Cutter:
    """A lattice with the parts that it has solved, as far as they fit."""

    def __init__(self, costs: Mapping[str, int]) -> None:
        self.lattice = Lattice(costs)
        self.known: dict[str, list[str]] = {}
        self.held = 0

    def __call__(self, texts: list[str | None]) -> list[list[str] | None]:
        parts = [None if t is None else PARTS.findall(t) for t in texts]
        fresh = list(dict.fromkeys(p for own in parts if own is not None for p in own if p not in self.known))
        solved = dict(zip(fresh, self.lattice.cut(fresh), strict=True))
        out = [None if own is None else [x for p in own for x in (solved.get(p) or self.known[p])] for own in parts]
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        self.known.update((p, x) for p, x in solved.items() if len(p) <= 64)
        self.held += sum(len(p) for p in fresh if len(p) <= 64)
        return out


def lattice_tokenizer(spark: SparkSession, costs: Mapping[str, int]):  # noqa: ANN201
    """A tokenizer plug-in: a column function from text to pieces. Null texts have none; an empty text has no pieces."""
    sent = spark.sparkContext.broadcast(dict(costs))
    name = hashlib.sha256(repr(sorted(costs.items())).encode("utf-8", "surrogatepass")).hexdigest()

    @F.arrow_udf("array<string>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = sys.modules.setdefault("_echoframe_lattices", types.ModuleType("_echoframe_lattices")).__dict__
        if name not in held:  # once per worker; another vocabulary takes its place
            for old in [k for k in held if not k.startswith("__")]:
                del held[old]
            held[name] = Cutter(sent.value)
        for texts in batches:
            yield pa.concat_arrays(
                [
                    pa.array(held[name](texts.slice(k, TEXTS).to_pylist()), pa.list_(pa.string()))
                    for k in range(0, max(len(texts), 1), TEXTS)
                ]
            )

    def tokenize(text: Column) -> Column:
        return pieces(text)

    return tokenize
