"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by documents: each row is a block of documents with
all its terms and, per term, the sorted positions where it stands. It is built
without a shuffle, stored once, and searched for any number of test sets. A
phrase is found from the rarest of its terms in a block: that term's positions,
less its offset, are the possible starts, and the lists of the other terms,
rarest first, are intersected with them. Blocks without one of the terms drop
out at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoframe.llm.textbytes import LOWER, WordHasher, byte_class, pieces, raw_bytes, release_worker, word_bounds
from echoframe.session import materialize

WINDOW = 10
BLOCK_BYTES = 2 << 20
#: Test text searched for at once; a larger test set is searched for in several passes.
PASS_BYTES = 8 << 20

_WORD = byte_class(separators=[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_U = np.uint64
INDEX_SCHEMA = "block long, doc_ids array<long>, n_words binary, terms binary, begins binary, places binary"


def words_of(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, A-Z lower-cased."""
    low = LOWER[data]
    starts, ends, row = word_bounds(low, offsets, _WORD)
    return hasher(low, starts, ends), row


def postings(h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct terms, where the list of each begins (one more at the end), and all lists in ascending order."""
    if not len(h):
        return np.zeros(0, _U), np.zeros(1, np.int64), np.zeros(0, np.int64)
    bits = _U(int(place[-1]).bit_length())
    # one sort of a packed key, unless two terms of the block share the kept hash bits
    packed = np.sort((h >> bits << bits) | place.astype(_U))
    at = (packed & ((_U(1) << bits) - _U(1))).astype(np.int64)
    by_place = np.zeros(int(place[-1]) + 1, _U)
    by_place[place] = h
    terms = by_place[at]
    if np.any((terms[1:] != terms[:-1]) & (packed[1:] >> bits == packed[:-1] >> bits)):
        order = np.lexsort((place, h))
        terms, at = h[order], place[order]
    begins = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    return terms[begins], np.append(begins, len(at)), at


def build_index(docs: DataFrame, name: str = "positional-index") -> DataFrame:
    """The stored index of ``doc_id, text``; one row per block of about ``BLOCK_BYTES`` of text.

    Positions count the words of a block, with one place free after every
    document, so no phrase crosses two. Every word of every text is indexed;
    null texts have none. Memory is bounded by a block or the longest document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        hasher, part, k = WordHasher(), TaskContext.get().partitionId(), 0
        for batch in pieces(batches, size=BLOCK_BYTES):
            data, offsets = raw_bytes(batch.column("text"))
            h, row = words_of(data, offsets, hasher)
            n_words = np.bincount(row, minlength=batch.num_rows)
            terms, begins, at = postings(h, np.arange(len(h)) + row)
            binary = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) | k], pa.int64()),
                    pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    binary(n_words, "<u4"), binary(terms, "<u8"), binary(begins, "<u4"), binary(at, "<u4"),
                ],
                names=["block", "doc_ids", "n_words", "terms", "begins", "places"],
            )
            k += 1

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX_SCHEMA), name)


@dataclass
class Phrases:
    """Distinct word windows of a part of the test set, by length, and the items of each."""

    words: dict[int, np.ndarray] = field(default_factory=dict)
    items: dict[int, list[list[str]]] = field(default_factory=dict)


def phrases(rows: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    """Windows of ``window`` consecutive words; an item of fewer, but not none, is one window."""
    found: dict[int, dict[tuple, set[str]]] = {}
    hasher = WordHasher()
    for item, text in rows:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        h = words_of(data, np.array([0, len(data)]), hasher)[0].tolist()
        size = min(window, len(h))
        for k in range(len(h) - size + 1 if size else 0):
            found.setdefault(size, {}).setdefault(tuple(h[k : k + size]), set()).add(str(item))
    return Phrases(
        {n: np.array(list(w), _U).reshape(-1, n) for n, w in found.items()}, {n: [sorted(i) for i in w.values()] for n, w in found.items()}
    )


class Block:
    """One row of the index as arrays."""

    def __init__(self, row: dict) -> None:
        self.block, self.doc_ids = row["block"], row["doc_ids"]
        self.n_words = np.frombuffer(row["n_words"], "<u4").astype(np.int64)
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.begins = np.frombuffer(row["begins"], "<u4").astype(np.int64)
        self.places = np.frombuffer(row["places"], "<u4").astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words + 1)])

    def lookup(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the term in this block, and the length of its list, 0 where it has none."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return i, np.where(self.terms[i] == terms, np.diff(self.begins)[i], 0)

    def find(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact occurrence."""
        term, count = self.lookup(windows)
        live = np.flatnonzero((count > 0).all(axis=1))
        none = np.zeros(0, np.int64)
        if not len(live):
            return none, none
        term, count = term[live], count[live]
        order = np.argsort(count, axis=1, kind="stable")
        rarest = order[:, 0]
        pick = np.arange(len(live))
        n = count[pick, rarest]
        window = np.repeat(pick, n)
        inside = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        start = self.places[self.begins[term[window, rarest[window]]] + inside] - rarest[window]
        window, start = window[start >= 0], start[start >= 0]
        keys = None
        for k in range(1, windows.shape[1]):
            if not len(start):
                return none, none
            if keys is None:  # all lists one after the other, as one sorted array
                keys = (np.repeat(np.arange(len(self.terms)), np.diff(self.begins)) << 32) | self.places
            column = order[window, k]
            want = (term[window, column] << 32) | (start + column)
            i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[i] == want
            window, start = window[hit], start[hit]
        return live[window], start

    def near(self, window: np.ndarray, slop: int) -> np.ndarray:
        """Places of the last word of every match in order with at most ``slop`` other words before each next one."""
        term, count = self.lookup(window)
        if not len(window) or not count.all():
            return np.zeros(0, np.int64)
        at = lambda k: self.places[self.begins[term[k]] : self.begins[term[k] + 1]]
        doc = lambda p: np.searchsorted(self.first, p, "right")
        reached = at(0)
        for k in range(1, len(window)):
            if not len(reached):
                break
            places = at(k)
            i = np.searchsorted(reached, places, "left") - 1
            before = reached[np.maximum(i, 0)]
            reached = places[(i >= 0) & (places - before <= slop + 1) & (doc(places) == doc(before))]
        return reached


HITS_SCHEMA = "block long, ordinal int, doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<begin:long,end:long>>"


def _search(index: DataFrame, wanted: Phrases, spans: bool) -> DataFrame:
    """One row per document with its hit words, items and, if asked for, merged spans."""
    held = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        wanted = held.value
        for row in (r for batch in batches for r in batch.to_pylist()):
            b = Block(row)
            n_docs, total = len(b.n_words), int(b.first[-1])
            edge = np.zeros(total + 1, np.int64)
            items: dict[int, set[str]] = {}
            for size, windows in wanted.words.items():
                window, start = b.find(windows)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + size, -1)
                doc = np.searchsorted(b.first, start, "right") - 1
                for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
                    items.setdefault(d, set()).update(wanted.items[size][w])
            hit = np.cumsum(edge)[:total] > 0
            n_hit = np.add.reduceat(hit.astype(np.int64), b.first[:-1]) if total else np.zeros(n_docs, np.int64)
            found: list[list[dict]] = [[] for _ in range(n_docs)]
            if spans and items:
                flank = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                for s, e in zip(np.flatnonzero(flank == 1).tolist(), np.flatnonzero(flank == -1).tolist(), strict=True):
                    d = int(np.searchsorted(b.first, s, "right")) - 1
                    found[d].append({"begin": s - int(b.first[d]), "end": e - int(b.first[d])})
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b.block] * n_docs, pa.int64()), pa.array(range(n_docs), pa.int32()), pa.array(b.doc_ids, pa.int64()),
                    pa.array(b.n_words), pa.array(n_hit.astype(np.int64)),
                    pa.array([sorted(items.get(d, ())) for d in range(n_docs)], pa.list_(pa.string())),
                    pa.array(found, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["block", "ordinal", "doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return index.mapInArrow(run, HITS_SCHEMA)


def test_passes(benchmark: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The test set in parts of at most ``PASS_BYTES`` of text, or one item; at least one part."""
    part: list[tuple[object, str | None]] = []
    size, any_yet = 0, False
    for row in benchmark.select("item_id", "text").filter(F.col("item_id").isNotNull()).toLocalIterator():
        n = len((row["text"] or "").encode("utf-8", "surrogatepass"))
        if part and size + n > PASS_BYTES:
            yield part
            part, size, any_yet = [], 0, True
        part.append((row["item_id"], row["text"]))
        size += n
    if part or not any_yet:
        yield part


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, spans: bool = False) -> DataFrame:
    """``block, ordinal, doc_id, n_words, n_hit, items, spans`` for every document row.

    ``n_hit`` counts the words inside any occurrence of a test window, ``items``
    are the ids of the items with occurring windows, as sorted strings. ``block``
    and ``ordinal`` name the row, so null and repeated ids stay apart. Null
    texts have no words; null items are left out; repeated items count once. Of
    the test set at most ``PASS_BYTES`` are sent to the tasks at once; if there
    is more, each part is a pass over the stored index and spans are merged by
    row.
    """
    index = build_index(docs)
    parts = test_passes(benchmark)
    first = next(parts)
    second = next(parts, None)
    if second is None:
        return _search(index, phrases(first, window), spans)
    results = materialize(_search(index, phrases(first, window), True), "contamination")
    for part in itertools.chain([second], parts):
        results = results.union(materialize(_search(index, phrases(part, window), True), "contamination"))
    key = ["block", "ordinal"]
    merged = results.groupBy(*key).agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    places = results.select(*key, F.explode("spans").alias("s")).select(*key, F.explode(F.sequence(F.col("s.begin"), F.col("s.end") - 1)).alias("p")).distinct()
    hits = places.groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"))
    ranges = results.select(*key, F.explode("spans").alias("s")).groupBy(*key).agg(F.array_sort(F.collect_list("s")).alias("spans"))
    return merged.join(hits, key, "left").join(ranges, key, "left").select(
        *key, "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "items", F.coalesce("spans", F.array().cast("array<struct<begin:long,end:long>>")).alias("spans")
    )


def proximity(index: DataFrame, text: str, slop: int) -> DataFrame:
    """``doc_id, place`` of the last word of every ordered match of ``text`` with at most ``slop`` words between neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        window = words_of(data, np.array([0, len(data)]), WordHasher())[0]
        for row in (r for batch in batches for r in batch.to_pylist()):
            b = Block(row)
            at = b.near(window, slop)
            doc = np.searchsorted(b.first, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.doc_ids[d] for d in doc], pa.int64()), pa.array(at - b.first[doc])], names=["doc_id", "place"]
            )

    return index.mapInArrow(run, "doc_id long, place long")
