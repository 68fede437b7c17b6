"""Words of UTF-8 text as numpy arrays over the raw bytes of an Arrow column.

All functions work on one piece of a batch at a time, a few megabytes of text,
so memory in a task is bounded by the piece or by the longest single document.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20

_U = np.uint64
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _caches() -> dict:
    return sys.modules.setdefault("_echoframe_worker_cache", types.ModuleType("_echoframe_worker_cache")).__dict__.setdefault("held", {})


def release_worker(*keep: str) -> None:
    """Give back what earlier tasks of other operators left in this reused Python worker, but for the named caches.

    Called when a task begins, so that a job of several operators needs the
    memory of one at a time.
    """
    caches = _caches()
    for name in caches.keys() - set(keep):
        del caches[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def worker_cache(name: str, key: object) -> dict:
    """A dict that lives until another operator's task begins in the Python worker; one per name, emptied when the key changes."""
    caches = _caches()
    held = caches.get(name)
    if held is None or held[0] != key:
        held = caches[name] = (key, {})
    return held[1]


def text_lengths(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Every batch in consecutive slices of about ``size`` bytes of text, at least one row each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(text_lengths(batch.column(column)))
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows one after the other, and len + 1 offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_class(separators: Iterable[int] = (), words: Iterable[int] | None = None) -> np.ndarray:
    """256 flags: which bytes belong to words, by the separators or by the word bytes."""
    flags = np.full(256, words is None)
    flags[list(separators)] = False
    if words is not None:
        flags[list(words)] = True
    return flags


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of word bytes; runs never cross rows."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class WordHasher:
    """64-bit hashes of ranges of an array of bytes or code points.

    Every block of eight bytes goes through ``mix`` together with its place in
    the word, and a word is the mixed sum of its blocks. Blocks are random to
    each other, so texts with a structure (periods, words built from two others)
    collide no more often than any: two given words with a chance of 2**-64.
    """

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, _U)
        raw = np.concatenate([np.ascontiguousarray(data).view(np.uint8), np.zeros(8, np.uint8)])
        at_byte = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from any byte on
        begin, size = starts * data.itemsize, (ends - starts) * data.itemsize
        out = self._blocks(at_byte, begin, size, np.zeros(len(begin), np.int64))
        long = np.flatnonzero(size > 8)
        if len(long):
            more = (size[long] - 1) // 8  # blocks behind the first
            last = np.cumsum(more)
            nth = np.arange(last[-1]) - np.repeat(last - more, more) + 1
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(self._blocks(at_byte, np.repeat(begin[long], more), np.repeat(size[long], more), nth), dtype=_U)])
            out[long] += sums[last] - sums[last - more]
        return mix(out + size.astype(_U) * _U(0xD6E8FEB86659FD93))

    @staticmethod
    def _blocks(at_byte: np.ndarray, begin: np.ndarray, size: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Block number ``nth`` of words, cut at the word's end, mixed with its number."""
        block = at_byte[begin + 8 * nth]
        short = 8 - np.minimum(size - 8 * nth, 8)
        block <<= (8 * short).astype(_U)  # a block of no bytes does not occur: words are not empty
        return mix(mix(block ^ _BASE) + nth.astype(_U) * _STEP)
