"""Byte-level BPE by a minimal acyclic transducer of frequent words and exact merges of the rest.

Word counts over all documents choose the lexicon. It is compiled into an
acyclic automaton in which equal suffixes share states; numbers on its arcs add
up to a word's place in a table of id sequences. The file is memory-mapped by
the tasks. Words outside it are merged by the tokenizer's ranks, so every text
gets exactly the tokenizer's ids whatever the lexicon holds.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoframe.llm.textbytes import WordHasher, pieces, release_worker, worker_cache
from echoframe.session import materialize, new_table_path

#: How byte-level tokenizers split a text before the merges: a fixed value of the file format.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEXICON_WORDS = 65_536
LEXICON_BYTES = 16 << 20
#: Bins of the histogram of word counts per doubling.
BINS = 32
#: Words longer than this are merged with a heap.
LONG = 64
#: Ids that are decoded at once.
BLOCK = 1 << 16
#: Signs of words that are merged at once.
CELLS = 1 << 20
#: Bytes of words and ids that a task remembers or counts before it starts anew, with what a dict needs for an entry.
REMEMBERED_BYTES, ENTRY_BYTES = 64 << 20, 250
#: Words of so many bytes are not in the lexicon.
LEXICON_WORD = 256


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Tokenizer:
    """A byte-level BPE vocabulary read from a ``tokenizers`` file."""

    pieces: list[bytes]
    merges: dict[int, tuple[int, int]]
    first: list[int]
    special: dict[str, int] = field(default_factory=dict)
    #: The merges as sorted arrays, made on first use.
    tables: tuple | None = None
    #: The bytes of all pieces, and begin and size of each, made on first use.
    flat: tuple | None = None

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("not a byte-level BPE tokenizer without a normaliser")
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max(*vocab.values(), *special.values(), 0) + 1
        table = [b""] * size
        for token, i in vocab.items():
            table[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            table[i] = token.encode()
        merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        by_byte = {b: c for c, b in letters.items()}
        return cls(table, merges, [vocab[by_byte[b]] for b in range(256)], special)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of the lowest rank is joined, leftmost first, until none is left."""
        ids = [self.first[b] for b in word]
        if len(ids) > LONG:
            return self._merge_long(ids)
        get = self.merges.get
        while len(ids) > 1:
            best = at = None
            for k in range(len(ids) - 1):
                m = get(ids[k] << 32 | ids[k + 1])
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, k
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(k: int) -> None:
            if k >= 0 and after[k] < n:
                m = get(ids[k] << 32 | ids[after[k]])
                if m is not None:
                    heapq.heappush(heap, (m[0], k, ids[k], ids[after[k]], m[1]))

        for k in range(n - 1):
            push(k)
        while heap:
            _, k, a, b, joined = heapq.heappop(heap)
            if ids[k] != a or after[k] >= n or ids[after[k]] != b:
                continue
            gone = after[k]
            ids[k], ids[gone] = joined, -1
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            push(before[k])
            push(k)
        return [i for i in ids if i >= 0]

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """The same ids, as little-endian bytes, for many words: one merge in each of them at a step."""
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        if self.tables is None:
            keys = np.fromiter(self.merges.keys(), np.int64, len(self.merges))
            order = np.argsort(keys)
            values = np.array(list(self.merges.values()), np.int32).reshape(-1, 2)[order]
            joined = np.zeros(len(keys) and int(values[:, 0].max()) + 1, np.int32)
            joined[values[:, 0]] = values[:, 1]
            self.tables = keys[order], values, joined
        keys, values, joined = self.tables
        first, none = np.array(self.first, np.int32), np.int32(2**31 - 1)

        def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            pair = a.astype(np.int64) << 32 | b
            i = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            return np.where((a >= 0) & (b >= 0) & (keys[i] == pair), values[i, 0], none)

        low = 0
        for cap in (4, 8, 12, 16, 24, 40, LONG):
            within = np.flatnonzero((size > low) & (size <= cap)) if len(keys) else np.zeros(0, np.int64)
            low, width = cap, cap + 2  # a column that is no sign on either side
            step = CELLS // width
            for rows in (within[k : k + step] for k in range(0, len(within), step)):
                ids = np.full((len(rows), width), -1, np.int32)
                ids[:, 1:-1][np.arange(cap) < size[rows, None]] = first[np.frombuffer(b"".join([words[r] for r in rows]), np.uint8)]
                rank = np.full_like(ids, none)  # of the pair that begins at a sign
                rank[:, :-1] = ranks(ids[:, :-1], ids[:, 1:])
                sign, cost = ids.reshape(-1), rank.reshape(-1)
                after = np.arange(1, ids.size + 1, dtype=np.int32)
                before = after - 2
                live = np.arange(len(rows))
                while len(live):
                    at = live * width + rank[live].argmin(axis=1)
                    best = cost[at]
                    more = best != none
                    live, at, best = live[more], at[more], best[more]
                    gone, left = after[at], before[at]
                    right = after[gone]
                    sign[at], sign[gone], cost[gone] = joined[best], -1, none
                    after[at], before[right] = right, at
                    cost[at], cost[left] = ranks(sign[at], sign[right]), ranks(sign[left], sign[at])
                kept = ids >= 0
                ends = np.cumsum(4 * kept.sum(axis=1)).tolist()
                data = ids[kept].astype("<u4").tobytes()
                for r, (a, b) in zip(rows.tolist(), pairwise([0, *ends]), strict=True):
                    out[r] = data[a:b]
        for r in np.flatnonzero((size > LONG) | (size > 0) & (len(keys) == 0)).tolist():
            out[r] = np.array(self.merge(words[r]), "<u4").tobytes()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        if self.flat is None:
            size = np.array([len(p) for p in self.pieces], np.int64)
            self.flat = np.frombuffer(b"".join(self.pieces), np.uint8), np.cumsum(size) - size, size
        data, begin, size = self.flat
        out = []
        for k in range(0, len(ids), BLOCK):
            part = ids[k : k + BLOCK]
            n = size[part]
            ends = np.cumsum(n)
            out.append(data[np.arange(ends[-1]) + np.repeat(begin[part] - ends + n, n)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The transducer of word -> ids as one block of bytes.

    Words are added in order; a state whose words are complete is replaced by an
    equal one, if there is one. An arc's number is how many words of its state
    come before it, so the numbers along a word add up to its rank.
    """
    register: dict[tuple, int] = {}
    arcs: list[dict[int, int]] = []
    final: list[bool] = []
    below: list[int] = []

    def settle(state: tuple[dict[int, int], bool]) -> int:
        key = (state[1], tuple(sorted(state[0].items())))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(dict(key[1]))
            final.append(state[1])
            below.append(int(state[1]) + sum(below[t] for _, t in key[1]))
        return register[key]

    path: list[list] = [[{}, False]]
    last = b""
    ordered = sorted(w for w in words if w)
    for word in ordered:
        shared = len(os.path.commonprefix([last, word]))
        while len(path) > shared + 1:
            done = path.pop()
            path[-1][0][last[len(path) - 1]] = settle(tuple(done))
        for _ in word[shared:]:
            path.append([{}, False])
        path[-1][1] = True
        last = word
    while len(path) > 1:
        done = path.pop()
        path[-1][0][last[len(path) - 1]] = settle(tuple(done))
    root = settle(tuple(path[0]))
    key, to, number = [], [], []
    for s, out in enumerate(arcs):
        passed = int(final[s])
        for c, t in sorted(out.items()):
            key.append(s << 8 | c)
            to.append(t)
            number.append(passed)
            passed += below[t]
    ends = np.concatenate([[0], np.cumsum([len(words[w]) for w in ordered])]).astype("<u4")
    flat = np.array([i for w in ordered for i in words[w]], "<u4")
    parts = [np.array(x, "<u4").tobytes() for x in (key, to, number, final)] + [ends.tobytes(), flat.tobytes()]
    head = np.array([root, max((len(w) for w in ordered), default=0), *(len(p) for p in parts)], "<u4").tobytes()
    return head + b"".join(parts)


class Lexicon:
    """A compiled lexicon over any buffer, a memory map for one; looks up many words at once."""

    def __init__(self, buffer) -> None:
        head = np.frombuffer(buffer, "<u4", 8)
        self.root, self.longest = int(head[0]), int(head[1])
        at, fields = 32, []
        for size in head[2:].tolist():
            fields.append(np.frombuffer(buffer, "<u4", size // 4, at))
            at += size
        self.key, self.to, self.number, self.final, self.ends, self.flat = fields

    def rank(self, words: list[bytes]) -> np.ndarray:
        """Place of every word in the lexicon, -1 where it is not in it. One step of all words per byte."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        size = np.array([len(w) for w in words], np.int64)
        begins = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8)
        state, total = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero((size > 0) & (size <= self.longest))
        for k in range(self.longest):
            if not len(live) or not len(self.key):
                break
            want = state[live] << 8 | data[begins[live] + k]
            i = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[i] == want
            live, i = live[ok], i[ok]
            state[live] = self.to[i]
            total[live] += self.number[i]
            done = size[live] == k + 1
            ended = live[done]
            hit = self.final[state[ended]] == 1
            out[ended[hit]] = total[ended[hit]]
            live = live[~done]
        return out

    def ids(self, rank: int) -> bytes:
        return self.flat[self.ends[rank] : self.ends[rank + 1]].tobytes()


LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)


def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, other, white space, and the space itself."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    blank = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    kinds[blank] = BLANK
    kinds[0x20] = SPACE
    return kinds


def code_points(text: str) -> np.ndarray:
    """The code points in one, two or four bytes each: as few as the greatest needs, since hashing and comparing take time by bytes."""
    for encoding, kind in (("latin-1", "u1"), ("utf-16-le", "<u2"), ("utf-32-le", "<u4")):
        try:
            points = np.frombuffer(text.encode(encoding), np.uint8)
        except UnicodeEncodeError:
            continue
        if len(points) == len(text) * np.dtype(kind).itemsize:  # no surrogate pairs
            return points.view(kind)
    return points.view("<u4")


def unlike(points: np.ndarray, begin: np.ndarray, end: np.ndarray, example: np.ndarray) -> np.ndarray:
    """Words that differ from their example word, sign by sign. Words cover ``points`` without gaps."""
    size = end - begin
    odd = size != size[example]
    shift = np.where(odd, 0, begin[example] - begin)
    same = points == points[np.arange(begin[0], end[-1]) + np.repeat(shift, size)]
    return np.flatnonzero(odd | ~np.logical_and.reduceat(same, begin - begin[0]))


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of every distinct hash, and the number of the hash at every place."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    number = np.empty(len(hashes), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


class Splitter:
    """Words of many texts at once: what ``SPLIT`` finds, from the classes of neighbouring characters."""

    def __init__(self) -> None:
        cache = worker_cache("characters", unicodedata.unidata_version)
        if "classes" not in cache:
            cache["classes"] = character_classes()
        self.classes = cache["classes"]
        self.hasher = WordHasher()

    def starts(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Flags of the characters where a word begins; rows begin at the offsets."""
        n = len(points)
        kind = self.classes[points]
        white = kind >= BLANK
        kind = np.where(white, np.uint8(BLANK), kind)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first = edge[:n].copy()  # first character of a run
        first[1:] |= kind[1:] != kind[:-1]
        last = edge[1:].copy()
        last[:-1] |= kind[1:] != kind[:-1]
        spaced = np.zeros(n, bool)  # a space of the same row stands before
        spaced[1:] = (points[:-1] == 0x20) & ~edge[1:n]
        # a run takes the space before it; of more white space the last sign stands apart, unless the row ends
        begin = np.where(white, first | (last & ~edge[1:]), first & ~spaced)
        # 's 't 'm 'd 're 've 'll, where the apostrophe is a run of its own without a space before
        mark = np.flatnonzero((points == 0x27) & first & last & ~spaced & ~edge[1:])
        if len(mark):
            padded = np.append(points, [0, 0, 0])
            a, b = padded[mark + 1], padded[mark + 2]
            inside = mark + 2 <= n
            two = inside & (mark + 2 < n) & ~edge[np.minimum(mark + 2, n)] & (
                ((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
            )
            one = np.isin(a, [0x73, 0x74, 0x6D, 0x64])
            begin[mark[one | two] + 1] = False
            after = np.concatenate([mark[one] + 2, mark[two] + 3])
            after = after[after < n]
            begin[after[kind[after] == LETTER]] = True
        return begin

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words, the number of the word at every place, and the places where rows begin, one more at the end."""
        whole = "".join(texts)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        points = code_points(whole)
        if not len(points):
            return [], np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        begin = np.flatnonzero(self.starts(points, offsets))
        end = np.append(begin[1:], len(points))
        example, number = numbered(self.hasher(points, begin, end))
        words = [whole[a:b] for a, b in zip(begin[example].tolist(), end[example].tolist(), strict=True)]
        odd = unlike(points, begin, end, example[number])
        if len(odd):  # other words of the same hash: numbers of their own
            own: dict[str, int] = {}
            for k in odd.tolist():
                number[k] = own.setdefault(whole[begin[k] : end[k]], len(words) + len(own))
            words += own
        return words, number, np.searchsorted(begin, offsets)


def cut_special(texts: list[str], special: dict[str, int]) -> tuple[list[str], list[int], list[int | None]]:
    """Texts cut at special tokens: the parts, the row of each, and the id where a part is a special token."""
    names = sorted(special, key=len, reverse=True)
    pattern = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
    parts, rows, ids = [], [], []
    for row, text in enumerate(texts):
        cut = pattern.split(text) if pattern is not None and any(name in text for name in names) else [text]
        for k, part in enumerate(cut):
            parts.append("" if k % 2 else part)
            rows.append(row)
            ids.append(special[part] if k % 2 else None)
    return parts, rows, ids


class Encoder:
    """Ids of texts, with a bounded memory of the words met."""

    def __init__(self, tokenizer: Tokenizer, lexicon: Lexicon) -> None:
        self.tokenizer, self.lexicon = tokenizer, lexicon
        self.split = Splitter()
        self.known: dict[str, bytes] = {}
        self.held = 0  # signs and ids of the words in it

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words: from memory, else the lexicon, else merged."""
        if self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.held = 0
        found = list(map(self.known.get, words))
        missed = [k for k, ids in enumerate(found) if ids is None]
        raw = [words[k].encode("utf-8") for k in missed]
        rank = self.lexicon.rank(raw).tolist()
        merged = iter(self.tokenizer.merge_many([w for w, r in zip(raw, rank, strict=True) if r < 0]))
        for k, r in zip(missed, rank, strict=True):
            ids = found[k] = self.known[words[k]] = self.lexicon.ids(r) if r >= 0 else next(merged)
            self.held += ENTRY_BYTES + 4 * len(words[k]) + len(ids)
        return found

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        parts, rows, special = cut_special(texts, self.tokenizer.special)
        words, number, places = self.split(parts)
        table = self.ids_of(words)
        size = np.array([len(t) // 4 for t in table], np.int64)
        flat = np.frombuffer(b"".join(table), "<u4")
        begin = np.cumsum(size) - size
        n = size[number]
        ends = np.concatenate([[0], np.cumsum(n)])
        index = np.arange(ends[-1]) + np.repeat(begin[number] - ends[:-1], n)
        ids, cut = flat[index], ends[places]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for k, (row, token) in enumerate(zip(rows, special, strict=True)):
            out[row].append(ids[cut[k] : cut[k + 1]] if token is None else np.array([token], "<u4"))
        for found in out:
            yield found[0] if len(found) == 1 else np.concatenate(found)


def count_words(docs: DataFrame, special: dict[str, int]) -> DataFrame:
    """``word, n`` over the whole texts of all documents; counted per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker("characters")
        split, counts, held = Splitter(), {}, 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in pieces(batches):
            words, number, _ = split(cut_special([t or "" for t in batch.column(0).to_pylist()], special)[0])
            for word, n in zip(words, np.bincount(number, minlength=len(words)).tolist(), strict=True):
                if 4 * len(word) < LEXICON_WORD or len(word) < LEXICON_WORD and len(word.encode("utf-8")) < LEXICON_WORD:  # longer ones are merged
                    before = counts.get(word)
                    if before is None:
                        before, held = 0, held + ENTRY_BYTES + 4 * len(word)
                    counts[word] = before + n
            if held > REMEMBERED_BYTES:
                held = 0
                yield flush()
        if counts:
            yield flush()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _store(spark: SparkSession, data: bytes, path: str) -> None:
    """One file through Spark's file system, wherever the shared folder is."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        for k in range(0, len(data), 1 << 20):
            out.write(bytearray(data[k : k + (1 << 20)]))
    finally:
        out.close()


def build_lexicon(docs: DataFrame, tokenizer: Tokenizer, words: int = LEXICON_WORDS) -> tuple[str, bytes]:
    """Path of the stored transducer of the most frequent words, and its bytes, at most ``LEXICON_BYTES``.

    Words over 255 bytes are left to the merges. The counts are written, and a
    histogram of at most ``64 * BINS`` counts finds the least count that at most
    ``words`` words reach, so the driver gets no more rows than that, however
    many tasks there are.
    """
    spark = docs.sparkSession
    counts = materialize(
        count_words(docs, tokenizer.special).withColumn("bin", F.floor(F.log2("n") * BINS).cast("int")), "bpe-words"
    )
    least, reached = None, 0
    for row in sorted(counts.groupBy("bin").count().collect(), reverse=True):
        reached += row["count"]
        if least is not None and reached > words:
            break
        least = row["bin"]
    frequent = counts.filter(F.col("bin") >= (0 if least is None else least)).orderBy(F.col("n").desc(), "word")
    # the highest bin may be too many words by itself: a part of it then
    top = frequent.limit(words).collect()
    chosen: dict[bytes, list[int]] = {}
    size = 0
    for row in top:
        raw = row["word"].encode("utf-8")
        ids = tokenizer.merge(raw)
        size += 12 * len(raw) + 4 * len(ids) + 4
        if size > LEXICON_BYTES:  # the rest is merged, with the same result
            break
        chosen[raw] = ids
    data = compile_lexicon(chosen)
    path = f"{new_table_path(spark, 'bpe-lexicon')}.fst"
    _store(spark, data, path)
    return path, data


def open_lexicon(path: str, data: bytes) -> Lexicon:
    """The shared file as a memory map; where the shared folder is no mounted file system, the broadcast bytes as one."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        try:
            with open(unquote(parsed.path), "rb") as f:
                mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            if len(mapped) == len(data):
                return Lexicon(mapped)
        except (OSError, ValueError):
            pass
    mapped = mmap.mmap(-1, len(data))
    mapped.write(data)
    return Lexicon(mapped)


def encode_decode(docs: DataFrame, tokenizer_path: str, words: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row, with ``ids`` and ``decoded`` on request.

    Ids are those of the tokenizer file for the whole text without added special
    tokens, digested as little-endian unsigned 32-bit numbers. Null texts count
    as empty; null and repeated ids are kept; an empty table gives no rows.
    Texts are not shuffled.
    """
    tokenizer = Tokenizer.load(tokenizer_path)
    path, data = build_lexicon(docs, tokenizer, words)
    held = docs.sparkSession.sparkContext.broadcast((tokenizer, data))
    key = (tokenizer_path, hashlib.sha256(data).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker("characters", "bpe")
        cache = worker_cache("bpe", key)
        if "encoder" not in cache:
            tokenizer, data = held.value
            cache["encoder"] = Encoder(tokenizer, open_lexicon(path, data))
        encoder = cache["encoder"]
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n, ids_digest, text_digest, ids_out, text_out = [], [], [], [], []
            for ids in encoder(texts):
                decoded = encoder.tokenizer.decode(ids)
                n.append(len(ids))
                ids_digest.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_digest.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if with_ids:
                    ids_out.append(ids.astype(np.int64))
                    text_out.append(decoded)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids_out, pa.list_(pa.int64())), pa.array(text_out, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
