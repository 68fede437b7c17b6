"""URL filtering by a bit-parallel wildcard automaton.

All glob rules are laid out one after the other as bits of a row of 64-bit
words. Reading one symbol of a url moves every rule at once: shift, mask with
the symbol's word, keep the bits that wait at a ``*``. A whole batch of urls is
a matrix of such rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbol between host and path: no byte of a url can be it.
BORDER = 256
SYMBOLS = 257
_U = np.uint64


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains and a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def glob(self) -> list[int]:
        """Symbols over ``.host BORDER path``; -1 is a star, which never crosses the border before its host."""
        return [-1, *f".{self.host}".encode(), BORDER, *self.path.encode(), -1]


class Automaton:
    """Multiword Shift-And over any number of globs."""

    def __init__(self, globs: Sequence[Sequence[int]]) -> None:
        bits = sum(1 + sum(s >= 0 for s in g) for g in globs)
        self.words = max(1, -(-bits // 64))
        masks = np.zeros((SYMBOLS, self.words * 64), bool)
        stay = np.zeros(self.words * 64, bool)
        border = np.zeros(self.words * 64, bool)
        start = np.zeros(self.words * 64, bool)
        self.accept = []
        at = 0
        for glob in globs:
            start[at] = True
            for symbol in glob:
                if symbol < 0:
                    stay[at] = True
                else:
                    at += 1
                    masks[symbol, at] = True
                    border[at] = symbol == BORDER
            self.accept.append(at)
            at += 1
        # a star in front of the host keeps its bit for host bytes only
        before = np.zeros_like(stay)
        at = 0
        for glob in globs:
            crossed = False
            for symbol in glob:
                if symbol < 0 and not crossed:
                    before[at] = True
                elif symbol >= 0:
                    at += 1
                    crossed = crossed or symbol == BORDER
            at += 1
        pack = lambda x: np.packbits(x.reshape(*x.shape[:-1], self.words, 64), axis=-1, bitorder="little").view(_U)[..., 0]
        self.masks = pack(masks)
        self.stay = np.broadcast_to(pack(stay), (SYMBOLS, self.words)).copy()
        self.stay[BORDER] = pack(stay & ~before)
        self.start = pack(start)

    def run(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """State words of every string after its last symbol."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        falling = -lengths[order]
        state = np.broadcast_to(self.start, (len(lengths), self.words)).copy()
        for k in range(int(lengths.max(initial=0))):
            live = order[: np.searchsorted(falling, -k, "left")]
            symbol = symbols[offsets[live] + k]
            now = state[live]
            moved = now << _U(1)
            moved[:, 1:] |= now[:, :-1] >> _U(63)
            state[live] = (moved & self.masks[symbol]) | (now & self.stay[symbol])
        return state

    def accepted(self, state: np.ndarray) -> np.ndarray:
        """One column per glob: whether the string matches it as a whole."""
        return np.stack([(state[:, a // 64] >> _U(a % 64)) & _U(1) for a in self.accept], axis=1).astype(bool)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path up to ``?`` or ``#``; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end].translate(_LOWER), rest[end:]
    stop = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return host, tail[:stop]


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row.

    The longest rule that fits decides; of rules of one length the first given.
    Where none fits the verdict is ``default``: this filter blocks only what a
    rule blocks. Null urls and urls without ``://`` have an empty host and path
    and fit no rule. Rows are neither dropped nor moved between tasks.
    """
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    ranked = [rules[i] for i in order]
    names = np.array([r.name for r in ranked] + [None], dtype=object)
    verdicts = np.array([r.verdict for r in ranked] + [default], dtype=object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([r.glob() for r in ranked])
        for batch in batches:
            parts = [host_and_path(u) for u in batch.column(1).to_pylist()]
            rows = [(b"." + h.encode("utf-8", "surrogatepass"), p.encode("utf-8", "surrogatepass")) for h, p in parts]
            lengths = np.array([len(h) + 1 + len(p) for h, p in rows], np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            symbols = np.frombuffer(b"".join(h + b"\0" + p for h, p in rows), np.uint8).astype(np.int64)
            symbols[offsets[:-1] + np.array([len(h) for h, _ in rows], np.int64)] = BORDER
            if ranked:
                fits = automaton.accepted(automaton.run(symbols, offsets))
                best = np.where(fits.any(axis=1), fits.argmax(axis=1), len(ranked))
            else:
                best = np.zeros(len(rows), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array(names[best].tolist(), pa.string()),
                    pa.array(verdicts[best].tolist(), pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(
        judge, "page_id long, host string, path string, rule string, verdict string"
    )
