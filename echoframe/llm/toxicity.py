"""Toxicity by a learned lexicon, Levenshtein automata over its trie, and context windows.

1. Words and word beginnings are counted in the labelled training rows by label;
   those that mark toxic rows become the lexicon.
2. The lexicon is a trie. Its product with the automaton of edit distance 1 is
   run as one lazily built deterministic automaton over every word of a text.
3. Every hit is weighed by the words and quotation marks around it, and a text's
   score is the chance that at least one hit is meant.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoframe.llm.labelled import MAX_LABELLED, held_out, labelled_sample
from echoframe.llm.textbytes import release_worker, worker_cache
from echoframe.session import materialize

#: Settings of the fit.
MIN_ROWS, MIN_CHANCE, LEVEL = 3, 0.5, 0.05
#: Weight, in rows, of what misspellings of terms of one length are in general.
PRIOR_ROWS = 3.0
STEMS = (4, 5, 6)
FUZZY_LENGTH = 5
BASE = 0.02
WINDOW_WORDS, WINDOW_CHARS = 6, 80
QUOTED, REPORTED = 0.35, 0.5

#: Words that report another's words, by language.
REPORTING = frozenset(
    "said says say told wrote writes called calls quoted quotes quote quoting word words term terms slur slurs insult insults "
    "allegedly reportedly sagte sagt schrieb nannte zitat wort begriff beleidigung dit disait écrit appelé citation mot insulte "
    "dijo dice escribió llamó cita palabra término insulto".split()
)

_WORD = re.compile(r"[^\W\d_]+")
_OPEN = re.compile(r"[\"“„«‹‘][^\"“”„«»‹›‘’]*$")
_CLOSE = re.compile(r"^[^\"“”„«»‹›‘’]*[\"”“»›’]")


@dataclass(frozen=True)
class Term:
    """A lexicon entry; ``stem`` entries match every word that begins so."""

    text: str
    stem: bool
    exact: float
    fuzzy: float


class LexiconAutomaton:
    """Trie of the terms times the Levenshtein automaton of one edit, determinised on demand."""

    LIMIT = 100_000

    def __init__(self, terms: list[Term]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.exact, self.fuzzy, self.stem = [0.0], [0.0], [0.0]
        for term in terms:
            node = 0
            for c in term.text:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    for values in (self.exact, self.fuzzy, self.stem):
                        values.append(0.0)
                node = self.next[node][c]
            if term.stem:
                self.stem[node] = max(self.stem[node], term.exact)
            else:
                self.exact[node] = max(self.exact[node], term.exact)
                self.fuzzy[node] = max(self.fuzzy[node], term.fuzzy)
        # whether a fuzzy end lies at or below a node: children come after their parents
        self.below = [f > 0 for f in self.fuzzy]
        for node in range(len(self.next) - 1, -1, -1):
            self.below[node] = self.below[node] or any(self.below[k] for k in self.next[node].values())
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.begin = self._state({0: 0}, 0.0)

    def _state(self, nodes: dict[int, int], stem: float) -> int:
        key = (tuple(sorted(nodes.items())), stem)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        nodes, stem = self.sets[state]
        new: dict[int, int] = {}
        for node, errors in nodes:
            here = self.next[node]
            if c in here:
                new[here[c]] = min(errors, new.get(here[c], 2))
                if not errors:
                    stem = max(stem, self.stem[here[c]])
            if errors:
                continue
            if self.below[node]:
                new.setdefault(node, 1)  # c is an extra letter
            for k, child in here.items():
                if self.below[child]:
                    if k != c:
                        new.setdefault(child, 1)  # c stands for k
                    if c in self.next[child] and self.below[self.next[child][c]]:
                        new.setdefault(self.next[child][c], 1)  # k is missing
        to = self._state(new, stem)
        self.moves[state][c] = to
        return to

    def chance(self, word: str) -> float:
        """The best entry that the word meets; 0 where it meets none."""
        if len(self.sets) > self.LIMIT:
            self._reset()
        state = self.begin
        for c in word:
            moves = self.moves[state]
            state = moves[c] if c in moves else self._step(state, c)
            if not self.sets[state][0]:
                break
        nodes, best = self.sets[state]
        if not nodes:
            return best
        for node, errors in nodes:
            if errors:
                best = max(best, self.fuzzy[node])
            else:
                best = max(best, self.exact[node], self.fuzzy[node], *(self.fuzzy[k] for k in self.next[node].values()))
        return best


def lower_bound(hits: float, misses: float, z: float = 1.64) -> float:
    """Wilson's lower bound of a rate."""
    n = hits + misses
    if n <= 0:
        return 0.0
    p = hits / n
    return max(0.0, (p + z * z / (2 * n) - z * ((p * (1 - p) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n))


def similar_class(words: list[str]) -> int:
    """Min-hash over pairs of following words: the same for copies and mostly for near copies, for other texts another."""
    pairs = {f"{a} {b}".encode("utf-8", "surrogatepass") for a, b in zip(words, words[1:])} or {words[0].encode("utf-8", "surrogatepass")}
    low = min(pairs, key=lambda p: (zlib.crc32(p), p))
    return int.from_bytes(blake2b(low, digest_size=8).digest(), "little", signed=True)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a term by label and class of similar texts."""
    release_worker()
    found: dict[tuple[str, int], list[int]] = {}

    def flush() -> pa.RecordBatch:
        keys, values = list(found), list(found.values())
        found.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
             *(pa.array([v[k] for v in values], pa.int64()) for k in range(2))],
            names=["term", "class", "t", "c"],
        )

    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            in_order = _WORD.findall(text.lower())
            if not in_order:
                continue
            words, own = set(in_order), similar_class(in_order)
            terms = words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}
            for term in terms:
                v = found.get((term, own))
                if v is None:
                    v = found[term, own] = [0, 0]
                v[1 - y] += 1
            if len(found) > 300_000:
                yield flush()
    if found:
        yield flush()


def tail(hits: int, n: int, rate: float) -> float:
    """Logarithm of the chance of at least ``hits`` of ``n`` at this rate, bounded from above."""
    share = hits / n
    if share <= rate:
        return 0.0
    if share == 1.0:
        return n * math.log(rate)
    return -n * (share * math.log(share / rate) + (1 - share) * math.log((1 - share) / (1 - rate)))


def learn_lexicon(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_LABELLED) -> list[Term]:
    """Every term that passes the test, from at most ``limit`` labelled rows of the training fold.

    A term counts once per class of similar texts, toxic and clean alike and
    without a ceiling, so that the words of one copied text don't pass for
    evidence. It must be met in toxic rows more often
    than chance allows for any of all terms tried, at ``LEVEL``; its chance is a
    lower bound of the share of toxic rows. The chance of a misspelling follows
    the rows that hold words one edit away. Without labelled rows, or with rows
    of one label alone, the lexicon is empty.
    """
    sample = labelled_sample(docs, labels, label, limit)
    counts = materialize(
        sample.select("text", "y").mapInArrow(_count, "term string, class long, t long, c long")
        .groupBy("term", "class").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        .groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_if(F.col("t") > 0).alias("k"), F.count_if(F.col("c") > 0).alias("m")),
        "toxic-terms",
    )
    total = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).agg(
        F.avg(F.col(label)).alias("rate")
    ).first()["rate"]
    if not total or total >= 1.0:
        return []
    tried = counts.filter(F.col("t") + F.col("c") >= MIN_ROWS).count()
    limit_log = math.log(LEVEL / max(1, tried))
    # the test again in Spark, a little wider, so that only terms near or above it come here
    n, share = F.col("k") + F.col("m"), F.col("k") / (F.col("k") + F.col("m"))
    rest = F.when(F.col("m") > 0, (1 - share) * F.log((1 - share) / F.lit(1 - total))).otherwise(0.0)
    passing = (share > total) & (-n * (share * F.log(share / F.lit(total)) + rest) < limit_log + 1e-6)
    rows = counts.filter((F.col("k") >= MIN_ROWS) & (F.col("k") > F.col("m")) & passing).collect()
    chance = {r["term"]: lower_bound(r["k"], r["m"]) for r in rows if tail(r["k"], r["k"] + r["m"], total) < limit_log}
    terms = [Term(k.rstrip("*"), k.endswith("*"), v, v if len(k) >= FUZZY_LENGTH else 0.0) for k, v in sorted(chance.items()) if v >= MIN_CHANCE]
    return _weigh_misspellings(counts, terms)


def _weigh_misspellings(counts: DataFrame, terms: list[Term]) -> list[Term]:
    """The chance of a term's misspellings from the rows with words one edit away, and from terms of its length in general."""
    fuzzy = [t for t in terms if not t.stem and t.fuzzy]
    if not fuzzy:
        return terms
    exact = {t.text for t in terms if not t.stem}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_form: dict[str, list[int]] = {}
        for i, term in enumerate(fuzzy):
            for k in range(len(term.text)):
                by_form.setdefault(term.text[:k] + term.text[k + 1 :], []).append(i)
            by_form.setdefault(term.text, []).append(i)
        automata: dict[int, LexiconAutomaton] = {}
        for batch in batches:
            out: dict[int, list[int]] = {}
            for word, t, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if word in exact:
                    continue
                forms = {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}
                for i in {i for f in forms for i in by_form.get(f, ())}:
                    if i not in automata:
                        automata[i] = LexiconAutomaton([Term(fuzzy[i].text, False, 1.0, 1.0)])
                    if automata[i].chance(word):
                        v = out.setdefault(i, [0, 0])
                        v[0] += t
                        v[1] += c
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(out), pa.int64()), pa.array([v[0] for v in out.values()], pa.int64()), pa.array([v[1] for v in out.values()], pa.int64())],
                names=["i", "t", "c"],
            )

    longest = max(len(t.text) for t in fuzzy) + 1
    seen = {
        r["i"]: (r["t"], r["c"])
        for r in counts.filter((~F.col("term").endswith("*")) & F.length("term").between(FUZZY_LENGTH - 1, longest))
        .select("term", "t", "c").mapInArrow(near, "i long, t long, c long").groupBy("i").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()
    }
    by_length: dict[int, list[int]] = {}
    for i, (t, c) in seen.items():
        v = by_length.setdefault(min(len(fuzzy[i].text), 10), [0, 0])
        v[0] += t
        v[1] += c
    index = {t.text: i for i, t in enumerate(fuzzy)}
    out = []
    for term in terms:
        weight = 0.0
        if term.text in index and not term.stem:
            t, c = seen.get(index[term.text], (0, 0))
            T, C = by_length.get(min(len(term.text), 10), (0, 0))
            general = (T + 1) / (T + C + 2)
            weight = term.fuzzy * (t + PRIOR_ROWS * general) / (t + c + PRIOR_ROWS)
        out.append(Term(term.text, term.stem, term.exact, weight))
    return out


def context_weight(text: str, start: int, end: int) -> float:
    """How far a hit at ``text[start:end]`` is meant: less inside quotation marks or after a reporting word."""
    left, right = text[max(0, start - WINDOW_CHARS) : start], text[end : end + WINDOW_CHARS]
    weight = 1.0
    if _OPEN.search(left) and _CLOSE.search(right):
        weight *= QUOTED
    if REPORTING.intersection(_WORD.findall(left)[-WINDOW_WORDS:]):
        weight *= REPORTED
    return weight


class Scorer:
    """Scores texts; remembers the words it has judged, up to a bound."""

    WORDS = 300_000

    def __init__(self, terms: list[Term]) -> None:
        self.automaton = LexiconAutomaton(terms)
        self.clean: set[str] = set()
        self.hits: dict[str, float] = {}

    def __call__(self, text: str) -> tuple[float, int]:
        """The score and the number of hits."""
        low = text.lower()
        words = set(_WORD.findall(low))
        if len(self.clean) > self.WORDS:
            self.clean = set()
        if len(self.hits) > self.WORDS:
            self.hits = {}
        new = words - self.clean - self.hits.keys()
        chance = self.automaton.chance
        for w in new:
            p = chance(w)
            if p > 0:
                self.hits[w] = p
            else:
                self.clean.add(w)
        met = words & self.hits.keys()
        if not met:
            return BASE, 0
        best: dict[str, float] = {}
        n = 0
        for m in _WORD.finditer(low):
            w = m.group()
            if w in met:
                n += 1
                p = self.hits[w]
                if best.get(w, 0.0) < p:
                    best[w] = max(best.get(w, 0.0), p * context_weight(low, m.start(), m.end()))
        clean = 1.0 - BASE
        for p in best.values():
            clean *= 1.0 - p
        return 1.0 - clean, n


def score(docs: DataFrame, terms: list[Term], threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_hits`` for every row, and the columns in ``keep``.

    Reads every word of the whole text. Null and empty texts have no hits and
    get the base score, repeated and null ids are rows of their own, an empty
    table gives no rows. The terms, whose number the labelled rows bound, travel
    with the task.
    """
    key = hashlib.sha256(repr(terms).encode()).hexdigest()
    kept = [c for c in docs.columns if c in (keep or [])]
    picked = docs.select(F.col("doc_id").cast("long").alias("_id"), held_out(F.col("doc_id")).alias("_held"), F.col("text").alias("_text"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker("toxicity")
        held = worker_cache("toxicity", key)
        if "scorer" not in held:
            held["scorer"] = Scorer(terms)
        scorer = held["scorer"]
        for batch in batches:
            results = [scorer(t or "") for t in batch.column("_text").to_pylist()]
            scores = np.array([s for s, _ in results], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_held"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)),
                 pa.array([n for _, n in results], pa.int64()), *(batch.column(c) for c in kept)],
                names=["doc_id_", "held_out", "score", "predicted", "n_hits", *kept],
            )

    kinds = dict(docs.dtypes)
    schema = "doc_id_ long, held_out boolean, score double, predicted int, n_hits long" + "".join(f", `{c}` {kinds[c]}" for c in kept)
    out = picked.mapInArrow(run, schema)
    return out if kept else out.withColumnRenamed("doc_id_", "doc_id")
