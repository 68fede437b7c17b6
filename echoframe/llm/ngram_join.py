"""Self-join of documents by Jaccard similarity of word shingles, with a token-group matrix.

1. Equal shingle sets are one class. Only classes are compared.
2. In one global order, frequent shingles last, the first n - ceil(0.8 n) + l
   shingles of two linked sets have at least l in common. With l a tenth of the
   set, only shingles of these prefixes that two classes share are kept, and
   only classes that keep enough of them are candidates.
3. Classes with the same min-hash and about the same size form a group. The
   token-group matrix counts the kept shingles that two groups share; with
   fewer than l no class of the one can link to one of the other. Groups that
   pass are held class by class against each other's whole token union, of which
   a class needs four fifths, and classes that pass are compared exactly.
4. First every group is compared with itself, and every class with the first
   class of each shared shingle. What that connects needs no further comparison: the second round
   regroups linked classes by component and leaves the others by min-hash, and
   groups of one component don't meet, so large groups of near copies stay
   linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoframe.llm.components import components, roots
from echoframe.llm.textbytes import LOWER, WordHasher, byte_class, mix, pieces, raw_bytes, release_worker, word_bounds
from echoframe.session import materialize

SHINGLE = 5
#: Similarity of a link, in hundredths; the fraction the prefix filter uses.
PERCENT = 80
#: Frequent shingles whose order is fixed by count: a device of speed, results do not depend on it.
MAX_FREQUENT = 200_000
LOCAL_MIN, STRETCH = 3, 4 << 20
#: A group holds at most so many shingles or classes, or one class.
GROUP_TOKENS, GROUP_CLASSES = 32_768, 256
#: Shingles and classes of guests that a task holds against a host group, give or take one guest.
GUEST_TOKENS, GUEST_CLASSES = 1 << 20, 1024
#: Shingles that prefixes of linked sets must share: one in so many of the smaller set, and one at least.
SHARE = 10

#: Rows of 64 marks each, which tell what texts are opened.
MARK_WORDS = 1 << 18

_WORD = byte_class(separators=[0x20, *range(0x09, 0x0E)])
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row; of a row of fewer than five words the whole sequence is one."""
    low = LOWER[data]
    starts, ends, row = word_bounds(low, offsets, _WORD)
    h = hasher(low, starts, ends)
    n_rows = len(offsets) - 1
    first = np.searchsorted(row, np.arange(n_rows + 1))
    n = len(h)
    grams = np.zeros(0, _U)
    if n >= SHINGLE:
        grams = h[: n - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            grams *= _U(0x9E3779B97F4A7C15)
            grams += h[k : n - SHINGLE + 1 + k]
        grams = mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        size = b - a
        if size >= SHINGLE:
            s = np.sort(grams[a : b - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif size:
            whole = _U(size)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    whole = whole * _U(0xC2B2AE3D27D4EB4F) + x
            out.append(mix(np.array([whole], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that depend on the set alone."""
    a = int(mix(s ^ _U(0x165667B19E3779F9)).sum(dtype=_U)) + len(s)
    b = int(np.bitwise_xor.reduce(mix(s + _U(0x27D4EB2F165667C5)))) if len(s) else 0
    return _signed(a), _signed(b)


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _frequent(kept: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    """Shingles that several of these sets have, with their number."""
    tokens, counts = np.unique(np.concatenate(list(kept.values())), return_counts=True) if kept else (np.zeros(0, _U), np.zeros(0, np.int64))
    often = counts >= LOCAL_MIN
    tokens, counts = tokens[often].view(np.int64), counts[often].astype(np.int64)
    none = pa.nulls(len(tokens), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(tokens), pa.array(counts)], names=_SETS)


_SETS = ["doc_id", "n", "d1", "d2", "low", "token", "count"]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: size, digest and min-hash of its set; besides, shingles that are frequent in a stretch of rows."""
    release_worker()
    hasher, kept, held = WordHasher(), {}, 0
    for batch in pieces(batches):
        data, offsets = raw_bytes(batch.column("text"))
        sets = shingle_sets(data, offsets, hasher)
        digests = [digest(s) for s in sets]
        low = [_signed(int(mix(s + _U(0x85EBCA77C2B2AE63)).min())) if len(s) else None for s in sets]
        for d, s in zip(digests, sets, strict=True):
            if len(s) and d not in kept:
                kept[d] = s
                held += len(s)
        columns = [[len(s) for s in sets], [d[0] for d in digests], [d[1] for d in digests], low]
        none = pa.nulls(len(sets), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), none, none], names=_SETS)
        if held > STRETCH:
            yield _frequent(kept)
            kept, held = {}, 0
    yield _frequent(kept)


def prefix(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + l shingles in the global order: rare ones by hash, then frequent ones by rank."""
    size = len(s) - -(-PERCENT * len(s) // 100) + max(1, len(s) // SHARE)
    if not len(frequent):
        return s[:size]
    i = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    common = frequent[i] == s
    rare = s[~common]
    if len(rare) >= size:
        return rare[:size]
    often = s[common]
    return np.concatenate([rare, often[np.argsort(rank[i[common]], kind="stable")][: size - len(rare)]])


def commonest(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> int | None:
    """The shingle of the prefix that most documents have, if any is frequent: what many classes share, most of them name alike."""
    last = prefix(s, frequent, rank)[-1]
    at = np.searchsorted(frequent, last)
    return int(last.view(np.int64)) if at < len(frequent) and frequent[at] == last else None


def shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ordered by token and class: each once, only those of tokens that two classes have, with the token's first class.

    Streams: of an open token only its first and last class are remembered.
    """
    token, hub, last, given = None, 0, 0, False
    for batch in batches:
        t, c = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(t):
            continue
        if token is not None:  # go on with the open token: its last class stands in front again
            t, c = np.append(token, t), np.append(last, c)
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])
        # copies of the open token's other classes cannot come later: rows are ordered by class
        t, c = t[new], c[new]
        begins = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.append(begins, len(t)))
        out = np.repeat(size > 1, size)
        hubs = c[begins]
        if token is not None:
            hubs[0] = hub
        if token is not None and given:
            out[0] = False  # it was given out with an earlier batch
            out[1 : size[0]] = True
        opened_before = token is not None and len(begins) == 1
        given = bool(size[-1] > 1) or (opened_before and given)
        token, hub, last = int(t[begins[-1]]), int(hubs[-1]), int(c[-1])
        yield pa.RecordBatch.from_arrays([pa.array(t[out]), pa.array(c[out]), pa.array(np.repeat(hubs, size)[out])], names=["token", "d1", "hub"])


class Members:
    """Classes of a group: ids, sizes and their sorted sets one after the other."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray]) -> None:
        self.ids, self.sets = ids, sets
        self.size = np.array([len(s) for s in sets], np.int64)
        self.tokens = np.concatenate(sets)
        self.owner = np.repeat(np.arange(len(sets)), self.size)

    def pick(self, keep: np.ndarray) -> Members | None:
        chosen = np.flatnonzero(keep)
        return Members(self.ids[chosen], [self.sets[i] for i in chosen]) if len(chosen) else None


def bounded(a: Members, union: np.ndarray) -> np.ndarray:
    """Which classes of ``a`` a group with this token union could hold a partner of."""
    i = np.minimum(np.searchsorted(union, a.tokens), len(union) - 1)
    overlap = np.bincount(a.owner, union[i] == a.tokens, minlength=len(a.ids))
    return overlap * 100 >= PERCENT * a.size


def overlaps(a: Members, b: Members) -> np.ndarray:
    """Exact intersection sizes of all classes of two opened groups, by blocks of shared tokens."""
    shared = np.intersect1d(a.tokens, b.tokens)
    total = np.zeros((len(a.ids), len(b.ids)), np.int64)
    step = max(1, (4 << 20) // max(len(a.ids), len(b.ids)))
    for k in range(0, len(shared), step):
        part = shared[k : k + step]

        def incidence(m: Members, part: np.ndarray = part) -> np.ndarray:
            i = np.minimum(np.searchsorted(part, m.tokens), len(part) - 1)
            hit = part[i] == m.tokens
            x = np.zeros((len(m.ids), len(part)), np.float32)
            x[m.owner[hit], i[hit]] = 1.0
            return x

        total += np.rint(incidence(a) @ incidence(b).T).astype(np.int64)
    return total


def linked(a: Members, b: Members, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of linked classes, as a spanning forest."""
    none = np.zeros(0, np.int64)
    if not same:
        y = b.pick(bounded(b, np.unique(a.tokens)))
        x = a.pick(bounded(a, np.unique(y.tokens))) if y is not None else None
        if x is None or y is None:
            return none, none
        a, b = x, y
    elif len(a.ids) < 2:
        return none, none
    inter = overlaps(a, b)
    i, j = np.nonzero(inter * 100 >= PERCENT * (a.size[:, None] + b.size[None, :] - inter))
    u, v = a.ids[i], b.ids[j]
    apart = u != v
    if not apart.any():
        return none, none
    nodes, low = roots(u[apart], v[apart])
    return nodes[nodes != low], low[nodes != low]


def _open(table: pa.Table) -> pa.Table:
    """A host group, opened, against the classes of its guest groups, and against itself where ``own`` says so: linked classes."""
    none = np.zeros(0, np.int64)
    found = [(none, none)]
    guest, own = np.asarray(table.column("guest")), np.asarray(table.column("own"))
    ids = np.asarray(table.column("d1"))
    sets = [np.frombuffer(x, _U) for x in table.column("tokens").to_pylist()]

    def members(flag: bool) -> Members:
        at = np.flatnonzero(guest == flag)
        at = at[np.unique(ids[at], return_index=True)[1]]
        return Members(ids[at], [sets[i] for i in at])

    if (~guest).any():
        a = members(False)
        if own.any():
            found.append(linked(a, a, True))
        if guest.any():
            found.append(linked(a, members(True), False))
    u, v = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"a": u, "b": v})


def _compare(pairs: DataFrame, groups: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Links ``a, b`` between classes of the group pairs ``g, h``; g = h compares a group with itself.

    The larger group of a pair is the host: its sets are sent once, those of
    every guest are sent to it. A host with many guests is opened in several
    tasks, each with a bounded share of them.
    """
    size = groups.groupBy("group").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("c"))
    both = pairs.join(size.select(F.col("group").alias("g"), F.col("t").alias("tg"), F.col("c").alias("cg")), "g").join(
        size.select(F.col("group").alias("h"), F.col("t").alias("th"), F.col("c").alias("ch")), "h"
    )
    swap = (F.col("tg") < F.col("th")) | ((F.col("tg") == F.col("th")) & (F.col("g") > F.col("h")))
    hosted = materialize(
        both.select(
            F.when(swap, F.col("h")).otherwise(F.col("g")).alias("host"), F.when(swap, F.col("g")).otherwise(F.col("h")).alias("visitor"),
            F.least("tg", "th").alias("t"), F.when(swap, F.col("cg")).otherwise(F.col("ch")).alias("c"),
        ).distinct(),
        name + "-pairs",
    )
    parts = hosted.groupBy("host").agg(F.ceil(F.greatest(F.sum("t") / GUEST_TOKENS, F.sum("c") / GUEST_CLASSES)).alias("parts"))
    dealt = hosted.join(parts, "host").select("host", "visitor", F.pmod(F.xxhash64("visitor"), F.col("parts")).alias("part"))
    opened = dealt.groupBy("host", "part").agg(F.max(F.col("host") == F.col("visitor")).alias("own"))
    rows = opened.select("host", "part", F.col("host").alias("group"), F.lit(False).alias("guest"), "own").union(
        dealt.filter("host <> visitor").select("host", "part", F.col("visitor").alias("group"), F.lit(True), F.lit(False))
    )
    rows = rows.join(groups.select("group", "d1"), "group").join(sets, "d1").select("host", "part", "guest", "own", "d1", "tokens")
    return materialize(rows.groupBy("host", "part").applyInArrow(_open, "a long, b long"), name)


def least_shared(n: Column) -> Column:
    """Prefix shingles that a set of at least ``n`` shares with any it links to."""
    return F.greatest(F.lit(1), F.floor(n / SHARE))


def _grouped(classes: DataFrame, *by: str) -> DataFrame:
    """``classes`` with ``group, lo, hi``: grouped by ``by`` and size class, split where a group would be too large."""
    keyed = classes.withColumn("key", F.xxhash64(F.floor(F.log("n") / F.log(F.lit(1.25))), *by))
    large = (
        keyed.groupBy("key").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("c"))
        .select("key", F.ceil(F.greatest(F.col("t") / GROUP_TOKENS, F.col("c") / GROUP_CLASSES)).alias("splits")).filter("splits > 1")
    )
    part = F.pmod(F.xxhash64("d1", F.lit(3)), F.coalesce("splits", F.lit(1)))
    grouped = keyed.join(large, "key", "left").withColumn("group", F.xxhash64("key", part)).drop("key", "splits")
    range_ = grouped.groupBy("group").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return grouped.join(range_, "group")


def _marks(wanted: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """Marks of the keys in ``wanted``, and whether a row of another table with this key column may be among them."""
    h = F.xxhash64(key)
    word = F.pmod(h, F.lit(MARK_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int"))
    marks = wanted.select(word.alias("word_"), bit.alias("bit_")).groupBy("word_").agg(F.bit_or("bit_").alias("bits_"))
    return F.broadcast(marks), (word == F.col("word_")) & (bit.bitwiseAND(F.col("bits_")) != 0)


def marked(texts: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``texts`` whose key may be in ``wanted``, before a join that would move all of them.

    The marks are one bit per hash slot in at most ``MARK_WORDS`` rows, whatever
    the tables hold, so they are broadcast; with more keys than slots more rows
    pass, and none that is wanted is lost.
    """
    return texts.join(*_marks(wanted, key), "left_semi")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``gone``; those without a mark stay where they are, and only the rest is joined."""
    marks, may_be = _marks(gone, key)
    rest = marked(rows, gone, key).join(gone.select(F.col(key).alias("gone_")).distinct(), F.col(key) == F.col("gone_"), "left_anti")
    return rows.join(marks, may_be, "left_anti").union(rest)


def _enough(pairs: DataFrame) -> DataFrame:
    """Group pairs ``g, h`` of a row per shared shingle that share enough of them."""
    return pairs.groupBy("g", "h").agg(F.count(F.lit(1)).alias("c"), F.min("need").alias("need")).filter("c >= need").select("g", "h")


def join_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``doc_id, text``.

    Two texts link when 100 times their shared shingles are at least 80 times
    the shingles of both. The component is the smallest ``doc_id`` reachable by
    links. Rows of equal sets belong together; rows of one id are one node. A
    null, empty or blank text has no shingles and links with nothing; a null id
    links with nothing and has no component. No candidate, group or frequency
    is capped in a way that could lose a link; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = materialize(
        texts.mapInArrow(_sets, "doc_id long, n long, d1 long, d2 long, low long, token long, count long"), "ngram-sets"
    )
    rows = scanned.filter("token is null").select("doc_id", "n", "d1", "d2", "low")
    frequent = (
        scanned.filter("token is not null").groupBy("token").agg(F.sum("count").alias("count"))
        .orderBy(F.col("count").desc(), "token").limit(MAX_FREQUENT).collect()
    )
    order = np.array([r["token"] for r in frequent], np.int64).view(_U)
    by_token = np.argsort(order)
    held = spark.sparkContext.broadcast((order[by_token], (len(order) - by_token).astype(np.int64)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        frequent, rank = held.value
        for batch in pieces(batches):
            data, offsets = raw_bytes(batch.column("text"))
            known = np.asarray(batch.column("doc_id").is_valid())
            tokens, owners = [], []
            for s, valid in zip(shingle_sets(data, offsets, hasher), known, strict=True):
                if not len(s) or not valid:
                    continue
                d = digest(s)
                if d in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(d)
                p = prefix(s, frequent, rank)
                tokens.append(p)
                owners.append(np.full(len(p), d[0], np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners))], names=["token", "d1"]
                )

    shared = materialize(
        texts.mapInArrow(prefixes, "token long, d1 long").repartition("token").sortWithinPartitions("token", "d1")
        .mapInArrow(shared_tokens, "token long, d1 long, hub long"),
        "ngram-shared",
    )
    classes = materialize(
        rows.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("low").alias("low")),
        "ngram-classes",
    )
    # a partner has four fifths of the size at least
    own_share = shared.groupBy("d1").agg(F.count(F.lit(1)).alias("c"))
    candidates = materialize(
        classes.join(own_share, "d1").filter(F.col("c") >= least_shared(F.ceil(F.col("n") * PERCENT / 100))).drop("c"), "ngram-candidates"
    )

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in pieces(batches):
            data, offsets = raw_bytes(batch.column("text"))
            want1, want2 = (batch.column(k).to_pylist() for k in ("d1", "d2"))
            out = [(a, s.tobytes(), commonest(s, *held.value)) for s, a, b in zip(shingle_sets(data, offsets, hasher), want1, want2, strict=True) if digest(s) == (a, b)]
            columns = zip(("d1", "tokens", "common"), (pa.int64(), pa.binary(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in out], t) for k, (_, t) in enumerate(columns)], names=["d1", "tokens", "common"])

    wanted = candidates.select(F.col("rep").alias("doc_id"), "d1", "d2")
    sets = materialize(
        marked(texts, wanted, "doc_id").join(wanted.hint("merge"), "doc_id").mapInArrow(full, "d1 long, tokens binary, common long"), "ngram-full"
    )

    # first round: groups of one min-hash each with itself, and every class with the first class of its tokens
    groups = _grouped(candidates, "low").select("group", "d1", "n")
    every = materialize(groups.union(candidates.select(F.col("d1").alias("group"), "d1", "n")), "ngram-groups")
    own = every.groupBy("group").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("group").alias("g"), F.col("group").alias("h"))
    star = shared.filter("d1 <> hub").groupBy("hub", "d1").agg(F.count(F.lit(1)).alias("c"))
    star = star.join(candidates.select("d1", "n"), "d1").join(candidates.select(F.col("d1").alias("hub"), F.col("n").alias("m")), "hub")
    star = star.filter(
        (F.col("n") * 100 >= F.col("m") * PERCENT) & (F.col("m") * 100 >= F.col("n") * PERCENT) & (F.col("c") >= least_shared(F.least("n", "m")))
    ).select(F.col("hub").alias("g"), F.col("d1").alias("h"))
    links = _compare(own.union(star), every, sets, "ngram-links")
    connected = components(links)

    # second round: linked classes by component, the others by their commonest shingle; tokens join what may not be connected
    of = candidates.join(connected, candidates["d1"] == connected["node"], "left").join(sets.groupBy("d1").agg(F.max("common").alias("common")), "d1", "left").select(candidates["*"], "component", "common")
    of = of.withColumn("alone", F.col("component").isNull()).withColumn("by", F.coalesce("component", "common", "low")).drop("common")
    groups2 = materialize(_grouped(of, "alone", "by").withColumn("component", F.coalesce("component", "group")), "ngram-groups")
    again = groups2.filter("alone").groupBy("group").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("group").alias("g"), F.col("group").alias("h"))
    cells = shared.join(groups2.select("d1", "group", "component", "lo", "hi"), "d1").select("token", "group", "component", "lo", "hi").distinct()
    mixed = cells.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("token")
    cells = materialize(cells.join(mixed, "token"), "ngram-matrix")
    left, right = cells.alias("l"), cells.alias("r")
    apart = left.join(
        right,
        (F.col("l.token") == F.col("r.token")) & (F.col("l.group") < F.col("r.group")) & (F.col("l.component") != F.col("r.component"))
        & (F.col("l.hi") * 100 >= F.col("r.lo") * PERCENT) & (F.col("r.hi") * 100 >= F.col("l.lo") * PERCENT),
    ).select(F.col("l.group").alias("g"), F.col("r.group").alias("h"), least_shared(F.least("l.lo", "r.lo")).alias("need"))
    apart = again.union(_enough(apart))
    later = _compare(apart, groups2, sets, "ngram-links")

    # links between classes as links between documents, and ids of several rows
    rep = classes.select("d1", "d2", "rep")
    links = connected.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(later)
    ids = candidates.select("d1", "rep")
    edges = links.join(ids.select(F.col("d1").alias("a"), F.col("rep").alias("x")), "a").join(ids.select(F.col("d1").alias("b"), F.col("rep").alias("y")), "b").select(
        F.col("x").alias("a"), F.col("y").alias("b")
    )
    several = rows.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count_distinct("d1", "d2").alias("c")).filter("c > 1").select("doc_id")
    same_id = rows.filter("n > 0").join(several, "doc_id").join(rep, ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(edges.union(same_id).filter("a <> b"))
    return (
        rows.join(rep, ["d1", "d2"], "left")
        .join(final, F.col("rep") == F.col("node"), "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.when(F.col("n") > 0, F.col("rep")), F.col("doc_id"))).alias("component_id"),
        )
    )
