"""Streaming deduplication, the Merkle manifest and hard-negative mining against plain versions."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echoframe.llm import hard_negatives, merkle, queries, stream_dedup


def key(row):
    return tuple((x is None, str(x)) for x in row)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


# ---------------------------------------------------------------- streaming deduplication

BLANK = re.compile(r"[\x20\x09-\x0D]")


def deduplicated(docs):
    """Per row doc_id, keep_id, group_size, text_sha256, and the rows kept: one of each group, of the id that stays."""
    groups = {}
    for i, t in docs:
        groups.setdefault(BLANK.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    first = {n: (min(g)[3], len(g)) for n, g in groups.items()}
    every = [(i, *first[n], hashlib.sha256(n.encode()).hexdigest()) for i, t in docs for n in [BLANK.sub("", t or "")]]
    return sorted(every, key=key), sorted(((k, s) for k, s in first.values()), key=key)


def answer(df):
    got = df.collect()
    every = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key)
    return every, sorted(((r["doc_id"], r["group_size"]) for r in got if r["kept"]), key=key)


def test_dedup_on_tables(spark, sf, tables):
    want = deduplicated([(r["doc_id"], r["text"]) for r in tables("documents").collect()])
    assert answer(queries.op11_stream_dedup(spark, sf)) == want
    assert len(want[1]) < len(want[0])


def test_dedup_edges_and_later_files(spark, edge_docs, no_docs, tmp_path):
    path, state = str(tmp_path / "docs.parquet"), str(tmp_path / "state")
    first = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    edge_docs.repartition(3).write.parquet(path)
    assert answer(stream_dedup.deduplicate(spark, path, state)) == deduplicated(first)
    # copies that come later, one of them longer by blanks; the state does not take earlier files twice
    more = [(0, "one two three four  five six seven eight nine ten eleven twelve"), (90, " x" * 3000), (91, "new"), (92, "\n")]
    spark.createDataFrame(more, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    assert answer(stream_dedup.deduplicate(spark, path, state)) == deduplicated(first + more)
    again = stream_dedup.deduplicate(spark, path, state)  # nothing new
    assert answer(again) == deduplicated(first + more)
    assert not re.search("Python|Arrow|Pandas|MapIn", again._jdf.queryExecution().toString())
    empty = str(tmp_path / "none.parquet")
    no_docs.write.parquet(empty)
    assert stream_dedup.deduplicate(spark, empty, str(tmp_path / "none-state")).collect() == []


def test_dedup_compares_whole_texts_of_equal_digests(spark, tmp_path):
    docs = [(k, f"text {k % 23}" + " " * (k % 5)) for k in range(120)]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(path)
    weak = lambda normal: F.substring(F.sha2(normal, 256), 1, 1)
    assert answer(stream_dedup.deduplicate(spark, path, str(tmp_path / "state"), weak)) == deduplicated(docs)


# ---------------------------------------------------------------- Merkle manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lowered(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def tree(digests):
    """Root and, per leaf, its siblings by level: those before and those behind it."""
    paths, level, place = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for leaf, p in enumerate(place):
            run = level[p // 16 * 16 : p // 16 * 16 + 16]
            paths[leaf].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        level = [h(*level[k : k + 16]) for k in range(0, len(level), 16)]
        place = [p // 16 for p in place]
    return level[0], paths


def manifest(docs):
    by = {}
    for r in docs:
        leaf = h(*(framed(v) for v in r))
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf, h(*(framed(v) for v in (*r[:4], lowered(r[4])))) if changed else leaf, r[0]))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in order}
    root, over = tree([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for x, own in zip(sorted(by[s]), trees[s][1], strict=True):
            path, fold = own + over[k], x[3]
            for a, b in path:
                fold = h(a, fold, b)
            out.append((x[4], x[2], trees[s][0], root, h(*(p for both in path for p in both)), fold, fold == root))
    return sorted(out, key=key)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12(docs):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda t: merkle.leaf_digest(*(F.col(c) for c in COLUMNS[:4]), t)
    return merkle.manifest_proofs(docs, claim=F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(lower)).otherwise(leaf(F.col("text"))))


def plain(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_manifest_on_tables(spark, sf, tables):
    want = manifest(plain(tables("documents")))
    assert rows(queries.op12_merkle(spark, sf)) == want
    assert {v for *_, v in want} == {True, False}


def test_manifest_edges(edge_docs, no_docs):
    assert rows(op12(edge_docs)) == manifest(plain(edge_docs))
    assert rows(op12(no_docs)) == []
    assert rows(op12(edge_docs.limit(1))) == manifest(plain(edge_docs.limit(1)))


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_of_many_rounds(spark, monkeypatch, levels):
    """Sources of all sizes around whole runs and builders, more sources than a run, equal rows, a hot source."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SPAN", merkle.BITS * levels)
    docs = []
    for s, n in enumerate((1, 2, 15, 16, 17, 255, 256, 257, 600)):
        docs += [(len(docs) + k, f"s{s}", "en", k, f"Text {k}") for k in range(n)]
    docs += [(9000 + s, f"é{s}" if s % 2 else f"Z{s}", None, None, "X") for s in range(20)] + [(7, None, "en", 1, None)] + [(8, "s0", "en", 1, "Same")] * 40
    frame = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert rows(op12(frame)) == manifest(docs)


@given(st.integers(1, 5000))
@settings(max_examples=60, deadline=None)
def test_postorder_places(n):
    """All places once; a node follows its last child at once, unless the edge cut it off; builders' nodes lie together."""
    place = {(lv, k): int(p) for lv in range(merkle.height(n) + 1) for k, p in enumerate(merkle.postorder(lv, np.arange(merkle.nodes_at(lv, n)), n))}
    assert sorted(place.values()) == list(range(len(place)))
    for (lv, k), p in place.items():
        if lv:
            last = min(16 * k + 15, merkle.nodes_at(lv - 1, n) - 1)
            assert place[lv - 1, last] < p
            if (k + 1) << (4 * lv) <= n:
                assert place[lv - 1, last] == p - 1


def test_log_is_in_postorder(spark, tmp_path):
    docs = spark.createDataFrame([(k, "a", "en", k, f"t{k}") for k in range(300)], "doc_id long, source string, lang string, n_chars long, text string")
    built = merkle.build(docs, str(tmp_path / "m"))
    log = sorted((r["pos"], r["level"], r["idx"]) for r in built.sources.nodes.collect())
    assert [p for p, _, _ in log] == list(range(300 + 19 + 2 + 1))
    assert [(lv, k) for _, lv, k in log[:18]] == [(0, k) for k in range(16)] + [(1, 0), (0, 16)]
    assert all(r["verified"] for r in merkle.proofs(built).collect())


# ---------------------------------------------------------------- hard negatives

def mined(table, anchor, positives=5, negatives=3):
    ok = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in table
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, y, v) in enumerate(ok):
        if not anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, z) for m, (i, z, w) in enumerate(ok) if m != n and len(w) == len(v))
        for s, i, z in [r for r in scored if r[2] == y][:positives]:
            inside = [(t, j) for t, j, z2 in scored if z2 != y and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(inside)]
    return sorted(out, key=key)


SCHEMA = "id long, label long, vector array<double>, score string, rank string, key string"


def frame(spark, table, parts=4):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in table], SCHEMA).repartition(parts)


def every(n):
    return F.col("id") % n == 0, lambda i: i % n == 0


def test_mining_on_tables(spark, sf, tables):
    table = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in tables("embeddings").collect()]
    assert rows(queries.op13_hard_negatives(spark, sf)) == mined(table, lambda i: i % 50 == 0)


@pytest.mark.parametrize("pass_bytes", [32 << 20, 400])
def test_mining_edges(spark, monkeypatch, pass_bytes):
    """Ties, zero and negative scores, null and non-finite parts, repeated ids, other lengths, a vector that a third of the rows have."""
    monkeypatch.setattr(hard_negatives, "CELLS", 64)
    rng = np.random.default_rng(5)
    table = [(k, int(rng.integers(0, 3)), [float(x) for x in rng.integers(-3, 4, 4) / 4]) for k in range(150)]
    table += [(1000 + k, k % 2, [0.5, 0.25, 0.5, 0.25]) for k in range(80)]
    table += [(0, 1, [0.5, 0.5, 0.5, 0.5]), (10, 2, [0.0] * 4), (20, 1, [-0.5] * 4), (-10, 0, [0.5, 0.5, 0.0, 0.0])]
    table += [(None, 1, [1.0] * 4), (30, None, [1.0] * 4), (40, 1, None), (50, 1, [1.0, None, 1.0, 1.0]), (60, 1, [math.nan] * 4), (70, 1, [math.inf, 0.0, 0.0, 0.0])]
    table += [(80, 1, []), (82, 2, []), (83, 1, []), (90, 1, [1.0, 1.0]), (91, 1, [1.0, 0.5]), (92, 2, [0.5, 0.5])]
    query, test = every(10)
    assert rows(hard_negatives.mine(frame(spark, table), query, pass_bytes=pass_bytes)) == mined(table, test)


def test_mining_without_rows(spark):
    query, _ = every(10)
    assert hard_negatives.mine(frame(spark, []), query).collect() == []
    assert hard_negatives.mine(frame(spark, [(1, 1, [1.0])]), query).collect() == []
    assert hard_negatives.mine(frame(spark, [(10, 1, [1.0])]), query).collect() == []


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-9, 9), st.integers(0, 1), st.integers(-5, 5)), max_size=30))
@settings(max_examples=100, deadline=None)
def test_packed_keys_sort_by_anchor_falling_score_kind_and_id(table):
    a, s, k, i = np.array(table, np.int64).reshape(-1, 4).T
    keys = hard_negatives.pack(a, s, k.astype(np.uint8), i, np.zeros(len(a), np.int64)).to_pylist()
    order = sorted(range(len(keys)), key=lambda n: keys[n])
    assert [table[n] for n in order] == sorted(table, key=lambda r: (r[0], -r[1], r[2], r[3]))
    back = np.frombuffer(b"".join(keys), hard_negatives._KEY)
    assert [x.tolist() for x in hard_negatives.scores_of(back)] == [s.tolist(), i.tolist()]
