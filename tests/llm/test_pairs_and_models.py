"""Joins, near-duplicates, components and classifiers against brute force, and the pipeline."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from echoframe.llm import embedding_dedup, ngram_join, quality, toxicity
from echoframe.llm.components import components, roots


def key(row):
    return tuple((x is None, str(x)) for x in row)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def closure(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---------------------------------------------------------------- components

@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
@settings(max_examples=100, deadline=None)
def test_roots(edges):
    a, b = np.array(edges).T
    nodes, low = roots(a, b)
    assert dict(zip(nodes.tolist(), low.tolist())) == closure({int(x) for e in edges for x in e}, edges)


def test_components_of_chain_star_and_cycle(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(500, 700)] + [(900, 901), (901, 902), (902, 900), (5, 5), (3, None)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect())
    real = [e for e in edges if e[1] is not None and e[0] != e[1]]
    assert got == closure({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---------------------------------------------------------------- n-gram join

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def joined(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    nodes = {i for i, _ in sets if i is not None}
    where = {}
    for k, (i, s) in enumerate(sets):
        for x in s if i is not None else ():
            where.setdefault(x, []).append(k)
    edges, seen = [], set()
    for ks in where.values():
        for n, a in enumerate(ks):
            for b in ks[n + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    x, y = sets[a][1], sets[b][1]
                    if 100 * len(x & y) >= 80 * len(x | y):
                        edges.append((sets[a][0], sets[b][0]))
    root = closure(nodes, edges)
    return sorted(((i, len(s), None if i is None else root[i]) for i, s in sets), key=key)


def test_join_on_tables(tables):
    docs = tables("documents")
    want = joined([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows(ngram_join.join_documents(docs)) == want
    assert any(i != c for i, _, c in want)


def test_join_edges(edge_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert rows(ngram_join.join_documents(edge_docs)) == joined(docs)
    assert rows(ngram_join.join_documents(no_docs)) == []


@pytest.mark.parametrize("tokens, classes", [(32_768, 256), (300, 3)])
def test_join_near_copies_chains_and_borders(spark, monkeypatch, tokens, classes):
    """Large groups of near copies, exactly 80 percent, chains that only link step by step, shared passages."""
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", tokens)
    monkeypatch.setattr(ngram_join, "GROUP_CLASSES", classes)
    base = [f"b{k}" for k in range(60)]
    rng = np.random.default_rng(3)
    docs = []
    for k in range(80):
        w = list(base)
        for at in rng.choice(60, rng.integers(0, 3), replace=False):
            w[at] = f"m{k}x{at}"
        docs.append((len(docs), " ".join(w)))
    docs += [(len(docs) + k, " ".join(f"c{j}" for j in range(4 * k, 4 * k + 60))) for k in range(30)]
    passage = " ".join(f"p{k}" for k in range(55))
    docs += [(1000 + k, passage + " " + " ".join(f"q{k}x{j}" for j in range(rng.integers(0, 60)))) for k in range(40)]
    docs += [(2000, " ".join(f"e{k}" for k in range(13))), (2001, " ".join(f"e{k}" for k in range(12))), (2002, " ".join(f"e{k}" for k in range(11)))]
    docs += [(3000 + k, "tiny text") for k in range(5)] + [(3100, "a b c d"), (3101, "A B C D")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert rows(ngram_join.join_documents(frame)) == joined(docs)


@pytest.mark.parametrize("tokens, classes", [(2_000, 256), (32_768, 8)])
def test_join_links_inside_groups_that_host_others(spark, monkeypatch, tokens, classes):
    """Variants of a template that share passages, each with a near copy: one min-hash, split in other parts in the second round."""
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", tokens)
    monkeypatch.setattr(ngram_join, "GROUP_CLASSES", classes)
    rng = np.random.default_rng(0)
    docs = []
    for k in range(60):
        w = [f"t{j}" for j in range(60)] + [f"p{p}x{j}" for p in rng.choice(20, 8, replace=False) for j in range(10)]
        docs.append((len(docs), " ".join(w)))
        for at in rng.choice(70, 2, replace=False) + 65:
            w[at] = f"m{k}x{at}"
        docs.append((len(docs), " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert rows(ngram_join.join_documents(frame)) == joined(docs)


def test_structured_words_make_different_shingles():
    one, other = "a", "b"
    while len(one) < 2048:
        one, other = one + other, other + one
    data = f"{one}{other}".encode()
    a, b = ngram_join.shingle_sets(np.frombuffer(data, np.uint8), np.array([0, len(one), len(data)]), ngram_join.WordHasher())
    assert a.tolist() != b.tolist()


@pytest.mark.parametrize("classes", [256, 20])
def test_many_variants_of_one_passage_meet_in_few_pairs(spark, monkeypatch, classes):
    """Documents that are mostly one passage but not linked to each other: few groups hold its shingles, and no link is lost."""
    monkeypatch.setattr(ngram_join, "GROUP_CLASSES", classes)
    monkeypatch.setattr(ngram_join, "GUEST_CLASSES", 50)
    monkeypatch.setattr(ngram_join, "LOCAL_MIN", 2)
    seen = []
    real = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    rng = np.random.default_rng(4)
    passage = [f"p{k}" for k in range(60)]
    docs = []
    for k in range(300):  # five changed words take 25 of 56 shingles: similarity about a half; some with a near copy
        w = list(passage)
        for at in rng.choice(60, 3, replace=False):
            w[at] = f"m{k}x{at}"
        docs.append((len(docs), " ".join(w)))
        if k % 10 == 0:
            w[0] = f"n{k}"
            docs.append((len(docs), " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(ngram_join.join_documents(frame)) == joined(docs)
    cells = [df for name, df in seen if name == "ngram-matrix"][0]
    groups = max((r["count"] for r in cells.groupBy("token").count().collect()), default=0)
    assert groups <= 50  # of 330 classes


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), max_size=40), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_shared_tokens_streams(pairs, size):
    pairs = sorted(pairs)
    batches = [pa.RecordBatch.from_arrays([pa.array([t for t, _ in p], pa.int64()), pa.array([c for _, c in p], pa.int64())], names=["t", "c"])
               for p in (pairs[k : k + size] for k in range(0, len(pairs), size))]
    got = [row for b in ngram_join.shared_tokens(iter(batches)) for row in zip(*(b.column(k).to_pylist() for k in range(3)))]
    of = {}
    for t, c in pairs:
        of.setdefault(t, set()).add(c)
    assert sorted(got) == sorted((t, c, min(cs)) for t, cs in of.items() if len(cs) > 1 for c in cs)


def test_marks_lose_nothing_that_is_wanted(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MARK_WORDS", 64)
    every = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    wanted = every.filter("doc_id % 97 = 0").select("doc_id")
    passed = ngram_join.marked(every, wanted, "doc_id")
    assert passed.join(wanted, "doc_id").count() == wanted.count()
    assert passed.count() < 5_000


# ---------------------------------------------------------------- embeddings

def neighbours(vectors):
    ok = [(k, np.array(v, float)) for k, (i, v) in enumerate(vectors) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, edges = [0] * len(vectors), []
    for n, (a, x) in enumerate(ok):
        for b, y in ok[n + 1 :]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links[a] += 1
                links[b] += 1
                edges.append((vectors[a][0], vectors[b][0]))
    root = closure({i for i, _ in vectors if i is not None}, edges)
    return sorted(((i, links[k], root.get(i), i is not None and root[i] == i) for k, (i, _) in enumerate(vectors)), key=key)


@pytest.mark.parametrize("block", [8192, 100])
def test_embeddings_on_tables(tables, block):
    vectors = [(r["vec_id"], r["embedding"]) for r in tables("embeddings").collect()]
    want = neighbours(vectors)
    assert rows(embedding_dedup.near_duplicates(tables("embeddings"), block)) == want


def test_embedding_edges(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    vectors = [(k, [float(x) for x in base * (k + 1) + rng.normal(size=8) * 0.3]) for k in range(40)]
    vectors += [(100, None), (101, []), (102, [0.0] * 8), (103, [float("nan")] * 8), (104, [float("inf")] + [0.0] * 7), (105, [None] + [1.0] * 7), (None, vectors[0][1])]
    vectors += [(200 + k, vectors[3][1]) for k in range(6)] + [(300, [1.0, 0.0]), (301, [2.0, 0.1]), (302, [1e30, 0.0]), (303, [1e-30, 0.0]), (304, [-1.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in vectors], "vec_id long, embedding array<float>, rep long, n string")
    got = rows(embedding_dedup.near_duplicates(frame, 16))
    stored = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    assert got == neighbours(stored) and any(r[1] for r in got)
    assert rows(embedding_dedup.near_duplicates(frame.limit(0))) == []


@given(st.integers(0, 2**32 - 1))
@settings(max_examples=30, deadline=None)
def test_quantisation_bound_holds(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(20, 16)) * rng.choice([1e-6, 1.0, 1e6], (20, 1))
    t = embedding_dedup.Tile(np.arange(20), np.ones(20, int), x)
    approx = (t.codes.astype(int) @ t.codes.astype(int).T) * t.scale[:, None] * t.scale
    bound = t.reach[:, None] * t.lost + t.reach * t.lost[:, None] + t.lost[:, None] * t.lost
    assert (np.abs(t.unit @ t.unit.T - approx) <= bound + 1e-12).all()


# ---------------------------------------------------------------- classifiers

def is_held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


MASK = (1 << 64) - 1


def plain_mix(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & MASK
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def plain_quality(text, weights, settings=quality.Settings()):
    """The sparse dot product word by word, with whole numbers and a dictionary."""
    hasher = ngram_join.WordHasher()
    words = re.findall(rb"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode())
    hashes, shapes, before = [], [], None
    for w in words:
        hashes.append(int(hasher(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]))
        letter = lambda c: 0x61 <= c <= 0x7A or 0x41 <= c <= 0x5A or c >= 0x80
        letters, digits = sum(map(letter, w)), sum(0x30 <= c <= 0x39 for c in w)
        shape = min(int(math.log2(len(w) + 1)), 7)
        for part in (min(letters, 3), min(digits, 3), min(len(w) - letters - digits, 4), 0 if letter(w[-1]) else w[-1], int(w == before)):
            shape = shape * 257 + part
        shapes.append(plain_mix(shape + 0x51ED270B & MASK))
        before = w
    counts = {}
    pairs = lambda x: [a * 0x9E3779B1 + b & MASK for a, b in zip(x, x[1:])]
    for k, grams in enumerate((hashes, shapes, pairs(hashes), pairs(shapes))):
        for g in grams:
            i = plain_mix(g + k + 1 & MASK) >> 64 - settings.bits
            counts[i] = counts.get(i, 0) + 1
    dot = sum(weights[i] * n for i, n in counts.items()) * settings.scale / max(1, len(words)) + weights[-1]
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, dot))))


def test_quality_equals_the_plain_product(tables, edge_docs):
    weights = quality.train(tables("documents"), tables("labels"))
    for docs in (tables("documents"), edge_docs.filter("length(text) < 5000 or text is null")):
        want = sorted((str(r["doc_id"]), plain_quality(r["text"], weights)) for r in docs.collect())
        got = sorted((str(r["doc_id"]), r["score"]) for r in quality.score(docs, weights).collect())
        assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-9)


def test_ftrl_equals_the_plain_update():
    """Follow the regularised leader, one coordinate at a time."""
    s = quality.Settings(bits=3, l1=0.02)
    rng = np.random.default_rng(0)
    data = [(np.append(np.sort(rng.choice(8, 3, replace=False)), 8), np.append(rng.random(3) * 3, 1.0), int(rng.random() < 0.4)) for _ in range(60)]
    z, n = [0.0] * 9, [0.0] * 9

    def weight(i):
        return 0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for index, x, y in data:
            w = [weight(i) for i in index]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
            for i, a, v in zip(index, w, x):
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * a
                n[i] += g * g
    assert np.allclose(quality.ftrl(data, s), [weight(i) for i in range(9)])


def test_quality_on_held_out_rows(tables):
    docs, labels = tables("documents"), tables("labels")
    out = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").toPandas()
    assert all(out["held_out"] == [is_held(i) for i in out["doc_id"]])
    assert ((out["score"] >= 0.3) == (out["predicted"] == 1)).all() and out["score"].between(0, 1).all()
    assert (out["predicted"] == out["quality"]).mean() >= 0.95


def test_scores_ignore_held_out_labels_and_row_columns(spark, tables):
    docs, labels = tables("documents"), tables("labels")
    held = quality.held_out(labels["doc_id"])
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs.withColumn("lang", F.lit("xx")), flipped)
    assert np.array_equal(a, b)
    # a score is a function of the text alone
    same = spark.createDataFrame([(1, "so it is"), (None, "so it is"), (999, "so it is")], "doc_id long, text string")
    assert len({r["score"] for r in quality.score(same, a).collect()}) == 1


def test_classifier_edges(spark, edge_docs, no_docs, tables):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 1), (None, 1, 1), (7, None, None), (8, 1, 7), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for module, fit in ((quality, quality.train), (toxicity, toxicity.learn_lexicon)):
        for known in (labels, labels.limit(0)):
            model = fit(edge_docs, known)
            out = module.score(edge_docs, model).collect()
            assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out if r["doc_id"]) == sorted((r["doc_id"] is None, r["doc_id"]) for r in edge_docs.collect() if r["doc_id"])
            assert len(out) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in out)
            assert all(r["held_out"] == is_held(r["doc_id"]) for r in out)
            assert module.score(no_docs, model).collect() == []


def test_ftrl_separates():
    s = quality.Settings(bits=4)
    data = [(np.array([k % 2, 16]), np.array([1.0, 1.0]), k % 2) for k in range(200)]
    w = quality.ftrl(data, s)
    assert w[1] > 0 > w[0]


def edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=6, unique=True), st.text("abc", max_size=8), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_levenshtein_automaton(words, asked, stem):
    terms = [toxicity.Term(w, False, 0.9, 0.5) for w in words] + [toxicity.Term(words[0][:stem], True, 0.7, 0.0)]
    want = max([0.9 if edit_distance(w, asked) == 0 else 0.5 if edit_distance(w, asked) == 1 else 0.0 for w in words] + [0.7 if asked.startswith(words[0][:stem]) else 0.0])
    automaton = toxicity.LexiconAutomaton(terms)
    assert automaton.chance(asked) == want and automaton.chance(asked) == want


LETTERS = re.compile(r"[^\W\d_]+")


def one_edit(a, b):
    """Whether two different words are one letter apart: all but one letter are a common beginning and a common end."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, same = min(len(a), len(b)), 0
    while same < short and a[same] == b[same]:
        same += 1
    return a[same + 1 :] == b[same + 1 :] or a[same:] == b[same + 1 :] or a[same + 1 :] == b[same:]


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_one_edit(a, b):
    assert a == b or one_edit(a, b) == (edit_distance(a, b) == 1)


def plain_toxicity(text, terms, known):
    """Every word against every term by edit distance; context by splitting; all words that hit count as independent. ``known`` are words judged before."""
    low, best, n = (text or "").lower(), {}, 0
    for m in LETTERS.finditer(low):
        w = m.group()
        if w not in known:
            known[w] = max([0.0] + [
                t.exact if (w.startswith(t.text) if t.stem else w == t.text)
                else t.fuzzy if not t.stem and t.fuzzy and one_edit(t.text, w) else 0.0 for t in terms
            ] + [t.fuzzy for t in terms if not t.stem and w == t.text])
        p = known[w]
        if not p:
            continue
        n += 1
        left, right = low[max(0, m.start() - 80) : m.start()], low[m.end() : m.end() + 80]
        opens = [c for c in left if c in "\"“”„«»‹›‘’"]
        closes = [c for c in right if c in "\"“”„«»‹›‘’"]
        quoted = bool(opens) and opens[-1] in "\"“„«‹‘" and bool(closes) and closes[0] in "\"”“»›’"
        told = bool(toxicity.REPORTING & set(LETTERS.findall(left)[-6:]))
        best[w] = max(best.get(w, 0.0), p * (toxicity.QUOTED if quoted else 1.0) * (toxicity.REPORTED if told else 1.0))
    return (1 - (1 - toxicity.BASE) * math.prod(1 - p for p in best.values()), n) if n else (toxicity.BASE, 0)


def test_toxicity_equals_the_plain_score(tables, edge_docs):
    terms = toxicity.learn_lexicon(tables("documents"), tables("labels"))
    terms += [toxicity.Term("villain", False, 0.95, 0.6), toxicity.Term("rasc", True, 0.8, 0.0), toxicity.Term("scoundrel", False, 0.5, 0.9)]
    texts = ["a villain, villan and vilains", 'he said "rascal" and wrote: villain', "„Rascals“ scoundrl scoundrel", "rasc", "Ein Schuft"]
    frame = tables("documents").select("doc_id", "text").union(edge_docs.select("doc_id", "text").filter("length(text) < 5000 or text is null"))
    frame = frame.union(frame.sparkSession.createDataFrame([(10**6 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    known = {}
    want = sorted((str(r["doc_id"]), round(s, 9), n) for r in frame.collect() for s, n in [plain_toxicity(r["text"], terms, known)])
    got = sorted((str(r["doc_id"]), round(r["score"], 9), r["n_hits"]) for r in toxicity.score(frame, terms).collect())
    assert got == want
    assert any(n for *_, n in want)


def test_the_lexicon_has_no_ceiling(spark):
    """All terms that pass are taken: many words, each of some toxic rows."""
    rng = np.random.default_rng(3)
    word = lambda k: "q" + "".join(chr(97 + int(d)) for d in f"{k:05d}") + "x"
    docs = [(k, " ".join(word(int(j)) for j in rng.choice(40, 8, replace=False)) + f" u{k}") for k in range(300)]
    docs += [(k, " ".join("".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(8))) for k in range(300, 900)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame([(k, 1, int(k < 300)) for k in range(900)], "doc_id long, quality int, toxic int")
    assert {word(k) for k in range(40)} <= {t.text for t in toxicity.learn_lexicon(d, y)}


def test_quotation_lowers_the_score():
    scorer = toxicity.Scorer([toxicity.Term("villain", False, 0.95, 0.6)])
    meant, quoted, told, typo = (scorer(t)[0] for t in ("you are a villain", 'it reads "such a villain here" in print', "they wrote that villain", "you vilain"))
    assert meant > 0.9 > 0.6 > told > quoted > toxicity.BASE and meant > typo > 0.5
    assert scorer("") == (toxicity.BASE, 0) and scorer("nothing here")[0] == toxicity.BASE


def test_lexicon_is_learned_from_varied_texts(spark):
    """A word of many different toxic rows is learned, a word of one copied text is not."""
    rng = np.random.default_rng(1)
    filler = lambda: " ".join("".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(12))
    copied = filler()
    docs = [(k, filler() + " blorgish") for k in range(60)] + [(k, copied + " zzcopyz") for k in range(60, 100)] + [(k, filler()) for k in range(100, 500)]
    labels = [(k, 1, int(k < 100)) for k in range(500)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    terms = {t.text for t in toxicity.learn_lexicon(d, y)}
    assert "blorgish" in terms and "zzcopyz" not in terms
    new = spark.createDataFrame([(1, "a BLORGISH thing"), (2, "blorgsh thing"), (3, copied)], "doc_id long, text string")
    score = {r["doc_id"]: r["predicted"] for r in toxicity.score(new, toxicity.learn_lexicon(d, y)).collect()}
    assert score == {1: 1, 2: 1, 3: 0}


def test_lexicon_counts_both_labels_in_one_unit(spark):
    """A term of many toxic rows stays in the lexicon when some clean rows quote it; copies on either side count once."""
    rng = np.random.default_rng(2)
    filler = lambda: " ".join("".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(8))
    copied = filler()
    texts = [filler() + " blorgish" for _ in range(700)] + [filler() + " blorgish" for _ in range(80)] + [filler() for _ in range(1500)]
    toxic = [1] * 700 + [0] * 1580
    texts += [filler() + " quuxish" for _ in range(30)] + [copied + " quuxish"] * 90 + [copied + " zzcopyz"] * 90
    toxic += [1] * 30 + [0] * 90 + [1] * 90
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    y = spark.createDataFrame([(k, 1, t) for k, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    chance = {t.text: t.exact for t in toxicity.learn_lexicon(d, y) if not t.stem}
    assert 0.8 < chance["blorgish"] < 0.95 and chance["quuxish"] > 0.7 and "zzcopyz" not in chance


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, sf, tables):
    docs = tables("documents")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from echoframe.session import materialize
        kept = materialize(stage(spark, docs, sf), f"test-{name}")
        assert kept.columns == columns
        assert kept.exceptAll(docs).count() == 0
        docs = kept
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[0] > seen[1] > seen[3]
    from echoframe.llm.ngram_join import join_documents
    assert join_documents(docs).filter("doc_id <> component_id").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == seen[-1]
    assert rows(corpus_pipeline.run(spark, sf)) == rows(last)


def test_pipeline_stages_against_plain_versions(spark, sf, tables, monkeypatch):
    """Every stage, on documents and template variants, keeps the ids that plain Python keeps."""
    from test_text_operators import Reference, bpe_row, contaminated, queries
    from echoframe.session import materialize
    monkeypatch.setattr(ngram_join, "GROUP_CLASSES", 8)
    rng = np.random.default_rng(0)
    docs = [(r["doc_id"], r["text"]) for r in tables("documents").collect()]
    for k in range(60):
        w = [f"t{j}" for j in range(60)] + [f"p{p}x{j}" for p in rng.choice(20, 8, replace=False) for j in range(10)]
        docs.append((10**6 + 2 * k, " ".join(w)))
        for at in rng.choice(70, 2, replace=False) + 65:
            w[at] = f"m{k}x{at}"
        docs.append((10**6 + 2 * k + 1, " ".join(w)))
    items = [(r["item_id"], r["text"]) for r in tables("benchmark").collect()]
    stages = dict(corpus_pipeline.STAGES)
    terms = toxicity.learn_lexicon(tables("documents"), tables("labels"))
    weights, known = quality.train(tables("documents"), tables("labels")), {}
    plain = {
        "quality": lambda docs: {i for i, t in docs if plain_quality(t, weights) >= 0.3},
        "toxicity": lambda docs: {i for i, t in docs if plain_toxicity(t, terms, known)[0] < 0.5},
        "ngram_join": lambda docs: {i for i, _, c in joined(docs) if i == c},
        "decontamination": lambda docs: {i for i, _, n, _ in contaminated(docs, items) if not n},
    }
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for name, keep in plain.items():
        frame = materialize(stages[name](spark, frame, sf), f"plain-{name}")
        kept = keep(docs)
        docs = [d for d in docs if d[0] in kept]
        assert rows(frame) == sorted(docs, key=key), name
    library = Reference.from_file(queries.tokenizer_path())
    assert rows(stages["bpe"](spark, frame, sf)) == sorted((bpe_row(library, i, t) for i, t in docs), key=key)


def test_pipeline_stages_on_edges(spark, sf, edge_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf).collect() == []
        out = stage(spark, edge_docs, sf)
        if stage is not corpus_pipeline.encode:
            assert out.columns == edge_docs.columns
        out.collect()
