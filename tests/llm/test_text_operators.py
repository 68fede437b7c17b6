"""BPE, licences, HTML, urls, sharding and decontamination against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Reference

from echoframe.llm import bpe, decontamination, html_extract, license_scan, queries, sharding, url_filter
from echoframe.session import new_table_path


def rows(df):
    return [tuple(r) for r in df.collect()]


def key(row):
    return tuple((x is None, str(x)) for x in row)


# ---------------------------------------------------------------- BPE

@pytest.fixture(scope="module")
def reference():
    return Reference.from_file(queries.tokenizer_path())


def bpe_row(reference, doc_id, text):
    ids = reference.encode(text or "", add_special_tokens=False).ids
    decoded = reference.decode(ids, skip_special_tokens=False)
    return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("words", [0, 50, 65536])
def test_bpe_equals_the_library(edge_docs, reference, words):
    got = rows(bpe.encode_decode(edge_docs, queries.tokenizer_path(), words))
    want = [bpe_row(reference, r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_bpe_round_trip(tables):
    out = bpe.encode_decode(tables("documents"), queries.tokenizer_path(), with_ids=True).join(tables("documents"), "doc_id")
    assert out.filter("decoded <> text or size(ids) <> n_tokens").count() == 0


def test_bpe_empty(no_docs):
    assert rows(bpe.encode_decode(no_docs, queries.tokenizer_path())) == []


@given(st.lists(st.binary(min_size=1, max_size=6), max_size=30), st.binary(max_size=6))
@settings(max_examples=60, deadline=None)
def test_lexicon_holds_its_words_only(words, other):
    table = {w: [len(w), *w] for w in words}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(table))
    asked = [*table, other]
    for w, rank in zip(asked, lexicon.rank(asked).tolist(), strict=True):
        assert (rank >= 0) == (w in table)
        if rank >= 0:
            assert np.frombuffer(lexicon.ids(rank), "<u4").tolist() == table[w]


def test_lexicon_shares_suffixes():
    states = lambda words: len(set(bpe.Lexicon(bpe.compile_lexicon({w: [1] for w in words})).to.tolist()))
    assert states([b"aing", b"bing", b"cing"]) == states([b"aing"])


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=200))
@settings(max_examples=150, deadline=None)
def test_merges_equal_the_library(text):
    reference = Reference.from_file(queries.tokenizer_path()) if not hasattr(test_merges_equal_the_library, "r") else test_merges_equal_the_library.r
    test_merges_equal_the_library.r = reference
    if not hasattr(test_merges_equal_the_library, "t"):
        test_merges_equal_the_library.t = bpe.Encoder(bpe.Tokenizer.load(queries.tokenizer_path()), bpe.Lexicon(bpe.compile_lexicon({})))
    encoder = test_merges_equal_the_library.t
    ids = next(iter(encoder([text])))
    assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids
    assert encoder.tokenizer.decode(ids) == reference.decode(ids.tolist(), skip_special_tokens=False)


@given(st.text(alphabet=st.sampled_from(list("ab1 '\n\tsremtdlv!é²\u00a0\u2028\x1c\u3000")), max_size=40), st.text(alphabet="a 's\n", max_size=12))
@settings(max_examples=400, deadline=None)
def test_splitter_finds_what_the_pattern_finds(one, two):
    import regex
    find = regex.compile(bpe.SPLIT.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    words, number, places = bpe.Splitter()([one, "", two])
    got = [[words[k] for k in number[a:b]] for a, b in zip(places[:-1], places[1:], strict=True)]
    assert got == [find(one), [], find(two)]


@given(st.lists(st.binary(min_size=1, max_size=90), max_size=12))
@settings(max_examples=60, deadline=None)
def test_many_merges_equal_single_ones(words):
    t = bpe.Tokenizer.load(queries.tokenizer_path()) if not hasattr(test_many_merges_equal_single_ones, "t") else test_many_merges_equal_single_ones.t
    test_many_merges_equal_single_ones.t = t
    words = words + [b" the", b"tokenization", b"aaaaaaaaaaaaaaaa"]
    assert [np.frombuffer(x, "<u4").tolist() for x in t.merge_many(words)] == [t.merge(w) for w in words]


def thue_morse(n):
    """Two different words of n letters on which polynomial hashes modulo a power of two agree."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_structured_words_do_not_clash(spark, reference, n):
    one, other = thue_morse(n)
    texts = [one, other, f"{one} {other}", f"{other} {one}"]
    assert [ids.tolist() for ids in bpe.Encoder(bpe.Tokenizer.load(queries.tokenizer_path()), bpe.Lexicon(bpe.compile_lexicon({})))(texts)] == [
        reference.encode(t, add_special_tokens=False).ids for t in texts
    ]
    items = spark.createDataFrame([(1, one), (2, f"x {other}")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"x {other} y"), (3, other)], "doc_id long, text string")
    got = {r["doc_id"]: list(r["items"]) for r in decontamination.contamination(docs, items).collect()}
    assert {k: [str(x) for x in v] for k, v in got.items()} == {1: ["1"], 2: ["2"], 3: []}


@given(st.lists(st.text("ab é", max_size=30), max_size=5), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_words_of_one_hash_are_told_apart(texts, modulus):
    """The encoder's result does not hang on its hash at all."""
    plain, weak = bpe.Splitter(), bpe.Splitter()
    full = weak.hasher
    weak.hasher = lambda points, begin, end: full(points, begin, end) % np.uint64(modulus)
    cut = lambda found: [[found[0][k] for k in found[1][a:b]] for a, b in zip(found[2][:-1], found[2][1:], strict=True)]
    assert cut(weak(texts)) == cut(plain(texts))


@pytest.mark.parametrize(("text", "size"), [("plain words, für plain words", 1), ("plain Ελλάδα plain", 2), ("plain \U0001f600 plain", 4)])
def test_words_are_hashed_in_few_bytes(text, size):
    split, given = bpe.Splitter(), []
    full = split.hasher
    split.hasher = lambda points, begin, end: given.append(points.itemsize) or full(points, begin, end)
    words, number, _ = split([text])
    assert "".join(words[k] for k in number) == text and given == [size]


def test_decoding_asks_no_piece_for_every_id(reference):
    class Counted(list):
        asked = 0

        def __getitem__(self, k):
            self.asked += 1
            return super().__getitem__(k)

    t = bpe.Tokenizer.load(queries.tokenizer_path())
    t.pieces = Counted(t.pieces)
    ids = np.array([*reference.encode("naïve 😀 words<|endoftext|>").ids * 5000, t.first[0xF0]], "<u4")
    assert t.decode(ids) == reference.decode(ids.tolist(), skip_special_tokens=False)
    assert t.pieces.asked == 0


def test_merges_of_many_words_in_parts(monkeypatch):
    t = bpe.Tokenizer.load(queries.tokenizer_path())
    words = [f" {k}{'ation' * (k % 14)}é".encode() for k in range(400)]
    monkeypatch.setattr(bpe, "CELLS", 600, raising=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in t.merge_many(words)] == [t.merge(w) for w in words]


def test_few_bytes_remembered(edge_docs, reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 2000)
    got = rows(bpe.encode_decode(edge_docs, queries.tokenizer_path(), 3))
    assert sorted(got, key=key) == sorted([bpe_row(reference, r["doc_id"], r["text"]) for r in edge_docs.collect()], key=key)


def test_a_part_of_a_full_bin_makes_a_lexicon(spark):
    words = [f"w{a}{b}" for a in "abcdefghijklmnop" for b in "qrstuvwxyz"]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    _, data = bpe.build_lexicon(docs, bpe.Tokenizer.load(queries.tokenizer_path()), 20)
    assert sum(r >= 0 for r in bpe.Lexicon(data).rank([f" {w}".encode() for w in words]).tolist()) in (19, 20)


# ---------------------------------------------------------------- licences

def test_license_forms(spark):
    mit = dict(license_scan.KNOWN[:1])["MIT"]
    docs = spark.createDataFrame(
        [
            (1, "Copyright (c) 2020 A. Person\nCopyright 2021 B\n\n" + mit.upper()), (2, mit.replace("Permission", "Permit")), (3, "Text.\nReleased under the MIT Licence!\nAll  rights\treserved"),
            (4, None), (5, ""), (None, "licenced under CC-BY-NC 4.0"), (None, "licenced under CC-BY-NC 4.0"), (6, "Copyright 2020"), (7, "Licensed under the GNU GPL v3\r\n"),
        ],
        "doc_id long, text string",
    )
    got = sorted(rows(license_scan.scan(docs)), key=key)
    assert got == sorted(
        [
            (1, "MIT", "", 0), (2, None, "", 0), (3, None, "MIT,all-rights-reserved", 2), (4, None, "", 0), (5, None, "", 0), (None, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1),
            (None, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1), (6, None, "", 0), (7, None, "", 0),
        ],
        key=key,
    ) or got[-1][1] is not None


def test_license_edges(edge_docs, no_docs):
    assert license_scan.scan(edge_docs).count() == edge_docs.count()
    assert rows(license_scan.scan(no_docs)) == []


def test_license_plan_is_native(tables):
    plan = license_scan.scan(tables("documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|SortMergeJoin|Cartesian", plan)


# ---------------------------------------------------------------- HTML

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="ad">Buy now. Buy, now!</div>
<article><h1>Title here</h1><p><b>First &amp; bold,  text.<br><p>Second\n para&#33;<ul><li>point one<li>point two</ul>{more}</article>
<div id=comments><p>A reader says something long, and more, and more.</p></div><form><p>Name</p></form><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("   ", ""), (PAGE.format(more=""), "Title here\nFirst & bold, text.\nSecond para!\npoint one\npoint two"),
        (PAGE.format(more="<aside>Side</aside><p>Third</p>"), "Title here\nFirst & bold, text.\nSecond para!\npoint one\npoint two\nThird"),
        ("<article><p>cut off in the <b>mid", "cut off in the mid"), ("<article><p>a &lt; b<p>tail <", "a < b\ntail <"), ("<nav>only menu</nav>", ""),
        ("<article><!-- no --><p>x<script>a</scr", "x"), ("</div></p><p>stray ends do no harm here, really.", "stray ends do no harm here, really."),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


BODY = "<p>The first paragraph, with some words.</p><p>The second one, with more words.</p>"
TEXT = "The first paragraph, with some words.\nThe second one, with more words."


@pytest.mark.parametrize(
    "page, text",
    [
        *((f'<body><div class="{c}"><article>{BODY}</article></div></body>', TEXT)
          for c in ("layout has-sidebar", "page with-comments", "layout--with-comments", "sidebar-right", "post comments-open", "header-fixed", "widget")),
        *((f'<body><div class="{c}"><main>{BODY}</main></div></body>', TEXT) for c in ("overlay", "page with-comments", "layout related")),
        (f'<article><div class="entry-header"><h1>The title</h1></div>{BODY}</article>', "The title\n" + TEXT),
        (f'<article>{BODY}<section class="legal"><p>The law, as it stands.</p></section></article>', TEXT + "\nThe law, as it stands."),
        *((f"<article><p>The first paragraph, with some words.</p>{e}<p>The second one, with more words.</p></article>", TEXT)
          for e in ('<svg width="1" height="1"/>', "<canvas/>", "<math />", '<object data="a"/>', "<svg><text>no</text></svg>", "<canvas>")),
        ("<article><p>The first paragraph, with some words.</p><svg/><p>The second one, with more words.</p><svg><text>no</text></svg></article>", TEXT),
        # what is not the article stays out
        (f'<article>{BODY}</article><div class="comments-area"><article class="comment"><p>I say, and say, and say.</p></article></div>', TEXT),
        (f'<article>{BODY}</article><div class="sidebar"><article><p>A teaser, and more.</p></article></div><div class="site-header">Site, the</div>', TEXT),
        (f'<article>{BODY}<div class="share-bar">Share this, and that.</div></article>', TEXT),
        (f'<div class="widget"><article>{BODY}<div class="share">Share this, and that.</div></article></div>', TEXT),
        (f'<div class="has-sidebar" style="display:none"><main><p>Not seen, not read.</p></main></div><article>{BODY}</article>', TEXT),
    ],
)
def test_names_and_self_closed_elements_cut_no_article(page, text):
    assert html_extract.main_text(page) == text


def test_pages_keep_article_and_nothing_else(tables):
    pages = tables("pages")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    import html as h
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)
        parts = re.split(r"<(?:/?h1|/?p)>", re.sub(r"<br>|</?b>", " ", inner[1])) if inner else []
        want = "\n".join(t for t in (" ".join(h.unescape(re.sub(r"<[^>]*$", "", p)).split()) for p in parts) if t)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
    assert len(got) == pages.count()


def test_deep_pages_take_linear_time():
    import time
    begin = time.time()
    text = html_extract.main_text("<div>some text here. " * 20_000)
    assert text.count("some text here.") == 20_000
    html_extract.main_text("<article>" + "<x>a" * 20_000 + "</p>" * 20_000)
    html_extract.main_text("<svg>a " * 20_000 + "<p>b")
    assert time.time() - begin < 10


def distances(parent):
    """Steps between all pairs of nodes, by walking up."""
    def up(v):
        way = [v]
        while v:
            v = parent[v]
            way.append(v)
        return way
    return [[min(i + j for i, x in enumerate(up(a)) for j, y in enumerate(up(b)) if x == y) for b in range(len(parent))] for a in range(len(parent))]


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=40), st.booleans())
@settings(max_examples=60, deadline=None)
def test_smoothing_is_a_sum_over_all_paths(draws, few):
    parent = [0] + [d % (k + 1) for k, d in enumerate(draws)]
    values = np.random.default_rng(len(parent)).random((len(parent), 2))
    kept = html_extract.FEW_PATHS
    html_extract.FEW_PATHS = 10**6 if few else 0
    got = html_extract.smoothed(np.array(parent), values)
    html_extract.FEW_PATHS = kept
    weights = [[0.0 if d > html_extract.REACH else np.exp(-d * d / 2) for d in row] for row in distances(parent)]
    assert np.allclose(got, np.array(weights) @ values)


PROSE = "A long paragraph of the text, with words and signs, as they are. It goes on, and on."


@pytest.mark.parametrize("page, text", [
    (f"<body><div id=top><a href=x>Home</a> <a href=y>News</a></div><div class=main><h1>A title</h1><p>{PROSE}</p><h2>Part two</h2><p>{PROSE}</p>"
     "<ul><li>item one</li><li>item two</li></ul></div><div class=footer>imprint</div></body>", f"A title\n{PROSE}\nPart two\n{PROSE}\nitem one\nitem two"),
    (f"<body><article><h1>T</h1><p>{PROSE}</p><h2>Sources</h2><ul><li><a href=x>Smith and Jones, The Title</a></li><li><a href=y>Another Author, Work</a></li></ul>"
     "<ul><li><a>Tweet</a></li></ul></article></body>", f"T\n{PROSE}\nSources\nSmith and Jones, The Title\nAnother Author, Work"),
    (f"<body><p>{PROSE}</p><h3>Between</h3><p>{PROSE}</p></body>", f"{PROSE}\nBetween\n{PROSE}"),
])
def test_short_blocks_of_the_text_stay(page, text):
    assert html_extract.main_text(page) == text


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>a"), (None, "u", "<p>a")], "page_id long, url string, html string")
    assert sorted(rows(html_extract.extract(pages)), key=key) == sorted([(1, None, "", 0), (None, "u", "a", 1), (None, "u", "a", 1)], key=key)
    assert rows(html_extract.extract(pages.limit(0))) == []


# ---------------------------------------------------------------- urls

URLS = [
    None, "", "no scheme", "http://com/", "https://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "http://example.com", "http://x.net/es/a", "http://net.org/net/es/",
    "ftp://xnet/es/", "http://a.b.net/fr/?q", "http://evil.org/foo.com/", "http://é.com/é", "://com/", "http://com?x/", "http://www.www.example.com/en/p://q", "http://.com/",
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(URLS)] + [(0, None, None), (None, "http://com/", None)], "page_id long, url string, verdict string")

    def judge(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest).group()
            path = re.match(r"[^?#]*", rest[len(host):]).group()
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fitting = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fitting, key=lambda r: len(r.name), default=None)
        return host, path, best.name if best else None, best.verdict if best else "allow"

    got = sorted(rows(url_filter.filter_urls(pages, queries.RULES)), key=key)
    assert got == sorted([(r["page_id"], *judge(r["url"])) for r in pages.collect()], key=key)
    assert rows(url_filter.filter_urls(pages.limit(0), queries.RULES)) == []
    assert {r["verdict"] for r in url_filter.filter_urls(pages, ()).collect()} == {"allow"}


@given(st.lists(st.text("ab*", min_size=1, max_size=40), min_size=1, max_size=8), st.lists(st.text("ab", max_size=30), min_size=1, max_size=5))
@settings(max_examples=80, deadline=None)
def test_automaton_equals_globs(globs, texts):
    automaton = url_filter.Automaton([[-1 if c == "*" else ord(c) for c in re.sub(r"\*+", "*", g)] for g in globs])
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = automaton.accepted(automaton.run(np.frombuffer(data, np.uint8).astype(np.int64), offsets))
    want = [[bool(re.fullmatch(g.replace("*", ".*"), t)) for g in globs] for t in texts]
    assert got.tolist() == want


# ---------------------------------------------------------------- sharding

def check_shards(docs, out, n_shards=16):
    got = out.collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=key) == sorted(
        ((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()), key=key
    )
    for s in {r["shard"] for r in got}:
        assert 0 <= s < n_shards
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    return got


def test_shards_balance_bytes(spark, tables):
    got = check_shards(tables("documents"), sharding.shard_documents(tables("documents"), new_table_path(spark, "map")))
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(load) - min(load) <= 0.05 * sum(load) / 16


def test_shard_edges(spark, edge_docs, no_docs):
    check_shards(edge_docs, sharding.shard_documents(edge_docs, new_table_path(spark, "map")))
    assert rows(sharding.shard_documents(no_docs, new_table_path(spark, "map"))) == []


def test_equal_rows_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEP", 1000)
    docs = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    got = check_shards(docs, sharding.shard_documents(docs, new_table_path(spark, "map")))
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(load) - min(load) <= 0.01 * sum(load) / 16


def test_the_stored_map_is_edited(spark, tables):
    """Every run loads the latest map, moves only what balance asks for, and stores the next version."""
    path, docs = new_table_path(spark, "map"), tables("documents")
    check_shards(docs, sharding.shard_documents(docs, path))
    first = check_shards(docs, sharding.shard_documents(docs, path))
    more = check_shards(docs, sharding.shard_documents(docs, path, 17), 17)
    one, two, three, four = ({r["slot"]: r["shard"] for r in sharding.load_map(spark, path, v).collect()} for v in (1, 2, 3, 4))
    assert one == sharding.first_map(16) and one != two
    assert sum(three[s] != two[s] for s in two) < 20
    used = {r["virtual_slot"] for r in first}
    assert 16 in {four[s] for s in used} and sum(four[s] != three[s] for s in used) < len(used) / 2
    assert {r["virtual_slot"]: r["shard"] for r in more} == {s: four[s] for s in used}
    assert sharding.load_map(spark, path).first()["version"] == 4


def test_map_versions_and_rebalance(spark, tables):
    path = new_table_path(spark, "map")
    docs = tables("documents")
    slotted = sharding.with_slots(docs)
    sizes = sharding.slot_sizes(slotted)
    first = sharding.assign(sizes, 16)
    sharding.save_map(spark, path, first, sizes, 1)
    more = sharding.rebalance(first, sizes, 17)
    moved = {s for s in first if first[s] != more[s]}
    assert moved and all(more[s] == 16 for s in moved if dict((a, b) for a, b, _ in sizes).get(s, 0) > 0 and first[s] < 16 and more[s] == 16)
    assert len(moved) < len(first) / 8
    sharding.save_map(spark, path, more, sizes, 2)
    assert sharding.load_map(spark, path).first()["version"] == 2 and sharding.load_map(spark, path, 1).count() == sharding.N_SLOTS
    fewer = sharding.rebalance(more, sizes, 15)
    assert max(fewer.values()) == 14
    check_shards(docs, sharding.apply_map(slotted, sharding.load_map(spark, path)), 17)


# ---------------------------------------------------------------- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contaminated(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = WORD.findall(low(text))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w = WORD.findall(low(text))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=key)


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_contamination_on_tables(tables):
    got = sorted(pairs(decontamination.contamination(tables("documents"), tables("benchmark")), "doc_id", "n_words", "n_hit", "items"), key=key)
    want = contaminated(pairs(tables("documents"), "doc_id", "text"), pairs(tables("benchmark"), "item_id", "text"))
    assert got == want and any(r[2] for r in want)


@pytest.mark.parametrize("pass_bytes", [8 << 20, 1])
def test_contamination_edges(spark, edge_docs, no_docs, monkeypatch, pass_bytes):
    monkeypatch.setattr(decontamination, "PASS_BYTES", pass_bytes)
    items = [(1, "ONE two, three four five six seven eight nine ten eleven"), (10, "one two three four five six seven eight nine ten"), (2, "stop"), (3, None), (4, "--"), (None, "one two"), (1, "stop don")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = contaminated(pairs(edge_docs, "doc_id", "text"), [i for i in items if i[0] is not None])
    got = decontamination.contamination(edge_docs, benchmark)
    assert sorted(pairs(got, "doc_id", "n_words", "n_hit", "items"), key=key) == want
    assert decontamination.contamination(edge_docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0
    assert rows(decontamination.contamination(no_docs, benchmark)) == []


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=1, max_size=4), st.lists(st.sampled_from("abc"), min_size=1, max_size=4), st.integers(0, 2))
@settings(max_examples=80, deadline=None)
def test_phrase_and_proximity(texts, phrase, slop):
    hasher = decontamination.WordHasher()
    data = [" ".join(t) for t in texts]
    raw = "".join(data).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in data])])
    h, row = decontamination.words_of(np.frombuffer(raw, np.uint8), offsets, hasher)
    terms, begins, at = decontamination.postings(h, np.arange(len(h)) + row)
    block = decontamination.Block({
        "block": 0, "doc_ids": list(range(len(texts))), "n_words": np.bincount(row, minlength=len(texts)).astype("<u4").tobytes(), "terms": terms.astype("<u8").tobytes(),
        "begins": begins.astype("<u4").tobytes(), "places": at.astype("<u4").tobytes(),
    })
    window = decontamination.words_of(np.frombuffer(" ".join(phrase).encode(), np.uint8), np.array([0, 2 * len(phrase) - 1]), hasher)[0]
    first = block.first
    exact = {(d, k) for d, t in enumerate(texts) for k in range(len(t) - len(phrase) + 1) if t[k : k + len(phrase)] == phrase}
    _, start = block.find(window[None, :])
    assert {(int(np.searchsorted(first, s, "right")) - 1, int(s - first[np.searchsorted(first, s, "right") - 1])) for s in start} == exact
    near = set()
    for d, t in enumerate(texts):
        reach = {k for k, w in enumerate(t) if w == phrase[0]}
        for w in phrase[1:]:
            reach = {k for k, x in enumerate(t) if x == w and any(0 < k - q <= slop + 1 for q in reach)}
        near |= {(d, k) for k in reach}
    got = block.near(window, slop)
    assert {(int(np.searchsorted(first, p, "right")) - 1, int(p - first[np.searchsorted(first, p, "right") - 1])) for p in got} == near


def test_proximity_over_tables(spark):
    docs = spark.createDataFrame([(1, "a x b"), (2, "a x y b"), (3, None)], "doc_id long, text string")
    assert rows(decontamination.proximity(decontamination.build_index(docs), "A b", 1)) == [(1, 2)]
