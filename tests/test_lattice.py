"""The lattice tokenizer against a plain dynamic program."""

import base64

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echoframe.operators import lattice as LT
from echoframe.operators.positions import extract_positions, with_tokens


def plain(costs, part):
    """Least (cost, pieces) by ends; of equal ones the longest last piece."""
    unknown = max(costs.values(), default=0) + LT.COST_UNIT
    best, back = [(0, 0)], [0]
    for end in range(1, len(part) + 1):
        ways = []
        for begin in range(end):
            c = costs.get(part[begin:end])
            if begin == end - 1:
                c = unknown if c is None else min(c, unknown)
            if c is not None:
                ways.append((best[begin][0] + c, best[begin][1] + 1, begin))
        cost, pieces, begin = min(ways)
        best.append((cost, pieces))
        back.append(begin)
    out, end = [], len(part)
    while end:
        out.append(part[back[end] : end])
        end = back[end]
    return out[::-1]


SIGNS = "abé \n中😀"


@given(st.dictionaries(st.text(SIGNS, min_size=1, max_size=4), st.integers(0, 9000), max_size=25), st.lists(st.text(SIGNS, max_size=20), max_size=8))
@settings(max_examples=150, deadline=None)
def test_same_as_the_plain_program(costs, texts):
    cutter = LT.Cutter(costs)
    for _ in range(2):  # solved, then remembered
        got = cutter(texts)
        assert got == [[x for part in LT.PARTS.findall(t) for x in plain(costs, part)] for t in texts]
        assert ["".join(pieces) for pieces in got] == texts


def test_long_parts_and_blocks(monkeypatch):
    monkeypatch.setattr(LT, "CELLS", 50)
    costs = LT.rank_costs(["ab", "a", "b", "aba", "bb"])
    parts = ["abba" * 40, "b" * 160, "a", "ba" * 3]
    assert LT.Lattice(costs).cut(parts) == [plain(costs, p) for p in parts]


def test_as_a_plug_in(spark, tmp_path):
    path = tmp_path / "ranks"
    pieces = ["the", " the", "ca", "t", "s", " ", "é", " cat"]
    lines = [f"{base64.b64encode(p.encode()).decode()} {k}" for k, p in enumerate(pieces)] + [f"{base64.b64encode(bytes([0xC3])).decode()} 99"]
    path.write_text("\n".join(lines) + "\n")
    costs = LT.read_ranked_pieces(spark, str(path))
    assert costs == LT.rank_costs(pieces)
    texts = ["the cats the  cat", None, "", " \n", "ééx the"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in with_tokens(frame, max_length=None, tokenizer=LT.lattice_tokenizer(spark, costs)).collect()}
    assert got == {k: None if t is None else [x for p in LT.PARTS.findall(t) for x in plain(costs, p)] for k, t in enumerate(texts)}
    rows = extract_positions(frame, positions_per_doc=2, min_position=1, tokenizer=LT.lattice_tokenizer(spark, costs)).collect()
    for r in rows:
        assert r["detokenized_text_truncated"] == "".join(got[int(r["doc_id"])][: r["n_raw_tokens"]])
    assert rows


def test_long_batches_are_cut_a_few_texts_at_a_time(spark):
    """More texts than are cut at once, with null and empty ones among them, in one Arrow batch."""
    texts = [None if k % 7 == 0 else "" if k % 11 == 0 else f"abc ab{k} " * (k % 5) for k in range(LT.TEXTS * 2 + 3)]
    tokenizer = LT.lattice_tokenizer(spark, LT.rank_costs(["a", "b", "ab", "abc", " "]))
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {r["id"]: r["t"] for r in rows.select("id", tokenizer(F.col("text")).alias("t")).collect()}
    assert len(got) == len(texts)
    assert all(got[k] is None if t is None else "".join(got[k]) == t for k, t in enumerate(texts))
