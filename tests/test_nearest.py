"""Exact nearest labelled vectors against a comparison with all."""

import math
import pickle

import numpy as np
import pytest

from echoframe.operators import nearest as N

LABELLED = "doc_id string, n long, activation_vector array<float>, api_explanation string"


def brute(queries, labelled, samples):
    out = {}
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    for name, v in queries:
        if not ok(v):
            continue
        scored = []
        for d, n, w, _ in labelled:
            if ok(w) and len(w) == len(v):
                s = N.similarities(np.array([v], np.float32).astype(float), np.array([w], np.float32).astype(float))[0, 0]
                scored.append((-s, d, n))
        out[name] = [(k, d, n, -s) for k, (s, d, n) in enumerate(sorted(scored)[:samples])]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["name"], []).append((r["sample_id"], r["near_doc_id"], r["near_n"], r["similarity"]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("samples", [1, 4])
@pytest.mark.parametrize("small", [False, True])
def test_same_as_comparing_with_all(spark, monkeypatch, samples, small):
    """Clusters, ties, scaled copies, a vector that a third of the labels have, vectors without a direction, other lengths."""
    if small:
        monkeypatch.setattr(N, "RING_ROWS", 7)
        monkeypatch.setattr(N, "QUERY_ROWS", 5)
        monkeypatch.setattr(N, "BATCH_ROWS", 3)
        monkeypatch.setattr(N, "ROUNDS", (1, 3, None))
    rng = np.random.default_rng(samples)
    centres = rng.normal(size=(6, 5))
    vectors = [centres[k % 6] + rng.normal(size=5) * 0.1 for k in range(200)] + [rng.integers(-2, 3, 5) for _ in range(120)]
    labelled = [(f"d{k % 90:02d}", k, [float(x) for x in v], f"e{k}") for k, v in enumerate(vectors)]
    labelled += [(f"h{k:03d}", k, [1.0, 2.0, 0.0, 0.0, -1.0], "hot") for k in range(150)]
    labelled += [(f"s{k}", k, [x * (k + 2) for x in labelled[k][2]], "scaled") for k in range(20)]
    labelled += [("z", 1, [0.0] * 5, "z"), ("y", 1, None, "y"), ("x", 1, [], "x"), ("w", 1, [1.0, None, 0.0, 0.0, 0.0], "w"), ("u", 1, [math.inf] * 5, "u"), ("t", 1, [1.0, 1.0], "t")]
    queries = [(f"q{k}", [float(x) for x in centres[k % 6] + rng.normal(size=5) * 0.3]) for k in range(40)]
    queries += [(f"l{k}", labelled[k][2]) for k in range(190, 215)] + [("hot", [2.0, 4.0, 0.0, 0.0, -2.0]), ("far", [-1.0, -2.0, 0.0, 0.0, 1.0])]
    queries += [("none", None), ("empty", []), ("zero", [0.0] * 5), ("nan", [math.nan] * 5), ("two", [1.0, 0.5]), ("three", [1.0, 0.5, 0.5])]
    left = spark.createDataFrame(queries, "name string, activation_vector array<float>").repartition(3)
    right = spark.createDataFrame(labelled, LABELLED).repartition(4)
    got = found(N.nearest_labels(left, right, ["doc_id", "n"], samples))
    want = {k: v for k, v in brute(queries, labelled, samples).items() if v}
    assert got == want


def test_responses_and_empty_tables(spark):
    left = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "name string, activation_vector array<float>")
    right = spark.createDataFrame([("d", 1, [2.0, 0.1], "first"), ("e", 1, [0.1, 3.0], "second")], LABELLED)
    spoken = {(r["name"], r["sample_id"]): r["response"] for r in N.verbalise_nearest(left, right, ["doc_id", "n"], 2).collect()}
    assert spoken["a", 0] == "<explanation>\nfirst\n</explanation>" and spoken["b", 0] == "<explanation>\nsecond\n</explanation>"
    assert len(spoken) == 4
    assert N.nearest_labels(left, right.limit(0), ["doc_id", "n"]).collect() == []
    assert N.nearest_labels(left.limit(0), right, ["doc_id", "n"]).collect() == []


def test_bounds_hold():
    """No label is nearer than the bound of its ring says."""
    rng = np.random.default_rng(0)
    unit = N._unit(rng.normal(size=(300, 4)))
    pivots = unit[:10]
    empty = N.Rings(pivots, *[np.zeros(0)] * 3)
    angle = empty.angles(unit)
    cell = angle.argmin(axis=1)
    band = (angle[np.arange(300), cell] / N.RING).astype(int)
    keys = sorted(set(zip(cell.tolist(), band.tolist())))
    member = np.array([keys.index(k) for k in zip(cell.tolist(), band.tolist())])
    own = angle[np.arange(300), cell]
    rings = N.Rings(pivots, np.array([c for c, _ in keys]), np.array([own[member == k].min() for k in range(len(keys))]), np.array([own[member == k].max() for k in range(len(keys))]))
    queries = N._unit(rng.normal(size=(50, 4)))
    true = np.arccos(np.clip(queries @ unit.T, -1, 1))
    assert (rings.bounds(queries)[:, member] <= true + N.SLACK).all()


def test_parts_are_bounded_and_hold_every_ring():
    """Many small rings share a part, so what is sent does not grow with their number; a large ring is split."""
    sizes = [3] * 5000 + [40] + [1, 9, 10]
    parts = N._parts(sizes, 10)
    held = {}
    for size, (first, own) in zip(sizes, parts, strict=True):
        for k in range(own):
            held[first + k] = held.get(first + k, 0) + -(-size // own)
    assert max(held.values()) <= 10 and len(held) < 1700 and sorted(held) == list(range(len(held)))


@pytest.mark.parametrize("width", [1, 3, 64])
def test_single_precision_rules_out_nothing_that_counts(monkeypatch, width):
    """Answers closer to each other than single precision can tell, in tiles of few labels, by few comparisons in double precision."""
    monkeypatch.setattr(N, "TILE_ROWS", 16)
    rng = np.random.default_rng(width)
    centre = rng.normal(size=(5, width))
    y = np.concatenate([centre[k % 5] + rng.normal(size=width) * 10.0 ** -(k % 9) for k in range(600)]).reshape(600, width)
    pivots = N._unit(y[:20])
    angle = N.Rings(pivots, *[np.zeros(0)] * 3).angles(N._unit(y))
    cell = angle.argmin(axis=1)
    own = angle[np.arange(600), cell]
    keys, ring = np.unique(np.stack([cell, (own / N.RING).astype(int)]), axis=1, return_inverse=True)
    rings = N.Rings(pivots, keys[0], *(np.array([f(own[ring.ravel() == k]) for k in range(keys.shape[1])]) for f in (np.min, np.max)))
    order = np.argsort(ring.ravel(), kind="stable")
    labels = N.Labels(order, y[order], np.linalg.norm(y[order], axis=1), N._unit(y[order]).astype(np.float32))
    tiles = N._tiles(ring.ravel()[order], rings)
    assert (tiles.end - tiles.begin).max() <= 16 and tiles.begin[0] == 0 and tiles.end[-1] == 600
    compared, merge = [], N._merge
    monkeypatch.setattr(N, "_merge", lambda top, names, i, *rest: (compared.append(len(i)), merge(top, names, i, *rest)))
    q = np.concatenate([y[::7], rng.normal(size=(30, width))])
    got, names = N._opened(q, N._unit(q), labels, tiles, 3)
    for row, name, s in zip(got, names, N.similarities(q, y), strict=True):
        best = np.lexsort((np.arange(600), -s))[:3]
        # a sum in another order may move the last digit
        assert np.abs(row - s[best]).max() <= 1.5 * 10.0**-N.DIGITS and np.abs(s[name] - s[best]).max() <= 1.5 * 10.0**-N.DIGITS
    assert width < 64 or sum(compared) < len(q) * 600 / 4


def test_a_pair_of_parts_is_a_task_and_executors_need_no_package(spark, monkeypatch):
    for n in (1, 16, 53):
        ids = spark.createDataFrame([(s,) for s in N._slots(spark, n)], "slot long").repartition(n, "slot")
        assert [len(p) for p in ids.rdd.glom().collect()] == [1] * n
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (sent.append(value), broadcast(self, value))[1])
    rows = spark.createDataFrame([(f"d{k}", k, [float(k % 7 + 1), float(k % 5)], "e") for k in range(40)], LABELLED)
    assert N.nearest_labels(rows.select("doc_id", "activation_vector"), rows, ["doc_id", "n"]).count() == 40
    assert len(sent) == 2 and not any(b"echoframe" in pickle.dumps(value) for value in sent)
