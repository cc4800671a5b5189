"""Operators on vectors against brute force."""

import collections
import math

import numpy as np
import pytest

from spanveil.llm import near_vectors, topk

SCHEMA = "vec_id long, embedding array<float>, label int, rep int, q string, ids int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for i in range(600):
        v = rng.normal(size=16)
        if i % 3 == 0:
            v = np.ones(16) + (i % 9) * 0.1 * rng.normal(size=16) * (i % 2)  # many equal and near ones
        out.append((i, [float(x) for x in np.float32(v / np.linalg.norm(v))], i % 4 or None, 1, "x", 2))
    out += [(700, None, 1, 1, "x", 2), (750, [0.0] * 16, 1, 1, "x", 2), (800, [float("nan")] * 16, 1, 1, "x", 2), (850, [None] + [1.0] * 15, 1, 1, "x", 2), (None, [1.0] * 16, 1, 1, "x", 2)]
    return out


@pytest.mark.parametrize("size", [topk.BLOCK, 64])
def test_top_k_by_brute_force(shared, rows, monkeypatch, size):
    monkeypatch.setattr(topk, "BLOCK", size)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8 if size == 64 else topk.QUERY_BLOCK)
    frame = shared.createDataFrame(rows, SCHEMA)
    ok = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = set()
    for i in ok:
        if i % 50 == 0:
            best = sorted((-int(ok[i] @ ok[j]), j) for j in ok if j != i)[:5]
            want |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    got = topk.top_k(frame, 5, 50).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_of_few_rows(shared, rows):
    frame = shared.createDataFrame(rows, SCHEMA)
    assert topk.top_k(frame.limit(0), 5, 50).count() == 0
    assert topk.top_k(frame.where("vec_id = 0"), 5, 50).count() == 0
    assert [r.vec_id for r in topk.top_k(frame.where("vec_id < 3"), 5, 50).orderBy("rank").collect()].__len__() == 2


def test_near_vectors_by_brute_force(shared, rows):
    found = near_vectors.near_vectors(shared.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    ok = {i: (np.array(v, float), label) for i, v, label, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v) and label is not None}
    links = collections.defaultdict(set)
    for i, (a, la) in ok.items():
        for j, (b, lb) in ok.items():
            if i != j and la == lb and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[i].add(j)
    got = {r.vec_id: r.n_links for r in found}
    true = sum(map(len, links.values()))
    assert all(got[i] <= len(links[i]) for i in got) and sum(got.values()) >= 0.9 * true and true > 1000
    assert all(r.n_links == 0 and r.kept for r in found if r.vec_id not in ok)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found if r.vec_id is not None)
    assert near_vectors.near_vectors(shared.createDataFrame([], SCHEMA)).count() == 0


def test_top_k_of_huge_components_and_repeated_rows(shared):
    rows = [(0, [1.0, 1, 1, 1]), (1, [2000000.0, 0, 0, 0]), (2, [1e12, -1e12, 5.5, 0]), (3, [1e17, 0, 0, 1]), (4, [3.0, 0, 0, 0]), (5, [-1e300, 0, 0, 0])]
    rows += [(4, [3.0, 0, 0, 0])] * 2 + [(7, [0.5, 0, 0, 0])] * 20 + [(50, [1.0, 0, 0, 0])] * 9
    frame = shared.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    low, high = -(1 << 63), (1 << 63) - 1

    def whole(x):
        return int(x) * 256 if abs(x) > 2**53 else math.floor(256 * x)

    want = collections.Counter()
    for query in {i for i, _ in rows if i % 50 == 0}:
        scored = []
        for i, v in rows:
            for j, w in rows:
                if i == query and j != i:
                    scored.append((-min(max(sum(whole(a) * whole(b) for a, b in zip(v, w)), low), high), j))
        want.update((query, rank, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:5], 1))
    assert collections.Counter(tuple(r) for r in topk.top_k(frame, 5, 50).collect()) == want


@pytest.mark.parametrize("size", [64, 128])
def test_recall_at_the_threshold(shared, size):
    rng = np.random.default_rng(size)
    rows = []
    for i in range(400):
        a, b = rng.normal(size=(2, size))
        b -= a * (a @ b) / (a @ a)
        a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (0.935 * a + math.sqrt(1 - 0.935**2) * b).tolist(), 1)]
    found = near_vectors.near_vectors(shared.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert found.where("n_links > 0").count() >= 0.95 * len(rows)


def test_links_at_every_length(shared):
    rows = [(i, [1.0, 0.01 * i] + [0.5] * 40, 1) for i in range(5)] + [(10, [1.0, 0.5, 0.2], 1), (11, [1.0, 0.51, 0.2], 1), (12, [1.0, 0.5, 0.2], 2), (13, [2.0], 1), (14, [3.0], 1)]
    found = {r.vec_id: r for r in near_vectors.near_vectors(shared.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [found[i].n_links for i in (0, 4, 10, 11, 12, 13, 14)] == [4, 4, 1, 1, 0, 1, 1] and found[11].component_id == 10
