import inspect
import random

import numpy as np

import llm.ann as module
from llm.ann import Graph, centroids, folded, near_lists, nearest


def test_recall_ties_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(module, "LIST_ROWS", 150)
    monkeypatch.setattr(module, "PART_ROWS", 100)
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 16)) + 2 * r.normal(size=(12, 16))[r.integers(0, 12, 3000)]
    x[2000:2040] = x[100]
    rows = [(k, [float(v) for v in x[k]]) for k in range(3000)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, [1.0]), (None, [1.0] * 16), (5005, [float("inf")] + [1.0] * 15)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for q in nearest(df, df.filter("vec_id % 50 = 0"), 5).collect():
        got.setdefault(q.query_id, {})[q.rank] = (q.vec_id, q.score)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for k in range(0, 3000, 50):
        cos = unit @ unit[k]
        cos[k] = -9
        best = np.lexsort((np.arange(3000), -np.round(cos, 12)))[:5]
        found = [got[k][n] for n in range(1, 6)]
        hits += len({v for v, _ in found} & set(best.tolist()))
        assert all(abs(s - cos[v]) < 1e-12 for v, s in found)
        assert [(-s, v) for v, s in found] == sorted((-s, v) for v, s in found)
    assert len(got) == 60 and hits >= 0.9 * 300
    assert [got[100][n][0] for n in range(1, 6)] == [2000, 2001, 2002, 2003, 2004]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(x.query_id, x.rank, x.vec_id) for x in nearest(df, df.filter("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_repeated_id_takes_one_place(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.1])] * 6 + [(1, [1.0, 9.0])] + [(k, [1.0, k / 10]) for k in range(2, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [x.vec_id for x in nearest(df, df.filter("vec_id = 0")).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_recall_with_hundreds_of_lists():
    r = np.random.default_rng(4)
    x = r.normal(size=(240_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = Graph(centroids(x[:20_000], 480))
    asked, at = x[:100], inspect.signature(nearest).parameters
    dots = asked @ x.T
    dots[np.arange(100), np.arange(100)] = -9
    best = np.argpartition(-dots, 5, axis=1)[:, :5].ravel()
    sent, kept = np.zeros((100, 480), bool), np.zeros((500, 480), bool)
    sent[near_lists(found, asked, at["ask_ratio"].default, module.LEAST_LISTS)] = True
    kept[near_lists(found, x[best], at["post_ratio"].default, 1)] = True
    assert (kept & np.repeat(sent, 5, 0)).any(1).mean() >= 0.95


def test_graph_sees_what_a_full_product_sees():
    r = np.random.default_rng(2)
    for n in (1, 2, 9, 300):
        points = r.normal(size=(n, 32))
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        x = r.normal(size=(200, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        far = np.sqrt(np.maximum(0, 2 - 2 * x @ points.T)) + 1e-9
        for ratio, least in ((1.03, 1), (1.3, 6)):
            want = far <= np.maximum(ratio * far.min(1), np.sort(far, axis=1)[:, min(least, n) - 1])[:, None] + 1e-12
            got = np.zeros_like(want)
            got[near_lists(Graph(points), x, ratio, least)] = True
            assert not (got & ~want).any() or n > 100
            assert (got & want).sum() >= 0.97 * want.sum()


def test_large_and_small_numbers_and_other_dimensions(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 2e200]), (2, [1e-200, 1e-200]), (3, [1.0, 0.0]), (4, [1.0, 1.0, 1.0]), (5, [0.0, -5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x.query_id, x.vec_id): x.score for x in nearest(df, df.filter("vec_id in (0, 4)")).collect()}
    want = {3: 1.0, 2: 0.5**0.5, 1: 0.2**0.5, 5: 0.0}
    assert {v for q, v in got if q == 0} == set(want) and all(abs(got[0, v] - w) < 1e-12 for v, w in want.items())
    assert not any(q == 4 for q, _ in got)


def test_equal_vectors_are_one_posting_with_their_smallest_ids(spark):
    same, other = [1.0, 2.0, 3.0], [3.0, 2.0, 1.0]
    rows = [(k, same) for k in range(40)] + [(7, same)] * 30 + [(k, other) for k in (90, 7)] + [(99, [1.0, 1.0, 1.0])] * 3
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    got = {tuple(x.vector): x.ids for x in folded(df, 6).collect()}
    assert folded(df, 6).count() == 3 and got == {tuple(same): [0, 1, 2, 3, 4, 5], tuple(other): [7, 90], (1.0, 1.0, 1.0): [99]}


def test_many_equal_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(module, "LIST_ROWS", 40)
    r = np.random.default_rng(9)
    x = np.round(r.normal(size=(400, 6)), 1)
    x[r.integers(0, 400, 160)] = x[3]
    x[r.integers(0, 400, 40)] = x[4]
    ids = np.append(np.arange(380), r.integers(0, 60, 20))  # twenty ids have a second vector
    df = spark.createDataFrame([(int(i), [float(v) for v in y], "x") for i, y in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, ids string")
    got = nearest(df, df.filter("vec_id % 50 = 0"), 5, ask_ratio=float("inf")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 380, 50):
        best = {}
        for at in np.flatnonzero(ids == q):
            for i, s in zip(ids, unit @ unit[at], strict=True):
                best[i] = max(best.get(i, -9), round(float(s), 12))
        best.pop(q)
        want = sorted(best, key=lambda i: (-best[i], i))[:5]
        assert [g.vec_id for g in sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)] == want
