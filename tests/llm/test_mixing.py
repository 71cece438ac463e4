import hashlib
import random
import re

from llm.common import saved
from llm.mixing import cyclic_weights, measured, mixed, taken, thresholds

DOCS = "doc_id long, source string, text string, size string, target int, taken int, place int, key int"


def rows_of(spark, docs):
    return saved(measured(spark.createDataFrame([(i, s, t, "x", 1, 2, 3, 4) for i, s, t in docs], DOCS)))


def brute(docs, weights, share=1.0, repeats=3):
    """What the operator promises, document by document in order of their places."""
    place = lambda i, t: int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for _, s, t in docs:
        total[s] = total.get(s, 0) + size(t)
    target, open_, left = {}, set(total), share * sum(total.values())
    while True:
        fair = {s: weights[s] * left / (sum(weights[x] for x in open_) or 1) for s in open_}
        above = {s for s in open_ if fair[s] > repeats * total[s]}
        if not above:
            target |= fair
            break
        for s in above:
            target[s] = repeats * total[s]
        open_, left = open_ - above, left - sum(target[s] for s in above)
    out = []
    for s in total:
        whole = int(target[s] // total[s]) if total[s] else 0
        rest, sums, until, seen = target[s] - whole * total[s], {}, 0, 0
        for i, x, t in docs:
            if x == s:
                sums[place(i, t)] = sums.get(place(i, t), 0) + size(t)
        for p in sorted(sums):
            if rest > 0 and seen < rest <= seen + sums[p]:
                until = p + (seen + sums[p] - rest <= rest - seen)
            seen += sums[p]
        out += [(i, s, size(t), total[s], target[s], size(t) * (whole + (place(i, t) < until))) for i, x, t in docs if x == s]
    return out


def key(row):
    return tuple((x is not None, x) if not isinstance(x, float) else (True, round(x, 6)) for x in row)


def some_docs(seed=1):
    r = random.Random(seed)
    docs = [(i, r.choice(["a", "b", "hot", "hot", "hot", None, "Z", "é"]), " ".join("w" * r.randrange(1, 4) for _ in range(r.choice([0, 1, 5, 40, 400])))) for i in range(400)]
    docs += [(None, "a", "one two"), (None, "a", "three"), (None, None, None), (7, "b", "again x"), (7, "b", "again x"), (1000, "empty", ""), (1001, "lone", "x " * 9000)]
    return docs


def test_every_row_as_brute_force(spark):
    docs = some_docs()
    rows = rows_of(spark, docs)
    weights = cyclic_weights(rows)
    named = {r.source: r.weight for r in weights.collect()}
    order = sorted({s for _, s, _ in docs if s is not None}) + [None]
    assert named == {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    for shares in [(1.0,), (0.05, 0.3, 2.0)]:
        limits = thresholds(rows, weights, shares)
        for k, share in enumerate(shares):
            got = [tuple(r) for r in taken(rows, limits, k).collect()]
            assert sorted(map(key, got)) == sorted(map(key, brute(docs, named, share)))


def test_a_larger_budget_takes_what_a_smaller_one_takes(spark):
    rows = rows_of(spark, some_docs(2))
    limits = thresholds(rows, cyclic_weights(rows), (0.1, 0.2, 0.7, 1.5, 3.0))
    taken_by = [sorted((key(r[:3]), r.taken) for r in taken(rows, limits, k).collect()) for k in range(5)]
    for less, more in zip(taken_by, taken_by[1:]):
        assert all(a[1] <= b[1] for a, b in zip(less, more))
    assert all(t == 3 * row[2][1] for row, t in taken_by[4])


def test_whole_documents_with_all_their_columns(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * (i % 9), "s", 1, 2, 3, 4) for i in range(60)], DOCS)
    rows = saved(measured(docs))
    limits = thresholds(rows, cyclic_weights(rows))
    out = mixed(docs, limits)
    assert out.columns == docs.columns
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert {r.doc_id: r.taken for r in taken(rows, limits).collect() if r.size} == {i: (i % 9) * times.get(i, 0) for i in range(60) if i % 9}


def test_sources_without_weight_and_empty_tables(spark):
    rows = rows_of(spark, [(1, "a", "x y"), (2, "b", "z")])
    weights = spark.createDataFrame([("a", 1), ("b", None), ("c", 5)], "source string, weight long")
    assert sorted((r.doc_id, r.target) for r in taken(rows, thresholds(rows, weights)).collect()) == [(1, 3.0), (2, 0.0)]
    none = rows_of(spark, [])
    assert taken(none, thresholds(none, cyclic_weights(none))).count() == 0
    blank = rows_of(spark, [(1, "a", None), (2, None, " \n")])
    assert [(r.source_size, r.target, r.taken) for r in taken(blank, thresholds(blank, cyclic_weights(blank))).collect()] == [(0, 0.0, 0)] * 2
