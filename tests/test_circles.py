import random
import sys

import pytest
from sitepack.operators import graph
from sitepack.operators.circles import closing_edges, strong_components

EDGES = "site string, src string, dst string, seq long"


def brute_closing(edges, roots):
    """A walk of one site after another, as one machine would do it."""
    sys.setrecursionlimit(100_000)
    bad = set()
    for site in {s for s, *_ in edges}:
        first = {}
        for s, a, b, seq in edges:
            if s == site:
                first[a, b] = min(seq, first.get((a, b), seq))
        nexts = {}
        for (a, b), seq in sorted(first.items(), key=lambda x: (x[1], x[0][1])):
            nexts.setdefault(a, []).append(b)
        state = {}

        def walk(node):
            state[node] = "open"
            for dst in nexts.get(node, []):
                if state.get(dst) == "open":
                    bad.add((site, node, dst))
                elif dst not in state:
                    walk(dst)
            state[node] = "done"

        for _, page, _ in sorted((r for r in roots if r[0] == site), key=lambda r: (r[2], r[1])):
            if page not in state:
                walk(page)
    return bad


@pytest.mark.parametrize("seed", [0])
def test_walks_as_one_machine_does_them(spark, seed):
    r = random.Random(seed)
    edges, roots = [], []
    for site in ("one", "two", "three"):
        n = r.choice([5, 12, 30])
        edges += [(site, f"n{r.randrange(n)}", f"n{r.randrange(n)}", r.randrange(4)) for _ in range(int(n * r.choice([1.0, 1.5, 2.5])))]
        roots += [(site, f"n{k}", r.randrange(3)) for k in r.sample(range(n), 3)]
    got = closing_edges(spark.createDataFrame(edges, EDGES), spark.createDataFrame(roots, "site string, page string, ord long"))
    assert {tuple(x) for x in got.collect()} == brute_closing(edges, roots)


def test_components(spark):
    r = random.Random(8)
    edges = {(s, r.randrange(12), r.randrange(12)) for s in "ab" for _ in range(18)} | {("ring", k, (k + 1) % 24) for k in range(24)}
    nodes = {(s, n) for s, a, b in edges for n in (a, b)}
    nexts = {}
    for s, a, b in edges:
        nexts.setdefault((s, a), set()).add((s, b))

    def reach(n):
        seen, todo = {n}, [n]
        while todo:
            for m in nexts.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    all_ = {n: reach(n) for n in nodes}
    want = {(s, n, min(m for t, m in all_[s, n] if (s, n) in all_[t, m])) for s, n in nodes}
    got = strong_components(spark.createDataFrame(list(nodes), "site string, node long"), spark.createDataFrame(list(edges), "site string, src long, dst long"))
    assert {tuple(x) for x in got.collect()} == want


def test_no_circle_no_roots_and_itself(spark):
    edges = [("s", "a", "b", 0), ("s", "c", "c", 0), ("t", "x", "y", 0), ("t", "y", "x", 0)]
    table = spark.createDataFrame(edges, EDGES)
    roots = spark.createDataFrame([("s", "a"), ("s", "c")], "site string, page string")
    sound, bad = graph.cut_back_edges(table, roots)
    assert {tuple(x) for x in bad.collect()} == {("s", "c", "c")} and sound.count() == 3
    assert closing_edges(table.limit(0), roots).count() == 0 and closing_edges(table.filter("site = 's' and src = 'a'"), roots).count() == 0
