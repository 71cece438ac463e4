import random
from collections import deque

from pyspark.sql import functions as F

from sitepack.operators import expansion, graph, store


def bfs(edges, entry):
    out, seen, queue = [], {entry}, deque([(entry, 0)])
    while queue:
        page, depth = queue.popleft()
        out.append((page, depth))
        for dst in edges.get(page, []):
            if dst not in seen:
                seen.add(dst)
                queue.append((dst, depth + 1))
    return out


def test_crawl_equals_a_single_queue(spark):
    r, rows, want = random.Random(3), [], {}
    for site in ("a", "b", "chain"):
        links = {}
        for k in range(40):
            targets = [f"p{r.randrange(60)}" for _ in range(r.randrange(4))] if site != "chain" else [f"p{k + 1}"]
            links[f"p{k}"] = [t for t in dict.fromkeys(targets) if t != f"p{k}"]
        if site == "chain":
            links = {k: v for k, v in links.items() if int(k[1:]) < 12}
        rows += [(site, src, dst, seq) for src, targets in links.items() for seq, dst in enumerate(targets)]
        want[site] = bfs(links, "p0")
    edges = spark.createDataFrame(rows, "site string, src string, dst string, seq long")
    entries = spark.createDataFrame([(s, "p0") for s in want] + [("lone", "x"), ("none", None)], "site string, entry string")
    got = {}
    for x in graph.crawl(edges, entries).orderBy("site", "ord").collect():
        got.setdefault(x.site, []).append((x.page, x.depth))
    assert got == want | {"lone": [("x", 0)]}
    pages = spark.createDataFrame([("a", f"p{k}") for k in range(60)], "site string, page string")
    lost = {x.page for x in graph.unreachable(pages, graph.crawl(edges, entries)).collect()}
    assert lost == {f"p{k}" for k in range(60)} - {p for p, _ in want["a"]}


def test_closure_heights_and_frames(spark):
    rows = [("s", "a", "b", 1), ("s", "b", "c", 2), ("s", "c", "a", 3), ("s", "b", "b", 4)] + [("s", f"d{k}", f"d{k + 1}", 0) for k in range(12)]
    edges = spark.createDataFrame(rows, "site string, src string, dst string, seq long")
    roots = spark.createDataFrame([("s", "a"), ("s", "d0")], "site string, page string")
    embedded, refused = graph.closure(edges, roots)
    assert {tuple(x.path) for x in embedded.filter("root = 'a'").collect()} == {("a",), ("a", "b"), ("a", "b", "c")}
    assert embedded.filter("root = 'd0'").count() == 9
    assert {(x.root, x.page, x.code) for x in refused.collect()} == {("a", "a", "circular"), ("a", "b", "circular"), ("d0", "d9", "too_deep")}
    sound, bad = graph.cut_back_edges(edges, roots)
    assert {(x.src, x.dst) for x in bad.collect()} == {("c", "a"), ("b", "b")}
    nodes = spark.createDataFrame([("s", n) for n in ("a", "b", "c", "d12")], "site string, node string")
    assert {(x.node, x.height) for x in graph.heights(nodes, sound.filter("src in ('a', 'b', 'c')")).collect()} == {("a", 2), ("b", 1), ("c", 0), ("d12", 0)}
    links = spark.createDataFrame([("s", "b", "x", 0), ("s", "a", "y", 5)], "site string, src string, dst string, seq long")
    got = graph.links_through_frames(links, embedded).filter("src = 'a'").orderBy("seq").collect()
    assert [x.dst for x in got] == ["x", "y"]


def test_store(spark):
    rows = [(0, "a.png", "image/png", b"x", False), (1, "b.png", "image/png", b"x", False), (2, "c.css", "text/css", b"x", True), (3, "d.css", "text/css", b"x", False), (4, "e.bin", "image/png", b"y", False)]
    df = spark.createDataFrame([("s", o, r, m, bytearray(d), t) for o, r, m, d, t in rows], "site string, ord long, rel string, mime string, data binary, is_text boolean")
    distinct = store.deduplicate(store.add_hashes(df))
    assert {(x.first_rel, x.refs) for x in distinct.collect()} == {("a.png", 2), ("c.css", 1), ("d.css", 1), ("e.bin", 1)}
    assert store.totals(distinct).head().resource_bytes == 4
    limits = spark.createDataFrame([("s", 0)], "site string, max_resource_size long")
    fits, over = store.within_limit(distinct, limits)
    assert (fits.count(), over.count()) == (4, 0)


def test_key_collisions(spark):
    hashes = ["aaaa1111", "aaaa2222", "aaaa1122", "bbbb0000"]
    df = spark.createDataFrame([("s", h, k) for k, h in enumerate(hashes)], "site string, hash string, ord long")
    got = {x.hash: x.key for x in store.assign_keys(df, 4, 2, 8).collect()}
    assert got == {"aaaa1111": "aaaa", "aaaa2222": "aaaa22", "aaaa1122": "aaaa11", "bbbb0000": "bbbb"}


def test_expand(spark):
    token = lambda k: store.PREFIX + k * 16
    rows = [("a", "text/css", f"x {token('b')} {token('c')} {token('9')}", True), ("b", "text/css", f"y {token('c')}", True), ("c", "image/png", "z", False), ("d", "text/css", token("e"), True), ("e", "text/css", token("d"), True)]
    df = spark.createDataFrame([("s", k * 16, m, bytearray(t.encode()), f) for k, m, t, f in rows], "site string, key string, mime string, data binary, is_text boolean")
    got = {x.key[0]: x.value for x in expansion.expand(df).collect()}
    from urllib.parse import quote

    url = lambda t: "data:text/css;charset=utf-8," + quote(t, safe="-_.!~*'()")
    c = "data:image/png;base64,eg=="
    assert got["c"] == c and got["b"] == url(f"y {c}")
    assert got["a"] == url(f"x {got['b']} {c} {token('9')}")
    # on a circle, a placeholder stays within the expansion of its own resource
    assert got["d"] == url(url(token("d"))) and got["e"] == url(url(token("e")))
    long = spark.createDataFrame([(bytearray(b"a" * 200),)], "d binary").select(store.base64_url(F.lit("m"), F.col("d"))).head()[0]
    assert "\n" not in long and "\r" not in long


def test_expand_equals_recursion(spark):
    from urllib.parse import quote

    edges = {"0": "12", "1": "3", "2": "34", "3": "", "4": "5", "5": "64", "6": "57", "7": "3", "8": "40"}
    data = {k: "|".join([k, *(store.PREFIX + t * 16 for t in to)]) for k, to in edges.items()}

    def value(key, active):
        parts = data[key].split("|")
        for n, t in enumerate(edges[key], 1):
            if t not in active | {key}:
                parts[n] = value(t, active | {key})
        return "data:text/css;charset=utf-8," + quote("|".join(parts), safe="-_.!~*'()")

    df = spark.createDataFrame([("s", k * 16, "text/css", bytearray(t.encode()), True) for k, t in data.items()], "site string, key string, mime string, data binary, is_text boolean")
    assert {x.key[0]: x.value for x in expansion.expand(df).collect()} == {k: value(k, frozenset()) for k in edges}



def resources_of(spark, rows):
    """Resources of one site from (name, text, is_text); a key is the name's digest."""
    return spark.createDataFrame([("s", key_of(k), "text/css" if f else "image/png", bytearray(t.encode()), f) for k, t, f in rows], "site string, key string, mime string, data binary, is_text boolean")


def key_of(name):
    import hashlib

    return hashlib.md5(name.encode()).hexdigest()[:16]


def token_of(name):
    return store.PREFIX + key_of(name)


def test_expansion_sizes_are_those_of_the_expanded_texts(spark):
    rng = random.Random(5)
    names = [f"t{k}" for k in range(9)]
    rows = [("pic", "z\u00e9?>" * 3, False)]
    for name in names:
        others = rng.choices([*names, "pic", "unknown"], k=rng.randrange(4))
        rows.append((name, " \u00e4%".join([name, *map(token_of, others), *map(token_of, others[:1])]), True))
    rows.append(("none", "", False))
    # extra columns change nothing, and null data counts as empty
    df = resources_of(spark, rows).withColumn("signs", F.lit("x")).withColumn("data", F.when(F.col("key") != key_of("none"), F.col("data")))
    values = {x.key: x.value for x in expansion.expand(df).collect()}
    sizes = {x.key: (x.bytes, x.refused) for x in expansion.expansion_sizes(df).collect()}
    assert sizes == {k: (len(v.encode()), False) for k, v in values.items()} and len(sizes) == 11
    assert expansion.expansion_sizes(df.limit(0)).count() == 0


def test_expansion_beyond_the_budget_is_refused(spark):
    size = lambda kept, signs: (23 + kept + 2 * signs, 5 + signs)  # noqa: E731 - of a data URL: what stays, what is escaped once more
    rows, want, kept, signs = [("l0", "x", True)], {}, 1, 0
    for level in range(1, 6):
        rows.append((f"l{level}", token_of(f"l{level - 1}") * 10, True))
    for level in range(6):
        value = size(kept, signs)
        refused = level > 0 and kept > 0 and sum(value) > 50_000
        want[f"l{level}"] = (sum(value), refused)
        kept, signs = (290, 0) if refused else (10 * value[0], 10 * value[1])
    ring = [f"c{k}" for k in range(12)]  # every one refers to all others: a thousand million paths
    rows += [(a, "".join(token_of(b) for b in ring if b != a), True) for a in ring] + [("big", "y" * 60_000, True), ("top", token_of("c0") + token_of("l1"), True)]
    df = resources_of(spark, rows)
    sizes = {x.key: (x.bytes, x.refused) for x in expansion.expansion_sizes(df, 50_000).collect()}
    assert {k: sizes[key_of(k)] for k in want} == want and want["l3"][1]
    assert all(sizes[key_of(c)][1] and sizes[key_of(c)][0] > 50_000 for c in ring) and sizes[key_of("big")] == (60_028, False)
    values = {x.key: x.value for x in expansion.expand(df, budget=50_000).collect()}
    assert {k: len(v) for k, v in values.items()} == {k: n for k, (n, refused) in sizes.items() if not refused}
    assert token_of("c0") in values[key_of("top")] and token_of("l1") not in values[key_of("top")]


def test_cut_edges_of_layers_and_first_met(spark):
    rows = [("s", f"{layer}.{a}", f"{layer + 1}.{b}", b) for layer in range(6) for a in range(3) for b in range(3)]
    rows += [("s", "x", "y", 1), ("s", "y", "x", 0), ("s", "6.0", "0.0", 0), ("t", "p", "q", 0), ("t", "q", "p", 0)]
    edges = spark.createDataFrame(rows, "site string, src string, dst string, seq long")
    roots = spark.createDataFrame([("s", "y", 0), ("s", "x", 1), ("s", "0.1", 2), ("s", "0.0", 3), ("t", "q", 0)], "site string, page string, ord long")
    sound, bad = graph.cut_back_edges(edges, roots)
    nexts, state, want = {}, {}, set()
    for site, src, dst, _ in sorted(rows, key=lambda r: (r[3], r[2])):
        nexts.setdefault((site, src), []).append(dst)

    def visit(site, node):  # the same walk by recursion
        state[site, node] = "open"
        for dst in nexts.get((site, node), []):
            if state.get((site, dst)) == "open":
                want.add((node, dst))
            elif (site, dst) not in state:
                visit(site, dst)
        state[site, node] = "done"

    for site, node in (("s", "y"), ("s", "0.1"), ("t", "q")):
        visit(site, node)
    assert {(x.src, x.dst) for x in bad.collect()} == want and {("x", "y"), ("p", "q"), ("0.0", "1.0")} < want
    assert sound.count() == len(rows) - len(want)


def test_frame_sizes_are_those_of_the_embedded_pages(spark):
    import html

    frames = {"a": ["b", "b", "c"], "b": ["c"], "c": ["d"], "d": [], "loop": ["loop"]}
    own = {k: f'<{k} "&' for k in frames}

    def whole(page, depth=0):
        return own[page] + "".join('x' * 8 + '""' + html.escape(whole(f, depth + 1)).replace("&#x27;", "'") for f in (frames[page] if depth < 8 else []))

    signs = lambda t: sum(t.count(c) for c in '&"<>')
    rows = [("s", k, len(t), len(html.escape(t)) - len(t), signs(t)) for k, t in own.items()]
    table = spark.createDataFrame(rows, "site string, page string, bytes long, escaped long, signs long")
    edges = spark.createDataFrame([("s", a, b, k) for a, many in frames.items() for k, b in enumerate(many)], "site string, src string, dst string, seq long")
    got = {r.page: (r.copies, r.bytes) for r in graph.frame_sizes(edges, table).collect()}
    assert got == {k: (got[k][0], len(whole(k))) for k in frames} and got["a"][0] == 9 and got["loop"][0] == 9
    many = spark.createDataFrame([("s", "a", "a", k) for k in range(1000)], "site string, src string, dst string, seq long")
    assert graph.frame_sizes(many, table.filter("page = 'a'")).head().bytes == graph.MOST_SIZE
