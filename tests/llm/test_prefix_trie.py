import hashlib
import random
import zlib

from llm.prefix_trie import NODE, conversations, paths, prefix_trie
from llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string, path int, words int, shard int"


def brute(convs):
    """``convs``: id -> list of (role, text)."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, out = {}, []
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(below[k][0] for k in kids.get(node, [])) or 1
        saved = sum(below[k][1] for k in kids.get(node, [])) + ((len(members[node]) - 1) * len(node[-1][1].split()) if node else 0)
        below[node] = (leaves, saved)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(convs[c]) == len(node))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids.get(node, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(spark, convs):
    turns = [(c, k, r, t, 1, 2, 3) for c, many in convs.items() for k, (r, t) in enumerate(many)]
    random.Random(0).shuffle(turns)
    return spark.createDataFrame(turns, TURNS)


def built(spark, convs, **options):
    return sorted((tuple(r) for r in prefix_trie(paths(conversations(rows(spark, convs))), **options).select(*NODE).collect()), key=str)


def test_random_tries_as_brute_force(spark):
    r = random.Random(4)
    for choices, most, count in [("ab", 6, 300), ("abcdef", 3, 200), ("a", 9, 60)]:
        convs = {r.randrange(-5, 10**6): [(r.choice("us"), r.choice(choices) + " x" * r.randrange(2)) for _ in range(r.randrange(1, most + 1))] for _ in range(count)}
        assert built(spark, convs, shard_turns=7) == brute(convs)


def test_many_copies_and_paths_longer_than_splitters(spark):
    long = [("u", f"t {k}") for k in range(90)]
    convs = {k: [("s", "same"), ("u", "q w e")] for k in range(1500)} | {2000 + k: long[: 60 + k] for k in range(31)} | {3000 + k: long for k in range(300)} | {4000 + k: [("s", "same"), ("u", f"own {k}")] for k in range(200)}
    assert built(spark, convs, shard_turns=300) == brute(convs)


def test_turns_in_order_with_nulls_repeats_and_ids_missing(spark):
    turns = [(1, 2, "u", "b", 0, 0, 0), (1, None, None, "a", 0, 0, 0), (1, 2, "u", "b", 0, 0, 0), (None, 1, "u", "lost", 0, 0, 0), (2, -1, "", "a", 0, 0, 0), (2, 5, "u", None, 0, 0, 0)]
    got = prefix_trie(paths(conversations(spark.createDataFrame(turns, TURNS)))).select(*NODE).collect()
    assert sorted(map(tuple, got), key=str) == brute({1: [("", "a"), ("u", "b"), ("u", "b")], 2: [("", "a"), ("u", "")]})


def test_role_and_text_are_kept_apart(spark):
    convs = {1: [("a", "bc")], 2: [("ab", "c")], 3: [("a", "bc")]}
    assert built(spark, convs) == brute(convs)


def test_no_conversations(spark):
    assert prefix_trie(paths(conversations(spark.createDataFrame([], TURNS)))).count() == 0


def test_query_rebuilds_conversations(spark, tmp_path):
    r = random.Random(9)
    own = {c: [(r.choice("us"), r.choice("xyz")) for _ in range(r.randrange(1, 5))] for c in r.sample(range(200), 90)}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert any(not t for t in convs.values())
    rows(spark, own).write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((tuple(x) for x in QUERIES["op13_prefix_trie"](spark, str(tmp_path)).select(*NODE).collect()), key=str) == brute(convs)
