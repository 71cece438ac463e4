"""Prefix trie of conversations: which beginnings are shared, by how many, and what a cache of them would save.

A conversation is a path: 16 bytes for each turn.  Paths are dealt to shards by range, between splitters (path, id) drawn from a sample, so that
copies of one path are split by their ids.  The prefixes of the splitters are the skeleton, which is broadcast: any other node has all its members in
one shard, and the shard, sorted, finishes it.  Of skeleton nodes shards give parts, which are added up; the skeleton's own sums follow from them.

Bounds: there are at most ``MOST_SHARDS`` splitters of at most ``SPLIT_TURNS`` turns, so the skeleton has at most about a million nodes whatever the
input.  Copies of a conversation longer than that come to one shard, which reads them one at a time.  A shard keeps its distinct nodes, a few
numbers each, and a row holds a whole conversation: 16 bytes and a number for each turn.  Turns are told apart by MD5.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sent, numbered, saved

KEY = 16
MOST_SHARDS, SPLIT_TURNS, SHARD_TURNS, SAMPLE = 16_384, 64, 500_000, 40
CHUNK = 1 << 18  # bytes of ids in one part of a skeleton node's list
LEAST = -(1 << 63)
WORD = r"[^\x20\x09-\x0D]+"
SHARD_ROWS = "skel long, parent_skel long, shard int, chunk int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends binary, ends_sha256 string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` as (conv_id, turns), an array of (turn, key, words) in order of turn, null first, then of key.

    A null role or text is empty; repeated turns stay; rows without conv_id are left out.  Other columns are not looked at.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def paths(convs: DataFrame, turns: Column | None = None) -> DataFrame:
    """(conv_id, path, words) of ``conversations``, or of other arrays of turns."""
    turns = F.col("turns") if turns is None else turns
    path = F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["key"])), ""))
    return convs.select("conv_id", path.alias("path"), F.transform(turns, lambda t: t["words"]).alias("words"))


class Skeleton:
    """The trie of the splitters' paths: node 0 is the root, and a child is found by its parent and key."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters, self.child, self.parent, self.depth = splitters, {}, [-1], [0]
        for path, _ in splitters:
            node = 0
            for k in range(0, len(path), KEY):
                at = (node, path[k : k + KEY])
                if at not in self.child:
                    self.child[at] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[at]


class _Shard:
    """The trie of one shard's paths, given in order; ``rows`` yields its finished nodes and its parts of skeleton nodes."""

    def __init__(self, number: int, child: dict):
        self.number, self.child, self.path, self.stack, self.chunks, self.parts = number, child, b"", [0], [], 0
        self.parent, self.depth, self.skel, self.words = array("q", [-1]), array("q", [0]), array("q", [0]), array("q", [0])
        self.n, self.least = array("q", [0]), array("q", [LEAST])
        self.ends, self.hash, self.text = {}, None, bytearray()

    def add(self, path: bytes, words, conv: int) -> None:
        same, most = 0, min(len(path), len(self.path))
        while same < most and path[same : same + KEY] == self.path[same : same + KEY]:
            same += KEY
        if same < len(path) or same < len(self.path):
            self.close()
            del self.stack[same // KEY + 1 :]
            for k in range(same, len(path), KEY):
                above = self.stack[-1]
                self.stack.append(len(self.n))
                self.parent.append(above)
                self.depth.append(k // KEY + 1)
                self.skel.append(self.child.get((self.skel[above], path[k : k + KEY]), -1) if self.skel[above] >= 0 else -1)
                self.words.append(words[k // KEY].as_py())
                self.n.append(0)
                self.least.append(LEAST)
            self.path = path
        node = self.stack[-1]
        if not self.n[node]:
            self.least[node] = conv
        self.n[node] += 1
        self.text += b",%d" % conv
        if len(self.text) >= CHUNK:
            self.flush()

    def flush(self) -> None:
        node, text = self.stack[-1], bytes(self.text)
        self.text.clear()
        if not text:
            return
        if self.skel[node] >= 0:
            self.chunks.append((self.skel[node], self.parts, text[1:]))
            self.parts += 1
        elif self.hash is None:
            self.hash = hashlib.sha256(text[1:])
        else:
            self.hash.update(text)

    def close(self) -> None:
        """The list of the path at hand is whole."""
        self.flush()
        if self.hash is not None:
            self.ends[self.stack[-1]], self.hash = self.hash.hexdigest(), None

    def rows(self) -> Iterator[tuple]:
        self.close()
        size, none = len(self.n), hashlib.sha256().hexdigest()
        n, least, parent, skel = self.n, self.least, self.parent, self.skel
        children, leaves, saved_tokens = (array("q", bytes(8 * size)) for _ in range(3))
        for i in range(size - 1, -1, -1):
            if skel[i] < 0:
                leaves[i] = leaves[i] or 1
                saved_tokens[i] += (n[i] - 1) * self.words[i]
            p = parent[i]
            if p >= 0:
                # A node's first member in order of ids may be any of its subtree's.
                least[p] = least[i] if not n[p] else min(least[p], least[i])
                n[p] += n[i]
                if skel[i] < 0:
                    children[p] += 1
                    leaves[p] += leaves[i]
                    saved_tokens[p] += saved_tokens[i]
        for i in range(size):
            if skel[i] >= 0:
                yield (skel[i], None, self.number, None, least[i], self.depth[i], None, n[i], children[i], leaves[i], saved_tokens[i], self.words[i], None, None)
            else:
                above = skel[parent[i]]
                yield (None, above if above >= 0 else None, self.number, None, least[i], self.depth[i], None if above >= 0 else least[parent[i]], n[i], children[i], leaves[i], saved_tokens[i], None, None, self.ends.get(i, none))
        for node, chunk, text in self.chunks:
            yield (node, None, self.number, chunk, None, None, None, None, None, None, None, None, text, None)


def _batches(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most or (row[-2] and len(held) > 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)


def _splitters(rows: DataFrame, count: int, shards: int) -> list[tuple[bytes, int]]:
    """Up to ``shards`` - 1 evenly spaced (path, conv_id) of a sample; a path longer than SPLIT_TURNS is cut and comes before all that begin with it."""
    part = min(1.0, SAMPLE * shards / max(count, 1))
    some = rows.filter(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 20)) < int(part * (1 << 20))).select("conv_id", F.substring("path", 1, SPLIT_TURNS * KEY).alias("path"), (F.length("path") > SPLIT_TURNS * KEY).alias("cut"))
    ranked = saved(numbered(some, F.col("path"), F.col("conv_id")))
    m = max(ranked.count(), 1)
    piece = lambda at: F.floor(at * shards / F.lit(m))
    picked = ranked.filter((F.col("index") > 0) & (piece(F.col("index")) != piece(F.col("index") - 1))).select("path", "cut", "conv_id")
    return sorted({(bytes(r.path), LEAST if r.cut else r.conv_id) for r in picked.toLocalIterator()})


def prefix_trie(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each distinct prefix of the paths of ``rows(conv_id, path, words)``, conv_id being distinct and not null.

    conv_id (the smallest member's), depth, parent_conv_id (the smallest member of the parent; null for the root), n_convs (members: conversations that
    begin so), n_children, n_leaves (childless nodes in the subtree, the node included), saved_tokens (over the subtree, words of a node's last turn
    times its members but one) and ends_sha256 (of the ids of conversations that end there, ascending, with commas between).  The root has no text and
    every conversation is its member, also one without turns; no conversations give no rows.
    """
    spark = rows.sparkSession
    rows = saved(rows)
    count, turns = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    shards = min(MOST_SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(turns + count) // shard_turns)))
    skeleton = Skeleton(_splitters(rows, count, shards))
    sent = Sent(spark, skeleton)
    shards = len(skeleton.splitters) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = sent.value.splitters
        for b in batches:
            at = [bisect_right(splitters, key) for key in zip(b["path"].to_pylist(), b["conv_id"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *b.columns], ["shard", *b.schema.names])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        child = sent.value.child

        def found() -> Iterator[tuple]:
            now = None
            for b in batches:
                for shard, conv, path, words in zip(b["shard"].to_pylist(), b["conv_id"].to_pylist(), b["path"].to_pylist(), b["words"]):
                    if now is None or shard != now.number:
                        if now is not None:
                            yield from now.rows()
                        now = _Shard(shard, child)
                    now.add(path, words, conv)
            if now is not None:
                yield from now.rows()

        big, small, text = pa.int64(), pa.int32(), pa.string()
        yield from _batches(found(), [big, big, small, small, *[big] * 8, pa.binary(), text], [c.split()[0] for c in SHARD_ROWS.split(", ")])

    dealt = rows.select("conv_id", "path", "words").mapInArrow(deal, "shard int, conv_id long, path binary, words array<int>")
    sorted_rows = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    made = saved(sorted_rows.mapInArrow(walk, SHARD_ROWS))
    nodes, parts = made.filter("skel is null"), made.filter("skel is not null")
    top = _finished(spark, skeleton, parts)
    above = top.select(F.col("skel").alias("parent_skel"), F.col("conv_id").alias("_above"))
    below = nodes.join(F.broadcast(above), "parent_skel", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    return below.select(*NODE).unionByName(top.select(*NODE))


def _finished(spark, skeleton: Skeleton, parts: DataFrame) -> DataFrame:
    """Skeleton nodes (skel and the columns of NODE): parts added up by Spark, then sums over the bounded skeleton, children before parents."""
    sums = parts.filter("n_convs is not null").groupBy("skel").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("words").alias("words"))
    have = {r["skel"]: r for r in sums.toArrow().to_pylist()}
    total = {k: [r["n_children"], r["n_leaves"], r["saved_tokens"] + (r["n_convs"] - 1) * r["words"]] for k, r in have.items()}
    for k in sorted(have, reverse=True):  # a child's number is larger than its parent's
        total[k][1] = total[k][1] or 1
        up = skeleton.parent[k]
        if up >= 0:
            total[up][0] += 1
            total[up][1] += total[k][1]
            total[up][2] += total[k][2]
    order = sorted(have)
    column = lambda f: pa.array([f(k) for k in order], pa.int64())
    up = lambda k: have[skeleton.parent[k]]["conv_id"] if k else None
    table = pa.table({"skel": column(int), "conv_id": column(lambda k: have[k]["conv_id"]), "depth": column(lambda k: skeleton.depth[k]), "parent_conv_id": column(up), "n_convs": column(lambda k: have[k]["n_convs"]),
                      "n_children": column(lambda k: total[k][0]), "n_leaves": column(lambda k: total[k][1]), "saved_tokens": column(lambda k: total[k][2])})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(node, state):
            return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()])], ["skel", "sha"])

        node, state = None, None
        for b in batches:
            for skel, text in zip(b["skel"].to_pylist(), b["ends"]):
                if skel != node:
                    if node is not None:
                        yield done(node, state)
                    node, state = skel, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.as_py())
        if node is not None:
            yield done(node, state)

    lists = parts.filter("ends is not null").select("skel", "shard", "chunk", "ends").repartition("skel").sortWithinPartitions("skel", "shard", "chunk")
    hashes = saved(lists.mapInArrow(digests, "skel long, sha string"))
    top = spark.createDataFrame(table).join(F.broadcast(hashes), "skel", "left")
    return top.withColumn("ends_sha256", F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())))
