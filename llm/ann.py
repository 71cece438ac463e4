"""Approximate nearest neighbours with balanced posting lists (inverted lists in storage, centroids in memory).

Centroids come from a bounded sample that is halved again and again at the median, so every list gets as many
vectors of the sample.  A vector near a boundary is posted to every list whose centroid is almost as near as its nearest
one.  Tasks hold the centroids and a graph of near ones; a search walks the graph from a few entries and goes on
until every neighbour of what lies within the ratio (of a centroid's distance to the nearest one's), and of a fixed number of nearest ones, has been
seen; lists are pruned by that ratio.  Equal vectors are one posting, with as many of their ids as a result can hold.
Postings are shuffled by list, long lists in salted parts, and each part meets the
queries sent to its list, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved, Sent, settled_join

#: Bounds of the fit: vectors sampled, vectors a list is meant for, centroids at most.
SAMPLE, LIST_ROWS, MOST_LISTS = 20_000, 2_048, 2_500
#: Rows of a part of a list, and queries that meet it at a time.
PART_ROWS, QUERY_ROWS = 8_192, 8_192
LEAST_LISTS = 6
#: Neighbours of a centroid in the graph, centroids that a search starts from, and nearest seen ones that it goes on from at least.
DEGREE, ENTRIES, SEARCH = 16, 4, 16


def _halve(x: np.ndarray, parts: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Centroids of ``parts`` parts of equal size: split at the median between two means, again and again."""
    if parts <= 1 or len(x) < 2:
        return [x.mean(0)]
    a, b = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(6):
        side = x @ (a - b)
        near = side >= np.median(side)
        if near.all() or not near.any():
            near = np.arange(len(x)) < len(x) // 2
        a, b = x[near].mean(0), x[~near].mean(0)
    order = np.argsort(-(x @ (a - b)), kind="stable")
    first = parts // 2
    cut = max(1, min(len(x) - 1, round(len(x) * first / parts)))
    return _halve(x[order[:cut]], first, rng) + _halve(x[order[cut:]], parts - first, rng)


def centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    points = np.array(_halve(sample, lists, np.random.default_rng(11)))
    return points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)


class Graph:
    """Centroids and, for each, its nearest ones and its successor (so that all are connected)."""

    def __init__(self, points: np.ndarray):
        self.points, self.light = points, points.astype(np.float32)
        n, degree = len(points), min(DEGREE, len(points) - 1)
        dots = points @ points.T
        np.fill_diagonal(dots, -np.inf)
        near = np.argpartition(-dots, degree - 1, axis=1)[:, :degree] if degree else np.zeros((n, 0), np.int64)
        self.edges = np.column_stack([near, (np.arange(n) + 1) % n])
        self.entries = np.unique(np.linspace(0, n - 1, min(ENTRIES, n)).astype(int))


def near_lists(graph: Graph, x: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` (unit vectors) and lists they go to: all within ``ratio`` times the nearest centroid's distance, and ``least`` at least.

    A walk expands every seen centroid that is within the ratio or among the ``SEARCH`` nearest seen, once, so its
    length follows what the ratio selects and not the number of centroids.
    """
    n, some = len(graph.points), max(1, 2**20 // len(graph.points))
    least, wide = min(least, n), min(n, max(least, SEARCH))
    rows, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, len(x), some):
        part = x[low : low + some]
        light = part.astype(np.float32)
        far, todo, stamp = np.full((len(part), n), np.inf, np.float32), np.zeros((len(part), n), bool), np.zeros(len(part) * n, np.int64)
        new = (np.arange(len(part))[:, None] * n + graph.entries).ravel()
        while len(new):
            for cut in np.array_split(new, -(-len(new) // 65536)):
                far.ravel()[cut] = _distance(np.einsum("ij,ij->i", light[cut // n], graph.light[cut % n]))
            todo.ravel()[new] = True
            live = np.unique(new // n)
            there = far[live]
            walk = np.maximum(ratio * there.min(1), np.partition(there, wide - 1, axis=1)[:, wide - 1])
            row, list_ = np.nonzero(todo[live] & (there <= walk[:, None]))
            front = live[row] * n + list_
            todo.ravel()[front] = False
            new = ((front // n)[:, None] * n + graph.edges[front % n]).ravel()
            new = new[np.isinf(far.ravel()[new])]
            stamp[new] = np.arange(len(new))
            new = new[stamp[new] == np.arange(len(new))]  # each once
        bar = np.maximum(ratio * far.min(1), np.partition(far, least - 1, axis=1)[:, least - 1])
        row, list_ = np.nonzero(far <= bar[:, None])
        rows.append(row + low)
        lists.append(list_)
    return np.concatenate(rows), np.concatenate(lists)


def _distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * dots)) + 1e-9


def _unit(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, each scaled by a power of two so that no square overflows or vanishes, and as unit vectors."""
    lists = batch.column("vector")
    x = np.vstack([v.values.to_numpy(zero_copy_only=False) for v in lists]).astype(np.float64) if len(lists) else np.zeros((0, 1))
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def _post(sent, ratio: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                piece = batch.slice(low, 1024)
                _, unit = _unit(piece)
                rows, lists = near_lists(sent.value, unit, ratio, least)
                yield pa.RecordBatch.from_arrays([pa.array(lists), *piece.take(pa.array(rows)).columns], ["list", *piece.schema.names])

    return run


def _nearest(k: int):
    kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}

    def run(posts: pa.Table, asks: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(posts) and len(asks):
            p, _ = _unit(posts.combine_chunks().to_batches()[0])
            q, _ = _unit(asks.combine_chunks().to_batches()[0])
            held, queries = posts["ids"].combine_chunks(), asks["id"].to_numpy()
            ids, ends = held.flatten().to_numpy(), np.append(0, np.cumsum(held.value_lengths().to_numpy()))
            norm = np.sqrt((p * p).sum(1))
            alone, lone = ids[ends[:-1]], np.diff(ends) == 1
            extra = len(ids) - len(np.unique(ids))  # so many of the best rows may repeat an id
            for low in range(0, len(q), 256):
                rough = (q[low : low + 256] @ p.T) / norm
                rough[(queries[low : low + 256][:, None] == alone) & lone] = -np.inf
                few = max(0, len(p) - k - extra)
                bar = np.partition(rough, few, axis=1)[:, few]
                for row, (one, least) in enumerate(zip(q[low : low + 256], bar, strict=True)):
                    near = np.flatnonzero((rough[row] >= least - 1e-9 * np.sqrt(one @ one)) & np.isfinite(rough[row]))
                    score = np.repeat((p[near] * one).sum(1) / (norm[near] * np.sqrt((one * one).sum())), ends[near + 1] - ends[near])
                    found = np.concatenate([ids[ends[r] : ends[r + 1]] for r in near]) if len(near) else ids[:0]
                    score, found = score[found != queries[low + row]], found[found != queries[low + row]]
                    order = np.lexsort((found, -score))
                    order = order[np.sort(np.unique(found[order], return_index=True)[1])][:k]
                    out[0].extend([queries[low + row]] * len(order))
                    out[1].extend(found[order])
                    out[2].extend(score[order])
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds.values(), strict=True)], names=list(kinds))

    return run


def usable(vectors: DataFrame, id_col: str, vector: str, size: int | None = None) -> tuple[DataFrame, int]:
    """id and vector (array of doubles) of the rows that can take part: of ``size`` (the commonest dimension if None), finite and not zero; and that size."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter("id is not null and vector is not null")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.filter(fine)
    if size is None:
        common = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        size = common[0].n if common else 0
    return rows.filter(F.size(v) == size), size


def folded(rows: DataFrame, most: int) -> DataFrame:
    """ids and vector: one row for each distinct vector of ``rows(id, vector)``, with its ``most`` smallest ids (ascending, each once).

    Vectors are told apart by two seeded 64-bit hashes.  Only ids and hashes are shuffled: repeated ones are counted before the shuffle and
    each task sends at most ``most`` ids of a vector.  Vectors move only where more than one row holds them.
    """
    rows = rows.withColumn("same", F.concat(F.hex(F.xxhash64("vector")), F.lit("."), F.hex(F.xxhash64(F.lit(1), "vector"))))
    each = rows.groupBy("same", "id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("same").orderBy("id")
    few = each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    groups = few.groupBy("same").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.sum("n").alias("n")).filter("n > 1")
    groups = saved(groups.select("same", "ids"))
    both = settled_join(rows, groups, "same", "left")
    single = both.filter("ids is null").select(F.array("id").alias("ids"), "vector")
    first = both.filter("id = ids[0]").groupBy("same").agg(F.first("ids").alias("ids"), F.first("vector").alias("vector"))
    done = saved(single.unionByName(first.select("ids", "vector")))
    discard(groups)
    return done


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", post_ratio: float = 1.03, ask_ratio: float = 1.3) -> DataFrame:
    """The ``k`` vectors of largest cosine that the lists give for each row of ``queries``, its own id excepted.

    Returns query_id, rank (from 1), vec_id and score, computed in double precision on the vectors as given; ties go to the smaller
    vec_id.  Null ids, and vectors that are null, zero, of another than the commonest dimension of ``vectors`` or with null or non-finite parts take no part, on either side.
    Rows with the same id count as one candidate, with its best score; equal vectors are posted once.  Fewer candidates than ``k`` are all returned; an empty table on either side
    gives an empty result; other columns are ignored, whatever their names.  With ``ask_ratio`` infinite every list is asked and the result is exact.
    """
    spark = vectors.sparkSession
    rows, size = usable(vectors, id_col, vector)
    rows = folded(rows, k + 1)  # the k smallest ids of a vector other than the query's own rank before all its others
    asks, _ = usable(queries, id_col, vector, size)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.filter(F.pmod(F.xxhash64("ids"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))).select("vector").toArrow()
    if not len(sample):
        sample = rows.limit(1).select("vector").toArrow()
    x, _ = _unit(sample.combine_chunks().to_batches()[0])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sent = Sent(spark, Graph(centroids(x, int(min(MOST_LISTS, max(1, n // LIST_ROWS), max(1, len(x) // 8))))))
    posts = saved(rows.mapInArrow(_post(sent, post_ratio, 1), "list long, ids array<long>, vector array<double>"))
    asked = asks.mapInArrow(_post(sent, ask_ratio, LEAST_LISTS), "list long, id long, vector array<double>")
    parts = posts.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("blocks"))
    wide = F.broadcast(parts.join(blocks, "list"))  # one row for each list, of which there are MOST_LISTS at most
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = posts.join(wide, "list").select("list", F.pmod(F.xxhash64("ids"), "parts").alias("part"), upto("blocks").alias("block"), "ids", "vector")
    right = asked.join(wide, "list").select("list", upto("parts").alias("part"), F.pmod(F.xxhash64("id"), "blocks").alias("block"), "id", "vector")
    found = left.groupBy("list", "part", "block").cogroup(right.groupBy("list", "part", "block")).applyInArrow(_nearest(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
