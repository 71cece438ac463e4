"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so a document's own Jaccard similarity with an item says nothing.
Items are partitioned by their number of shingles into powers of two; for each size class documents are seen
as overlapping windows of two adjacent runs of the class's upper bound, at most four times the item's size s.
Window and item are compared by ``HASHES`` MinHashes in bands of one.  This finds an item wherever its shingles lie:
a hash hits when the item's smallest shingle is in the document and is the smallest of its window too, of which the
chance, summed over the held shingles (at least 4 s / 5, each in a window that has at most 5 s shingles together with the item),
is at least 0.16 a hash.  So a true match, even one scattered in pieces over the document, is missed with a
probability of at most 0.84 ** 64, 15 in a million, and one held in a run with under two in a million.
Each (document, item) found is verified by exact shingle containment over the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, Sent, tidy
from .textkit import blocks, distinct_shingles, shingle_hashes, word_hashes, word_spans

HASHES = 64
#: Bytes of an index, which is what is broadcast for one pass over the documents; an item takes its signature, 8 to 16 marks of
#: a byte for each hash, and a hash for each shingle.
INDEX_BYTES = 48 << 20
_FACTORS = np.random.default_rng(77).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Index:
    """Signatures of a block of items by size class."""

    def __init__(self, ids: list[int], texts: pa.Array, n: int):
        kept = [(i, s) for i, s in zip(ids, distinct_shingles(texts, n), strict=True) if len(s) and i is not None]
        self.ids, self.sets = [i for i, _ in kept], [s for _, s in kept]
        self.classes: dict[int, list] = {}
        for k, s in enumerate(self.sets):
            self.classes.setdefault(max(1, (len(s) - 1).bit_length()), []).append(k)
        self.tables = {}
        for size, members in self.classes.items():
            mask = np.uint64((1 << max(8, 3 + (len(members) - 1).bit_length())) - 1)
            for h in range(HASHES):
                low = np.array([(self.sets[k] * _FACTORS[h]).min() for k in members], np.uint64)
                order = np.argsort(low)
                hint = np.zeros(int(mask) + 1, bool)
                hint[low & mask] = True
                self.tables[size, h] = (low[order], np.array(members, np.int32)[order], hint, mask)


def _search(index, n: int, num: int, den: int):
    def candidates(found: Index, hashes: np.ndarray, begin: np.ndarray) -> set[tuple[int, int]]:
        counts = np.diff(begin)
        sizes = sorted(found.classes)
        runs = np.maximum(1, -(-counts // (1 << sizes[0]))) * (counts > 0)
        base = np.concatenate(([0], np.cumsum(runs)))
        within = np.arange(base[-1]) - np.repeat(base[:-1], runs)
        edges = np.repeat(begin[:-1], runs) + within * (1 << sizes[0])
        layout, bounds, per_doc = [], None, runs
        for k, size in enumerate(sizes):
            if k:
                step = 1 << (size - sizes[k - 1])
                fewer = -(-per_doc // step)
                start = np.concatenate(([0], np.cumsum(per_doc)))[:-1]
                inside = np.arange(fewer.sum()) - np.repeat(np.concatenate(([0], np.cumsum(fewer)))[:-1], fewer)
                bounds, per_doc = np.repeat(start, fewer) + inside * step, fewer
            docs = np.repeat(np.arange(len(counts)), per_doc)
            layout.append((size, bounds, docs))
        pairs = set()
        for h in range(HASHES):
            low = np.minimum.reduceat(hashes * _FACTORS[h], edges)
            for size, bounds, docs in layout:
                if bounds is not None:
                    low = np.minimum.reduceat(low, bounds)
                window = low.copy()
                same = docs[1:] == docs[:-1]
                window[:-1][same] = np.minimum(low[:-1], low[1:])[same]
                lows, members, hint, mask = found.tables[size, h]
                maybe = np.flatnonzero(hint[window & mask])
                a, b = np.searchsorted(lows, window[maybe], "left"), np.searchsorted(lows, window[maybe], "right")
                hit = b > a
                for w, low_at, high_at in zip(maybe[hit], a[hit], b[hit], strict=True):
                    pairs.update((int(docs[w]), int(m)) for m in members[low_at:high_at])
        return pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in batches:
            out = [[], [], [], []]
            for low, _, data, at in blocks(batch.column(1)):
                starts, ends, first = word_spans(data, at)
                hashes, begin = shingle_hashes(word_hashes(data, starts, ends), first, n)
                if not len(hashes) or not found.sets:
                    continue
                whole = {}
                for doc, item in sorted(candidates(found, hashes, begin)):
                    if doc not in whole:
                        whole = {doc: np.unique(hashes[begin[doc] : begin[doc + 1]])}
                    own = whole[doc]
                    wanted = found.sets[item]
                    shared = int((own[np.minimum(np.searchsorted(own, wanted), len(own) - 1)] == wanted).sum())
                    if den * shared >= num * len(wanted):
                        for column, value in zip(out, (batch.column(0)[low + doc].as_py(), found.ids[item], shared, len(wanted)), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "item_id", "shared", "item_shingles"])

    return run


def contained_items(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Pairs of a document and a test item at least num / den of whose distinct n-word shingles the document holds.

    Returns doc_id, item_id, shared and item_shingles (longs).  Null and blank texts hold nothing and are held
    by nothing; an item of fewer than n words matches only a document that is that sequence and nothing else.
    A match is missed with a probability of at most 15 in a million, however its pieces are scattered over the document; none is found wrongly.
    Texts are searched whole, however long.  Repeated document rows give repeated pairs, items without item_id take no part, and an empty table of
    either kind gives no pairs.  Other columns are ignored, whatever their names.  Items are searched in blocks whose indexes take about INDEX_BYTES, one pass over
    the documents for each.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col(item_text).alias("item_text"))
    volume = items.agg(F.sum(2 * F.coalesce(F.octet_length("item_text"), F.lit(0)) + 28 * HASHES)).head()[0] or 0  # a shingle for each two letters at most
    passes = max(1, -(-volume // INDEX_BYTES))
    found = None
    for k in range(passes):
        block = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).toArrow()
        index = Sent(spark, Index(block["item_id"].to_pylist(), block["item_text"].combine_chunks(), n))
        one = docs.select("doc_id", text).mapInArrow(tidy(_search(index, n, num, den)), "doc_id long, item_id long, shared long, item_shingles long")
        found = one if found is None else found.union(one)
    return found


def without_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a test item; rows without a doc_id are kept."""
    held = saved(contained_items(docs, items, **options).select("doc_id").distinct())
    return docs.join(held, "doc_id", "left_anti").select(*docs.columns)
