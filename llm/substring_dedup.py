"""Removal of repeated substrings, found with suffix arrays built by two-stage sorting.

A byte goes when a ``LENGTH``-byte string that covers it also starts earlier in the corpus.  Sorting every suffix of a
corpus would shuffle each byte a hundred times, so only what can repeat is sorted:

1. Exact copies of an earlier text are settled by a digest; they are covered whole.
2. Every LENGTH-byte string contains an anchor, the leftmost least hash of its K-byte pieces, chosen by content alone.
   An anchor with all the bytes that share a string with it is its context.  Contexts equal to an earlier one
   are covered whole; this needs only hashes, first within a task, then between tasks by anchor.
3. Contexts of one anchor that differ (at the ends of repeated passages) are compared by their bytes: each task builds
   the suffix array of its contexts.  Only suffixes smaller than their successors are sorted directly; the others are
   induced by scans over the character buckets.  Neighbours with a common prefix of LENGTH bytes are repeats.
4. Covered spans are merged for each document, and the rest of its bytes is what is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .textkit import _BYTE, _power_tables, blocks, mix

LENGTH, K = 100, 48
REACH = LENGTH - K
#: Anchors a task looks through for copies at a time, and anchors meant for one partition of the shuffle.
CHUNK, PARTITION = 1 << 20, 400_000
#: Bytes of ids of exact copies that are broadcast; beyond it that join shuffles.
BROADCAST_BYTES = 24 << 20


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of the runs of ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts in one buffer: row, position and hash of each anchor, a hash of its context, and the context's first byte and end (in the text).

    All pieces that equal the least of some window are anchors, so ties in repetitive text are kept; that only adds anchors.
    """
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    rows, places = [], []
    pieces = mix((sums[K:] - sums[:-K]) * down[: len(data) + 1 - K]) if len(data) >= K else np.zeros(0, np.uint64)
    for row in np.flatnonzero(np.diff(at) >= LENGTH):
        own = pieces[at[row] : at[row + 1] - K + 1]
        low = _least(own, REACH + 1)
        where = np.flatnonzero(own == _greatest(low, len(own)))
        rows.append(np.full(len(where), row))
        places.append(where)
    rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    places = np.concatenate(places) if places else np.zeros(0, np.int64)
    size = np.diff(at)[rows]
    begin, end = np.maximum(places - REACH, 0), np.minimum(places + LENGTH, size)
    hashes = pieces[at[rows] + places] if len(rows) else np.zeros(0, np.uint64)
    base = at[rows]
    context = mix(mix((sums[base + end] - sums[base + begin]) * down[base + begin]) + (end - begin).astype(np.uint64) * np.uint64(1 << 20) + (places - begin).astype(np.uint64)) if len(rows) else hashes
    return rows, places, hashes, context, begin, end


def _greatest(low: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` pieces, the greatest minimum of the windows that contain it."""
    padded = np.concatenate((np.zeros(REACH, np.uint64), low, np.zeros(REACH, np.uint64)))
    return ~_least(~padded, REACH + 1)[:n]


def _merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document with overlapping and touching ones joined."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    fresh = np.concatenate(([True], doc[1:] != doc[:-1]))
    group = np.cumsum(fresh) - 1
    offset = group * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + offset) - offset
    head = fresh | np.concatenate(([True], start[1:] > reach[:-1]))
    at = np.flatnonzero(head)
    return doc[at], start[at], np.maximum.reduceat(end, at)


_FOUND = "bucket int, anchor long, context long, doc long, place int, start int, stop int"


def _batch(bucket, anchor, context, doc, place, start, stop) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(c), t) for c, t in zip((bucket, anchor, context, doc, place, start, stop), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "anchor", "context", "doc", "place", "start", "stop"])


def _spans_batch(doc, start, stop, buckets: int) -> pa.RecordBatch:
    """Covered spans travel with the anchors; they have no anchor and place -1."""
    zero = np.zeros(len(doc), np.int64)
    return _batch((doc % buckets).astype(np.int32), zero, zero, doc, zero - 1, start, stop)


def _split_copies(anchor, context, doc, place, start, stop):
    """Order contexts, the same place of a repeated row once; which of them equal an earlier one."""
    order = np.lexsort((place, doc, context, anchor))
    if len(order):
        order = order[np.concatenate(([True], np.logical_or.reduce([np.diff(x[order]) != 0 for x in (anchor, context, doc, place)])))]
    anchor, context, doc, place, start, stop = (x[order] for x in (anchor, context, doc, place, start, stop))
    copy = np.concatenate(([False], (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1]))) if len(anchor) else np.zeros(0, bool)
    return copy, anchor, context, doc, place, start, stop


def _find_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            copy, *columns = _split_copies(*(np.concatenate([h[k] for h in held]) for k in range(6)))
            anchor, context, doc, place, start, stop = columns
            yield _spans_batch(*_merge(doc[copy], start[copy].astype(np.int64), stop[copy].astype(np.int64)), buckets)
            new = ~copy
            bucket = (anchor[new].view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            yield _batch(bucket, anchor[new], context[new], doc[new], place[new], start[new], stop[new])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for low, _, data, at in blocks(batch.column(1)):
                rows, place, anchor, context, start, stop = anchors(data, at)
                held.append((anchor.view(np.int64), context.view(np.int64), ids[low + rows], place.astype(np.int32), start.astype(np.int32), stop.astype(np.int32)))
                size += len(rows)
                if size >= CHUNK:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return run


def _match_contexts(buckets: int):
    """Of all anchors of some buckets: spans of contexts equal to an earlier one, and the first of each context of anchors with several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            span = batch.column(4).to_numpy() < 0
            if span.any():
                yield batch.filter(pa.array(span))
            held.append([batch.column(k).to_numpy()[~span] for k in range(1, 7)])
        if not held:
            return
        copy, anchor, context, doc, place, start, stop = _split_copies(*(np.concatenate([h[k] for h in held]) for k in range(6)))
        del held
        yield _spans_batch(*_merge(doc[copy], start[copy].astype(np.int64), stop[copy].astype(np.int64)), buckets)
        new = ~copy
        anchor, context, doc, place, start, stop = (x[new] for x in (anchor, context, doc, place, start, stop))
        several = np.zeros(len(anchor), bool)
        if len(anchor):
            same = anchor[1:] == anchor[:-1]
            several[1:] |= same
            several[:-1] |= same
        yield _batch((anchor[several].view(np.uint64) % np.uint64(buckets)).astype(np.int32), anchor[several], context[several], doc[several], place[several], start[several], stop[several])

    return run


_CONTEXT = "anchor long, doc long, start int, bytes binary"


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], [], []]
        for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            data = (text.as_py() or "").encode()
            for one in wanted.as_py():
                for column, value in zip(out, (one["anchor"], doc, one["start"], data[one["start"] : one["stop"]]), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["anchor", "doc", "start", "bytes"])


def suffix_order(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Cells (row * width + column) of all suffixes of LENGTH bytes or more, in the order of their first LENGTH bytes.

    ``rows`` holds one string in each row, of ``size`` bytes and padded with zeros by eight at least; a string goes on as zeros.
    """
    n, width = rows.shape
    smaller, run = np.ones((n, width), bool), np.ones((n, width), np.int16)  # smaller than its successor; length of the run of equal bytes
    for c in range(width - 2, -1, -1):
        same = rows[:, c] == rows[:, c + 1]
        smaller[:, c] = np.where(same, smaller[:, c + 1], rows[:, c] < rows[:, c + 1])
        run[:, c] = np.where(same, run[:, c + 1] + 1, 1)
    need = np.arange(width)[None, :] <= (size - LENGTH)[:, None]
    for c in range(width - 1):
        of = np.flatnonzero(need[:, c] & ~smaller[:, c])
        need[of, c + run[of, c]] = True
    flat, whole = rows.ravel(), np.zeros(n * width + 8, np.uint64)
    padded = np.concatenate((flat, np.zeros(8, np.uint8))).astype(np.uint64)
    for k in range(8):
        whole[: n * width] |= padded[k : k + n * width] << np.uint64(56 - 8 * k)

    cells = np.flatnonzero((need & smaller).ravel())
    end = (cells // width) * width + width - 8
    at = lambda cell, depth, last: np.where(cell + depth <= last, whole[np.minimum(cell + depth, last)], np.uint64(0))
    order = np.argsort(whole[cells], kind="stable")
    cells, end = cells[order], end[order]
    key = whole[cells]
    group = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) if len(cells) else cells
    open_ = np.arange(len(cells))
    for depth in range(8, LENGTH + 8, 8):
        own = group[open_]
        tied = np.zeros(len(open_), bool)
        if len(open_):
            same = own[1:] == own[:-1]
            tied[1:] |= same
            tied[:-1] |= same
        open_ = open_[tied]
        if not len(open_):
            break
        key, own = at(cells[open_], depth, end[open_]), group[open_]
        if (key[1:] < key[:-1])[own[1:] == own[:-1]].any():
            order = np.lexsort((key, own))
            cells[open_], end[open_], key = cells[open_][order], end[open_][order], key[order]
        new = np.concatenate(([False], (key[1:] != key[:-1]) & (own[1:] == own[:-1])))
        step = np.zeros(len(cells), np.int64)
        step[open_[new]] = 1
        group = group + np.cumsum(step)

    rank = np.zeros(n * width, np.int64)
    induced = np.flatnonzero((need & ~smaller).ravel())
    induced = induced[np.argsort(flat[induced], kind="stable")]
    low_s, low_l = np.searchsorted(flat[cells], np.arange(257)), np.searchsorted(flat[induced], np.arange(257))
    out, placed = [], 0
    for c in range(256):
        mine = induced[low_l[c] : low_l[c + 1]]
        if len(mine):
            length = run.ravel()[mine].astype(np.int64)
            mine = mine[np.lexsort((rank[mine + length], length))]
        mine = np.concatenate((mine, cells[low_s[c] : low_s[c + 1]]))
        rank[mine] = np.arange(placed, placed + len(mine))
        placed += len(mine)
        out.append(mine)
    found = np.concatenate(out)
    return found[found % width <= (size - LENGTH)[found // width]]


def repeats(contexts: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of ``contexts`` whose LENGTH-byte strings start earlier in another of them: (doc, start, end), merged."""
    size = np.array([len(c) for c in contexts])
    width = int(size.max()) + 8
    rows = np.zeros((len(contexts), width), np.uint8)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    rows[np.arange(width)[None, :] < size[:, None]] = flat
    order = suffix_order(rows, size)
    if len(order) < 2:
        return doc[:0], start[:0], start[:0]
    data = rows.ravel()
    common = np.ones(len(order) - 1, bool)  # neighbours with a common prefix of LENGTH bytes
    for k in range(LENGTH):
        left = np.flatnonzero(common)
        common[left] = data[order[left] + k] == data[order[left + 1] + k]
    head = np.flatnonzero(np.concatenate(([True], ~common)))
    ranks = np.unique(doc, return_inverse=True)[1]
    row, column = order // width, order % width
    when = (ranks[row].astype(np.int64) << 32) | (start[row].astype(np.int64) + column)
    first = np.repeat(np.minimum.reduceat(when, head), np.diff(np.append(head, len(order))))
    later = when > first
    begin = start[row[later]].astype(np.int64) + column[later]
    return _merge(doc[row[later]], begin, begin + LENGTH)


def _sort_contexts(most: int = 30_000):
    """Compare the contexts of each anchor, many anchors at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        table = pa.Table.from_batches(found) if found else None
        if not table:
            return
        table = table.sort_by("anchor")
        anchor = table["anchor"].to_numpy()
        edges = np.append(np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))), len(anchor))
        low = 0
        while low < len(edges) - 1:
            high = max(low + 1, int(np.searchsorted(edges, edges[low] + most, "right")) - 1)
            part = table.slice(edges[low], edges[high] - edges[low])
            spans = repeats(part["bytes"].to_pylist(), part["doc"].to_numpy(), part["start"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(spans[0], pa.int64()), pa.array(spans[1], pa.int32()), pa.array(spans[2], pa.int32())], ["doc", "start", "stop"])
            low = high

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], [], []]
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            data = (text.as_py() or "").encode()
            spans, kept, at = spans.as_py() or [], [], 0
            if spans:
                _, start, stop = _merge(np.zeros(len(spans), np.int64), np.array([s["start"] for s in spans], np.int64), np.array([s["stop"] for s in spans], np.int64))
                spans = [{"start": int(a), "stop": int(b)} for a, b in zip(start, stop, strict=True)]
            for s in spans:
                kept.append(data[at : s["start"]])
                at = s["stop"]
            kept.append(data[at:])
            for column, value in zip(out, (doc, len(data), spans, b"".join(kept)), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "spans", "kept"])


def drop_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Cut from each document every byte covered by a LENGTH-byte string that starts earlier, in a smaller doc_id or before in the document.

    Texts are compared as UTF-8, null as empty, never across documents, and as given (not as cut).  Returns doc_id, n_bytes,
    spans (what is cut, joined where they touch) and kept (the bytes left, concatenated).  Texts shorter than LENGTH stay whole.
    Rows with the same doc_id and text are one document.  Of different texts under one doc_id only that with the least digest
    is searched, and the others stay whole, as do rows without a doc_id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    signed = saved(rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n")).filter("doc_id is not null"))
    several = signed.groupBy("doc_id").agg(F.min("digest").alias("own"), F.max("digest").alias("last")).filter("own != last").select("doc_id", "own")
    whole = saved(signed.join(several, "doc_id").filter("digest != own").select("doc_id", "digest"))
    odd = not whole.isEmpty()
    one = signed.join(whole, ["doc_id", "digest"], "left_anti") if odd else signed
    firsts = one.filter(F.col("n") >= LENGTH).groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").select("digest", "first")
    copies = saved(one.join(firsts, "digest").filter("doc_id != first").select(F.col("doc_id").alias("doc"), F.lit(0).alias("start"), F.col("n").cast("int").alias("stop")))

    searched = rows.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    searched = searched.join(whole, ["doc_id", "digest"], "left_anti") if odd else searched
    n_copies = copies.count()
    gone = copies.select(F.col("doc").alias("doc_id"))
    searched = searched.join(F.broadcast(gone) if n_copies * 32 <= BROADCAST_BYTES else gone, "doc_id", "left_anti").select("doc_id", "text")
    volume = signed.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    buckets = max(1, round(volume * 0.045 / PARTITION))
    found = saved(searched.mapInArrow(_find_anchors(buckets), _FOUND).repartition(buckets, "bucket").mapInArrow(_match_contexts(buckets), _FOUND))
    wanted = found.filter("place >= 0").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "start", "stop")).alias("wanted"))
    wanted = saved(wanted)
    n_contexts = found.filter("place >= 0").count()
    contexts = searched.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_cut_contexts, _CONTEXT)
    sorted_ = contexts.repartition(max(1, n_contexts // 30_000), "anchor").mapInArrow(_sort_contexts(), "doc long, start int, stop int")
    spans = found.filter("place < 0").select("doc", "start", "stop").union(sorted_).union(copies)
    cut = saved(spans.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set(F.struct("start", "stop")).alias("cut")))
    joined = rows.join(cut, "doc_id", "left")
    if odd:
        joined = joined.join(whole.withColumn("left_out", F.lit(True)).distinct(), ["doc_id", "digest"], "left").withColumn("cut", F.when(F.col("left_out").isNull(), F.col("cut")))
    return joined.select("doc_id", "text", "cut").mapInArrow(_keep, "doc_id long, n_bytes long, spans array<struct<start: int, stop: int>>, kept binary")
