"""Self-join of documents on the Jaccard similarity of their n-word shingles, as a blocked sparse matrix product.

The document-by-shingle incidence matrix is never multiplied whole.  Documents with equal rows are first
folded into one class.  Shingles are put in one global order, rare before frequent, and only the head of
each row that a similar row must touch (its size less the least overlap, plus one) goes through a shuffle, once.
Rows meeting in a column attach to that column's most central row, their hub.  Then two products are taken:

1. each hub's row times the rows of its members, in blocks of ``HUB_ROWS`` members: overlap counts are accumulated over
   whole shingle sets, pairs below the bound that follows from both sizes are discarded, links are folded into components;
2. within a hub, rows outside the hub's component times all its rows, in blocks of ``BLOCK_ROWS``: here the incidence
   matrix has its columns folded to a few hundred (a parity sketch), whose product bounds the overlap from above, and
   only pairs of different components that the bound allows come out; they go through the first product's exact count.

Before either product, pairs are discarded by sizes, by what of their heads no other row has, and by their sketches; each of
these bounds is exact, so no link is lost.  No pair of one component is ever produced by the second product.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, components, discard, saved, Sent, settled_join, tidy
from .textkit import distinct, shingle_blocks

#: Shingles and words whose counts steer the order; any order gives the same result, so the tables' sizes only steer speed.
FREQUENT, FREQUENT_WORDS = 1 << 18, 1 << 16
#: Shingles counted at a time within a task; those in fewer than LEAST of a chunk's documents (words: LEAST_WORDS times) are not reported.
CHUNK, LEAST, LEAST_WORDS = 1 << 21, 4, 16
#: Expected and counted occurrences are kept in steps of 1 / SCALE.
SCALE = 16
#: Rows of a block of the product, and rows that meet one copy of their hub.
BLOCK_ROWS, HUB_ROWS = 512, 4096
#: Block pairs of so many rows have their pairs listed; larger ones are multiplied.
FEW = 48
#: Bits of a row's sketch: a power of two not under its size, within these bounds.
LEAST_BITS, MOST_BITS = 64, 1 << 16
_FREQ_BITS = 19


def frequent(parts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur ``least`` times or more in all ``parts``, which are emptied, and how often; one sorted copy is all that is made."""
    one = np.concatenate(parts)
    parts.clear()
    one.sort()
    begin = np.flatnonzero(one[least - 1 :] == one[: len(one) - least + 1]) if len(one) >= least else np.zeros(0, np.int64)
    values = one[begin]
    begin = begin[np.concatenate(([True], values[1:] != values[:-1]))] if len(begin) else begin
    values = one[begin]
    return values, np.searchsorted(one, values, "right") - begin


def _local_counts(n: int):
    """Counts of shingles (kind 0) and words (kind 1) that are frequent within chunks of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size, seen = [], [], 0, set()

        def flush():
            out = []
            for kind, parts, least in ((0, held, LEAST), (1, texts, LEAST_WORDS)):
                values, counts = frequent(parts, least)
                out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(values), kind, np.int32)), pa.array(values.view(np.int64)), pa.array(counts)], ["kind", "value", "n"]))
            return out

        for batch in batches:
            for _, _, words, first, hashes, begin in shingle_blocks(batch.column(0), n):
                texts.append(words)
                own = []
                for k in range(len(begin) - 1):
                    one = distinct(hashes[begin[k] : begin[k + 1]])
                    digest = hashlib.blake2b(one.tobytes(), digest_size=8).digest()
                    if digest not in seen:  # equal rows are folded before the join, so a chunk counts them once
                        seen.add(digest)
                        own.append(one)
                held += [np.concatenate(own)] if own else []
                size += len(words)
                if size >= CHUNK and held:
                    yield from flush()
                    held, texts, size, seen = [], [], 0, set()
        if held:
            yield from flush()

    return run


class Order:
    """The global order of shingles: by counted occurrences, or those expected from their words, then by hash."""

    def __init__(self, shingles: pa.Table, words: pa.Table, total: int):
        self.shingles, counts = self._sorted(shingles)
        self.counts = np.minimum(counts * SCALE, (1 << _FREQ_BITS) - 1).astype(np.uint64)
        self.words, counts = self._sorted(words)
        low = counts.min() / 2 if len(counts) else 1.0
        self.logs, self.rare, self.total = np.log(counts / max(1, total)), np.log(low / max(1, total)), np.log(max(1, total))

    @staticmethod
    def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        values = table["value"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(values)
        return values[order], table["n"].to_numpy().astype(float)[order]

    def keys(self, words: np.ndarray, first: np.ndarray, hashes: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
        """Sortable keys of the shingles of some texts; equal keys of different shingles only cost a comparison."""
        log = np.full(len(words) + n, 0.0)
        if len(self.words) and len(words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            log[: len(words)] = np.where(self.words[at] == words, self.logs[at], self.rare)
        lead = np.arange(len(hashes)) - np.repeat(begin[:-1] - first[:-1], np.diff(begin))
        expected = self.total + sum(log[lead + k] for k in range(n)) if len(hashes) else np.zeros(0)
        often = np.minimum(SCALE * np.exp(np.minimum(expected, 30.0)), (1 << _FREQ_BITS) - 1).astype(np.uint64)
        if len(self.shingles) and len(hashes):
            at = np.minimum(np.searchsorted(self.shingles, hashes), len(self.shingles) - 1)
            often = np.where(self.shingles[at] == hashes, self.counts[at], often)
        return (often << np.uint64(63 - _FREQ_BITS)) | (hashes >> np.uint64(_FREQ_BITS + 1))


def shingle_order(docs: DataFrame, text: str, n: int) -> Order:
    """Count all documents for the order; what comes to the driver is FREQUENT rows of each kind at most (4 MB each), whatever the input."""
    counted = saved(docs.select(text).mapInArrow(tidy(_local_counts(n)), "kind int, value long, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")))
    top = [counted.filter(F.col("kind") == kind).orderBy(F.desc("n"), "value").limit(most).select("value", "n").toArrow() for kind, most in ((0, FREQUENT), (1, FREQUENT_WORDS))]
    total = counted.filter("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    discard(counted)
    return Order(*top, total)


def _least_overlap(size: int, num: int, den: int) -> int:
    """The least overlap a row of this size has with any row it links with: ceil(size * num / den)."""
    return -(-size * num // den)


_SIGNATURE = "doc_id long, n_shingles long, digest binary, weight long, sketch binary, keys array<long>"


def bits_of(size: int) -> int:
    """Bits of the sketch of a row of this size."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, size) - 1).bit_length()))


def sketch(one: np.ndarray) -> bytes:
    """Parities of the numbers of a row's shingles in its columns folded to ``bits_of`` its size.

    Two rows differ in at least as many shingles as their sketches (folded to the shorter) differ in bits.
    """
    bits = bits_of(len(one))
    return np.packbits((np.bincount((one & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _signatures(n: int, num: int, den: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, weights, sketches, keys = [], [], [], [], []
            for _, _, words, first, hashes, begin in shingle_blocks(batch.column(1), n):
                marks = order.value.keys(words, first, hashes, begin, n)
                for k in range(len(begin) - 1):
                    own = slice(begin[k], begin[k + 1])
                    one, at = np.unique(hashes[own], return_index=True)
                    size = len(one)
                    sizes.append(size)
                    digests.append(hashlib.blake2b(one.tobytes(), digest_size=16).digest() if size else None)
                    sketches.append(sketch(one) if size else None)
                    all_keys = np.sort(marks[own][at])
                    heat = int((all_keys >> np.uint64(63 - _FREQ_BITS)).mean()) if size else 0
                    weights.append(heat << 40 | min(size, (1 << 40) - 1))
                    keys.append(all_keys[: size - _least_overlap(size, num, den) + 1 if size else 0].view(np.int64))
            lengths = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(weights, pa.int64()), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(lengths), flat)], ["doc_id", "n_shingles", "digest", "weight", "sketch", "keys"])

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and its offsets."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def _folded(rows: np.ndarray, width: int) -> np.ndarray:
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _apart(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits sketches ``i`` of one buffer and ``j`` of another differ, the longer folded to the shorter."""
    widths = np.diff(x_at)[i] * (1 << 32) + np.diff(y_at)[j]
    out = np.zeros(len(i), np.int64)
    for kind in np.unique(widths):
        same = np.flatnonzero(widths == kind)
        wide, narrow = int(kind >> 32), int(kind & 0xFFFFFFFF)
        for some in np.array_split(same, -(-len(same) * max(wide, narrow) // (16 << 20))):
            p, q = x[x_at[i[some]][:, None] + np.arange(wide)], y[y_at[j[some]][:, None] + np.arange(narrow)]
            out[some] = np.bitwise_count(_folded(p, narrow) ^ _folded(q, wide)).sum(1, dtype=np.int64)
    return out


def _sketches_allow(num: int, den: int):
    """Keep the pairs (hub, id) whose sketches differ in no more bits than a link may in shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            every = np.arange(batch.num_rows)
            apart = _apart(*_flat(batch.column(4)), *_flat(batch.column(5)), every, every)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["hub", "id"]).filter(pa.array((num + den) * apart <= (den - num) * total))

    return run


def _asked_sets(n: int):
    """The shingle sets of rows, once for each block (hub, salt) that asks for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = batch.column(2).to_pylist()
            row = 0
            for _, _, _, _, hashes, begin in shingle_blocks(batch.column(1), n):
                out = [[], [], [], [], []]
                for k in range(len(begin) - 1):
                    one = distinct(hashes[begin[k] : begin[k + 1]]).tobytes()
                    for ask in asks[row]:
                        for column, value in zip(out, (ask["hub"], ask["salt"], ask["member"], batch.column(0)[row].as_py(), one), strict=True):
                            column.append(value)
                    row += 1
                kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["hub", "salt", "member", "id", "elements"])

    return run


def _hub_product(num: int, den: int):
    """Rows sorted by block, hubs first: a block's rows times its hub's row, that is their overlaps, and of these the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hubs = None, []
        for batch in batches:
            hub, salt, member, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            data, at = _flat(batch.column(4))
            elements, at = np.frombuffer(data.tobytes(), np.uint64) if len(data) % 8 == 0 else None, at // 8
            edges = np.flatnonzero(np.concatenate(([True], (hub[1:] != hub[:-1]) | (salt[1:] != salt[:-1])))) if len(hub) else []
            found = [[], []]
            for low, high in zip(edges, np.append(edges[1:], len(hub)), strict=True):
                if now != (hub[low], salt[low]):
                    now, hubs = (hub[low], salt[low]), []
                first = low + int(np.argmax(member[low:high])) if member[low:high].any() else high
                hubs += [elements[at[k] : at[k + 1]] for k in range(low, first) if at[k + 1] > at[k]]
                rows = np.arange(first, high)
                for one in hubs if len(rows) else ():
                    block = elements[at[first] : at[high]]
                    hit = one[np.minimum(np.searchsorted(one, block), len(one) - 1)] == block
                    overlap = np.diff(np.concatenate(([0], np.cumsum(hit)))[at[first : high + 1] - at[first]])
                    sizes = np.diff(at[first : high + 1])
                    linked = rows[(overlap > 0) & (den * overlap >= num * (sizes + len(one) - overlap))]
                    found[0].append(np.full(len(linked), now[0]))
                    found[1].append(ids[linked])
            a, b = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    return run


def _links(pairs: DataFrame, docs: DataFrame, text: str, n: int, num: int, den: int) -> DataFrame:
    """Those of the saved ``pairs(hub, id)`` whose whole shingle sets are similar enough, as saved rows (a, b).

    Each member's set travels once for each of its hubs, a hub's once for each block of its members.
    """
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("salts"))
    hubs = blocks.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"))
    members = pairs.join(blocks, "hub").select("id", "hub", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member"))
    asks = saved(hubs.union(members).groupBy("id").agg(F.collect_list(F.struct("hub", "salt", "member")).alias("asks")))
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).alias("text"))
    asked = whole.join(checked_broadcast(asks, 300_000), "id").select("id", "text", "asks").mapInArrow(tidy(_asked_sets(n)), "hub long, salt int, member boolean, id long, elements binary")
    dealt = asked.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member")
    links = saved(dealt.mapInArrow(tidy(_hub_product(num, den)), "a long, b long").distinct())
    discard(asks)
    return links


def _block_product(num: int, den: int):
    """Rows sorted by block pair: pairs of its two blocks (or within its one) that may link, by the product of their sketches as signs."""

    def product(data, at, sizes, part, x, y):
        """Pairs of rows ``x`` and ``y`` of one block pair, too many to list."""
        width = np.diff(at)
        out = []
        for wide in np.unique(width[np.concatenate((x, y))]):
            for own, other in {(wide, wide), (wide, wide // 2), (wide // 2, wide)}:
                a, b = x[width[x] == own], y[width[y] == other]
                if len(a) and len(b):
                    narrow = min(own, other)
                    p, q = (1 - 2.0 * np.unpackbits(_folded(data[at[r][:, None] + np.arange(w)], narrow), axis=1).astype(np.float32) for r, w in ((a, own), (b, other)))
                    i, j = np.nonzero(((num + den) * (8 * narrow - p @ q.T) / 2 <= (den - num) * (sizes[a][:, None] + sizes[b])) & (part[a][:, None] != part[b]))
                    out.append((a[i], b[j]))
        return tuple(np.concatenate([o[k] for o in out]) if out else x[:0] for k in (0, 1))

    def pairs(table: pa.Table) -> pa.RecordBatch:
        hub, first, second, block, ids, sizes, part = (table[c].to_numpy() for c in ("hub", "first", "second", "block", "id", "n_shingles", "component"))
        data, at = _flat(table["sketch"].combine_chunks())
        edges = np.append(np.flatnonzero(np.concatenate(([True], (hub[1:] != hub[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])))), len(hub))
        found = []
        few = np.diff(edges) <= FEW
        start, length = edges[:-1][few], np.diff(edges)[few]
        for n in np.unique(length):  # all block pairs of n rows at once
            i, j = np.triu_indices(n, 1)
            found.append(((start[length == n][:, None] + i).ravel(), (start[length == n][:, None] + j).ravel()))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        fine = ((first[i] == second[i]) | (block[i] != block[j])) & (part[i] != part[j])
        i, j = i[fine], j[fine]
        fine = (num + den) * _apart(data, at, data, at, i, j) <= (den - num) * (sizes[i] + sizes[j])
        found = [(i[fine], j[fine])]
        for k in np.flatnonzero(~few):
            own = np.arange(edges[k], edges[k + 1])
            found.append(product(data, at, sizes, part, own[block[own] == first[own]], own[block[own] == second[own]]))
        i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        least = np.minimum(sizes[i], sizes[j])
        fine = (den * least >= num * (sizes[i] + sizes[j] - least)) & (ids[i] != ids[j])
        a, b = ids[i[fine]], ids[j[fine]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["hub", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = [held[c].to_numpy() for c in ("hub", "first", "second")]
            cut = int(np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))[-1]) + 1 if len(held) and any((k != k[-1]).any() for k in keys) else 0
            if cut:
                yield pairs(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and len(held):
            yield pairs(held.combine_chunks())

    return run


def similar_documents(docs: DataFrame, text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Classes and components of documents whose n-word shingle sets have a Jaccard similarity of at least num / den.

    ``docs`` needs an integer ``doc_id`` and the text column; other columns are ignored, whatever their names.  Words are runs of bytes
    other than 0x20 and 0x09-0x0D, with A-Z in lower case; a text of fewer than n words has its whole sequence as
    its only shingle.  Returns one row for each input row: doc_id, n_shingles, class_id (smallest doc_id with the
    same set) and component_id (smallest doc_id reachable by links).  The links themselves are not given: pairs whose
    component is already known are not compared, so neither links nor their number are found within one.  Null and blank
    texts have the empty set and are linked with nothing, nor is a row without doc_id.  Rows with equal ids are one document that has
    all their texts' links.  Texts are taken whole, however long.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", text)
    order = Sent(spark, shingle_order(docs, text, n))
    wide = saved(docs.mapInArrow(tidy(_signatures(n, num, den, order)), _SIGNATURE))
    signed = wide.select("doc_id", "n_shingles", "digest")
    classes = saved(signed.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows")))
    copies = saved(settled_join(signed.filter("digest is not null"), classes.filter("rows > 1").select("digest", "id"), "digest").filter("doc_id is null or doc_id != id").select("doc_id", "digest").distinct())
    reps = wide.filter("digest is not null and doc_id is not null").join(checked_broadcast(copies, 500_000), ["doc_id", "digest"], "left_anti")
    reps = reps.select(F.col("doc_id").alias("id"), "n_shingles", "weight", "sketch", "keys")

    # Keys up to ``sure`` lie in the head of every row that reaches that far, so one that a single row has is in no other such row:
    # ``alone`` of them cannot be shared, and two such rows whose slacks add up to more than 0 cannot link.
    # Any bound is right; one that most rows reach serves best.  Rows that do not reach it have a slack that allows all.
    sure = reps.agg(F.percentile_approx(F.element_at("keys", -1), 0.05)).head()[0] or 0
    columns = reps.select("id", "weight", F.explode("keys").alias("key")).repartition("key")
    hubs = columns.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("hub")).filter("rows > 1")
    hubs = hubs.select("key", (-F.col("hub.minus")).alias("hub"), F.col("hub.weight").bitwiseAND((1 << 40) - 1).alias("hub_n"))
    seen = F.count(F.when((F.col("key") <= sure) & F.col("weight").isNotNull(), 1))  # names the weight so that one shuffle serves both
    met = columns.join(hubs.hint("shuffle_hash"), "key").groupBy("id").agg(seen.alias("shared"), F.collect_set(F.struct("hub", "hub_n")).alias("hubs"))
    own = reps.select("id", "n_shingles", (F.element_at("keys", -1) >= sure).alias("reaches"), F.size(F.filter("keys", lambda k: k <= sure)).alias("sure"))
    slack = F.when(F.col("reaches"), (F.col("sure") - F.col("shared")) * (num + den) - F.col("n_shingles") * (den - num)).otherwise(-(1 << 50))
    rows = saved(met.join(own, "id").select("id", "n_shingles", slack.alias("slack"), "hubs"))
    sketches = reps.select("id", "sketch")
    members = rows.select("id", "n_shingles", "slack", F.explode("hubs").alias("hub")).select("id", "n_shingles", "slack", "hub.*")
    central = rows.select(F.col("id").alias("hub"), F.col("slack").alias("hub_slack"))
    sized = members.filter(F.least("n_shingles", "hub_n") * den >= F.greatest("n_shingles", "hub_n") * num).filter("id != hub")
    sized = saved(sized.join(central, "hub").filter("slack + hub_slack <= 0").select("hub", "id", "n_shingles", "hub_n"))
    asked = checked_broadcast(saved(sized.select("id").union(sized.select("hub")).distinct()))
    few = saved(sketches.join(asked, "id", "left_semi").distinct())
    paired = sized.join(few, "id").join(few.select(F.col("id").alias("hub"), F.col("sketch").alias("hub_sketch")), "hub")
    tried = saved(paired.select("hub", "id", "n_shingles", "hub_n", "sketch", "hub_sketch").mapInArrow(tidy(_sketches_allow(num, den)), "hub long, id long").distinct())
    discard(few, sized)
    links = _links(tried, docs, text, n, num, den)
    found = components(links)

    # Rows that link have sizes within a factor, so in the same or neighbouring bands; a row stays if the least slack there allows it.
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / (1.001 * math.log(den / num))) if den > num else F.col("n_shingles")
    parts = saved(members.join(found, "id", "left").select("hub", "id", "n_shingles", "slack", F.coalesce("component", "id").alias("component"), band.cast("long").alias("band")))
    least = parts.groupBy("hub", "band").agg(F.min("slack").alias("least")).withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1))).groupBy("hub", "band").agg(F.min("least").alias("least"))
    near = parts.join(least, ["hub", "band"]).filter("slack + least <= 0")
    center = found.select(F.col("id").alias("hub"), F.col("component").alias("hub_component"))
    close = saved(near.join(center, "hub", "left").select("hub", "id", "n_shingles", "component", (F.col("component") == F.coalesce("hub_component", "hub")).alias("inner")))
    torn = close.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.sum((~F.col("inner")).cast("int")) / BLOCK_ROWS).alias("outside"), F.ceil(F.sum(F.col("inner").cast("int")) / BLOCK_ROWS).alias("inside")).filter("low != high")
    # Blocks of rows outside the hub's component come first and meet all blocks; those inside meet only the former.
    wanted = saved(close.join(torn.select("hub"), "hub", "left_semi"))
    asked = checked_broadcast(saved(wanted.select("id").distinct()))
    ranked = wanted.join(sketches.join(asked, "id", "left_semi").distinct(), "id").join(torn, "hub").withColumn("block", F.when(F.col("inner"), F.col("outside") + F.pmod(F.xxhash64("id"), "inside")).otherwise(F.pmod(F.xxhash64("id"), "outside")))
    ranked = ranked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("inner"), F.col("outside") - 1).otherwise(F.col("outside") + F.col("inside") - 1))))
    ranked = ranked.select("hub", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "id", "n_shingles", "sketch", "component")
    dealt = ranked.repartition("hub", "first", "second").sortWithinPartitions("hub", "first", "second")
    rest = saved(dealt.mapInArrow(tidy(_block_product(num, den)), "hub long, id long").distinct())
    more = _links(rest, docs, text, n, num, den)
    discard(rows, parts, close, wanted, tried, rest, found)
    found = components(links.union(more))
    classes = classes.join(found, "id", "left").select("digest", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component_id"), ((F.col("rows") > 1) | F.col("component").isNotNull()).alias("told")).filter("told").drop("told")
    ids = saved(settled_join(signed, saved(classes), "digest", "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id")))
    discard(wide, copies, links, more, found)
    return ids
