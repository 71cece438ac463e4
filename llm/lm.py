"""Document log-likelihoods under a gated recurrent language model, and under a smoothed unigram model.

Word counts of the whole corpus come from one shuffle of (hash, count) rows.  The language model is a GRU in
numpy with a class-factored output: the HEAD most frequent words fall into classes by frequency, with a softmax over
classes and one within the class; every other word belongs to a class of words with similar endings, in which its
probability is its smoothed relative count.  It is trained by truncated backpropagation on all
training documents: shards train by themselves, their parameters are averaged by tokens, and so on for a few rounds.  Scoring carries
the state across windows, so that a document's score is that of its complete text.  Counts of the TABLE most
frequent words are broadcast; the remaining words go through a join of rows that hold a word of a document once, with
the times it has it there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_parts, discard, saved, Sent, sum_rows
from .textkit import _LOWER, blocks, word_hashes, word_spans

SMOOTH = 0.1
TABLE, HEAD, PER_CLASS, ENDINGS, TAILS = 1 << 16, 1024, 32, 4096, 32
CLASSES = HEAD // PER_CLASS + TAILS + 1  # the last is the end of a document
END = HEAD + TAILS
EMBED, HIDDEN = 16, 24
#: Tokens meant for a shard; averaging rounds, which share one pass over the documents (fewer shards than rounds: each makes a pass).
SHARD_TOKENS, ROUNDS = 1 << 20, 3
#: Parallel streams of a shard at most, tokens of a window, and updates of the parameters that a shard should have at least.
STREAMS, WINDOW, UPDATES = 256, 20, 100
BATCH, SPAN = 512, 32
#: Tokens whose class probabilities are in memory at a time.
COLUMNS = 2048
CHUNK = 1 << 21
#: Leading bits of a hash by which the table of words is entered.
BITS = 17


def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A key of each word's last two bytes."""
    last = _LOWER[data[ends - 1]].astype(np.int64)
    before = np.where(ends - starts > 1, _LOWER[data[np.maximum(ends - 2, 0)]], 0).astype(np.int64)
    return (last * 7919 + before * 104729) % ENDINGS


def _tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows with the hashes and ending keys of their words and the first word of each row."""
    for low, high, data, at in blocks(texts):
        starts, ends, first = word_spans(data, at)
        yield low, high, word_hashes(data, starts, ends), _keys(data, starts, ends) if len(starts) else np.zeros(0, np.int64), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush():
        hashes, keys = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        values, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(keys[first].astype(np.int32)), pa.array(counts.astype(np.int64))], ["word", "ending", "n"])

    for batch in batches:
        for _, _, hashes, keys, _ in _tokens(batch.column(0)):
            held.append((hashes, keys))
            size += len(hashes)
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, ending, n) of every distinct word of the one column of ``texts``; words are known by 64-bit hashes."""
    return texts.mapInArrow(_count, "word long, ending int, n long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    table: np.ndarray  # hashes of the most frequent words, sorted
    rank: np.ndarray  # their ranks by frequency
    logs: np.ndarray  # log10 of their smoothed counts
    tails: np.ndarray  # class of each ending
    tail_logs: np.ndarray  # log10 of each tail class's smoothed total
    starts: np.ndarray = field(init=False)  # place in the table of the first hash that begins with so many of BITS bits
    longest: int = field(init=False)  # hashes with one beginning at most

    def __post_init__(self):
        self.starts = np.searchsorted(self.table, np.arange(1 << BITS, dtype=np.uint64) << np.uint64(64 - BITS)).astype(np.int32)
        self.longest = int(np.diff(self.starts, append=len(self.table)).max())

    def ids(self, hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Model ids of words, whether the table has them, and where."""
        if not len(self.table) or not len(hashes):
            return HEAD + self.tails[keys], np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at, last = self.starts[hashes >> np.uint64(64 - BITS)], len(self.table) - 1
        np.minimum(at, last, out=at)
        for _ in range(self.longest):
            at += (self.table[at] < hashes) & (at < last)
        known = self.table[at] == hashes
        head = known & (self.rank[at] < HEAD)
        return np.where(head, self.rank[at], HEAD + self.tails[keys]), known, at


def _groups(profile: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Endings in ``k`` groups by the words they stand with (k-means on square roots of shares)."""
    rng = np.random.default_rng(3)
    x = np.sqrt(profile / np.maximum(profile.sum(1, keepdims=True), 1e-9))
    centers = x[np.argsort(-weight, kind="stable")[:k]] + rng.normal(0, 1e-3, (k, x.shape[1]))
    for _ in range(15):
        group = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1) if len(x) * k < 1 << 18 else np.concatenate([((p[:, None] - centers[None]) ** 2).sum(2).argmin(1) for p in np.array_split(x, 16)])
        for g in range(k):
            mine = group == g
            if weight[mine].sum():
                centers[g] = (x[mine] * weight[mine, None]).sum(0) / weight[mine].sum()
    return group


class Net:
    """The GRU and its output layers; parameters are one flat vector, so that they can be averaged.

    Rows are tokens, columns are units, but what is computed lies in memory unit by unit, so that each operation runs along many tokens at once.
    """

    SHAPES = {"e": (END + 1, EMBED), "wx": (EMBED, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "u": (HEAD, HIDDEN), "bu": (HEAD,)}

    def __init__(self, flat: np.ndarray | None = None):
        size = sum(int(np.prod(s)) for s in self.SHAPES.values())
        self.flat = np.zeros(size, np.float32) if flat is None else flat.astype(np.float32)
        at = 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def fresh(cls, classes: np.ndarray, words: np.ndarray) -> Net:
        """Random weights; biases are logs of the given class and head-word counts."""
        net, rng = cls(), np.random.default_rng(5)
        for name in ("e", "wx", "wh"):
            part = getattr(net, name)
            part[:] = rng.normal(0, 0.5 if name == "e" else part.shape[0] ** -0.5, part.shape)
        net.wc[:], net.u[:] = rng.normal(0, 0.02, net.wc.shape), rng.normal(0, 0.02, net.u.shape)
        net.bc[:], net.bu[:] = np.log(classes + 1), np.log(words + 1)
        return net

    def step(self, x: np.ndarray, h: np.ndarray):
        a = (self.wh.T @ h.T).T
        gates = x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = r * a[:, 2 * HIDDEN :]
        n += x[:, 2 * HIDDEN :]
        np.tanh(n, out=n)
        after = h - n
        after *= z
        after += n
        return after, z, r, n, a

    def inputs(self) -> np.ndarray:
        """What each id adds to the gates, unit by unit in memory."""
        return (self.wx.T @ self.e.T + self.b[:, None]).T

    def log_probs(self, h: np.ndarray, target: np.ndarray, grad: bool = False):
        """Natural logs of the class probability times, for head words, the word's within its class; and gradients of the mean loss."""
        kind = np.where(target < HEAD, target // PER_CLASS, target - HEAD + HEAD // PER_CLASS).astype(np.int16)
        order = np.argsort(kind, kind="stable")  # rows by class, so that a class's rows are a slice
        h, target, kind = h.T.take(order, axis=1, mode="wrap"), target[order], kind[order]
        bounds = np.searchsorted(kind, np.arange(HEAD // PER_CLASS + 1))
        rows = np.arange(len(kind))
        out = np.empty(len(kind), h.dtype)
        dh, g = (np.empty_like(h), {k: np.zeros_like(getattr(self, k)) for k in ("wc", "bc", "u", "bu")}) if grad else (None, None)

        size, safe = np.abs(h).max(initial=0), []
        for weights, bias in ((self.wc.T, self.bc), (self.u, self.bu)):  # within these bounds no exponential leaves the range of 32 bits
            safe.append(size * np.abs(weights).sum(1).max() + np.abs(bias).max() < 60)

        def part(layer, weights, bias, own, wanted):
            """Logs of the softmax over ``weights`` at ``wanted`` in the columns ``own``; for gradients, its probabilities, less 1 at ``wanted``."""
            p = weights @ h[:, own]
            p += bias[:, None]
            if not safe[layer]:
                p -= p.max(0)
            here = rows[: p.shape[1]]
            logs = p[wanted, here]
            np.exp(p, out=p)
            total = p.sum(0)
            logs -= np.log(total)
            if grad:
                p /= total
                p[wanted, here] -= 1
            return logs, p

        for low in range(0, len(kind), COLUMNS):
            own = slice(low, low + COLUMNS)
            out[own], p = part(0, self.wc.T, self.bc, own, kind[own])
            if grad:
                g["wc"] += h[:, own] @ p.T
                g["bc"] += p.sum(1)
                dh[:, own] = self.wc @ p
        for c in range(HEAD // PER_CLASS):
            mine, own = slice(bounds[c], bounds[c + 1]), slice(c * PER_CLASS, (c + 1) * PER_CLASS)
            if bounds[c] == bounds[c + 1]:
                continue
            logs, q = part(1, self.u[own], self.bu[own], mine, target[mine] - c * PER_CLASS)
            out[mine] += logs
            if grad:
                g["u"][own] = q @ h[:, mine].T
                g["bu"][own] = q.sum(1)
                dh[:, mine] += self.u[own].T @ q
        back = np.empty_like(order)
        back[order] = rows
        if grad:
            dh = dh.take(back, axis=1, mode="wrap")
            for x in (dh, *g.values()):
                x /= max(1, len(kind))
        return out[back], dh.T if grad else None, g


def train(net: Net, docs: list[np.ndarray], rate: float = 0.01) -> Net:
    """One pass of truncated backpropagation (Adam) over documents of model ids, in parallel streams of windows."""
    text = np.concatenate([np.append(d, END) for d in docs]) if docs else np.zeros(0, np.int64)
    streams = min(STREAMS, max(1, len(text) // (UPDATES * WINDOW)))
    steps = len(text) // streams
    if not steps:
        return net
    target = text[: steps * streams].reshape(streams, steps)
    before = np.concatenate((np.full((streams, 1), END), target[:, :-1]), axis=1)
    h = np.zeros((HIDDEN, streams), np.float32).T
    m, v, count = np.zeros_like(net.flat), np.zeros_like(net.flat), 0
    for low in range(0, steps, WINDOW):
        inp, out = before[:, low : low + WINDOW], target[:, low : low + WINDOW]
        width = inp.shape[1]
        table, saves, states = net.inputs().T, [], np.empty((HIDDEN, width, streams), np.float32)
        for t in range(width):
            live = (inp[:, t] != END).astype(np.float32)[:, None]
            h0 = h * live
            h, z, r, n, a = net.step(table.take(inp[:, t], axis=1, mode="wrap").T, h0)
            saves.append((h0, z, r, n, a, live))
            states[:, t] = h.T
        _, dh, g = net.log_probs(states.reshape(HIDDEN, -1).T, out.T.ravel(), grad=True)
        dh = dh.T.reshape(HIDDEN, width, streams)
        dx, da = np.empty((3 * HIDDEN, width, streams), np.float32), np.empty((3 * HIDDEN, streams), np.float32)
        g["wh"], carry = np.zeros_like(net.wh), np.zeros_like(h)
        for t in reversed(range(width)):
            h0, z, r, n, a, live = saves[t]
            d = dh[:, t].T + carry
            dn = d * (1 - z)
            dz = (h0 - n) * z
            dz *= dn
            dn *= 1 - n * n
            dr = dn * a[:, 2 * HIDDEN :]
            dr *= r
            np.multiply(dn, r, out=da[2 * HIDDEN :].T)
            dr *= 1 - r
            da[:HIDDEN], da[HIDDEN : 2 * HIDDEN] = dz.T, dr.T
            dx[: 2 * HIDDEN, t], dx[2 * HIDDEN :, t] = da[: 2 * HIDDEN], dn.T
            g["wh"] += h0.T @ da.T
            carry = (net.wh @ da).T
            carry += d * z
            carry *= live
        dx = dx.reshape(3 * HIDDEN, -1)
        ids = inp.T.ravel()
        g["wx"], g["b"] = (dx @ net.e[ids]).T, dx.sum(1)
        g["e"], by_word = np.zeros_like(net.e), np.argsort(ids.astype(np.int16), kind="stable")
        head = np.flatnonzero(np.diff(ids[by_word], prepend=-1))
        g["e"][ids[by_word[head]]] = np.add.reduceat((dx.T @ net.wx.T)[by_word], head)
        flat = np.concatenate([g[name].ravel() for name in Net.SHAPES])
        flat *= min(1.0, 5.0 / (np.sqrt((flat * flat).sum()) + 1e-9))
        count += 1
        m += 0.1 * (flat - m)
        v += 0.01 * (flat * flat - v)
        net.flat -= rate * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.99**count)) + 1e-6)
    return net


def likelihoods(net: Net, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each complete document of model ids, its end included; tail words count as their class."""
    out = np.zeros(len(docs))
    table = net.inputs().T
    lengths = np.array([len(d) + 1 for d in docs])
    order = np.argsort(-lengths, kind="stable")
    for low in range(0, len(docs), BATCH):
        rows = order[low : low + BATCH]
        long = int(lengths[rows[0]])
        h = np.zeros((HIDDEN, len(rows)), np.float32).T
        last = np.full(len(rows), END)
        for begin in range(0, long, SPAN):
            alive = int(np.searchsorted(-lengths[rows], -begin, "left"))
            width = min(SPAN, long - begin)
            target = np.full((alive, width), -1)
            for k in range(alive):
                piece = docs[rows[k]][begin : begin + width]
                target[k, : len(piece)] = piece
                if len(piece) < width:
                    target[k, len(piece)] = END
            states, wanted, owner = [], [], []
            for t in range(width):
                n = int(np.searchsorted(-lengths[rows[:alive]], -(begin + t), "left"))
                if not n:
                    break
                h = net.step(table.take(last[:n], axis=1, mode="wrap").T, h[:n])[0]
                last = target[:n, t]
                states.append(h.T)
                wanted.append(last)
                owner.append(rows[:n])
            got = net.log_probs(np.concatenate(states, axis=1).T, np.concatenate(wanted))[0]
            out += np.bincount(np.concatenate(owner), got, minlength=len(docs))
    return out


def _encode(words: Vocabulary, texts: pa.Array) -> list[np.ndarray]:
    out = []
    for low, high, hashes, keys, first in _tokens(texts):
        ids, _, _ = words.ids(hashes, keys)
        out += [ids[first[k] : first[k + 1]] for k in range(high - low)]
    return out


def _encoder(words):
    """Texts as model ids in 16 bits; words outside the head as HEAD and their ending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [d.astype(np.int16).tobytes() for d in _encode(words.value, batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(ids, pa.binary())], ["doc", "shard", "ids"])

    return run


def _profiles(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """For each ending, how often the 64 most frequent words share a document with it."""
    near = np.zeros((ENDINGS, 64))
    for batch in batches:
        for ids in batch.column(0):
            own = np.frombuffer(ids.as_buffer(), np.int16)
            seen = np.bincount(own[own < 64], minlength=64)
            used, times = np.unique(own[own >= HEAD] - HEAD, return_counts=True)
            near[used] += times[:, None] * (seen / max(1, seen.sum()))
    return near


def _shard_trainer(tails, flat, rate: float):
    def one(table: pa.Table) -> pa.Table:
        lane = table["shard"][0].as_py() // 32
        model = np.concatenate((np.arange(HEAD), HEAD + tails.value))
        docs = [model[np.frombuffer(ids.as_buffer(), np.int16)] for ids in table.sort_by([("doc", "ascending"), ("ids", "ascending")])["ids"]]
        own, tokens = train(Net(flat.value.copy()), docs, rate), sum(len(d) + 1 for d in docs)
        rows = np.array_split(np.append(own.flat.astype(np.float64), 1.0) * tokens, 64)
        return pa.table({"lane": pa.array([lane] * 64, pa.int32()), "row": pa.array(range(64), pa.int32()), "part": pa.array([r.tobytes() for r in rows], pa.binary())})

    return one


def fit(docs: DataFrame, text: str) -> tuple[Vocabulary, Net, DataFrame, dict[str, float]]:
    """Counts and model of the training documents ``docs``: vocabulary, network, saved counts, and totals."""
    spark = docs.sparkSession
    counts = saved(word_counts(docs.select(text)))
    n_docs = docs.count()
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).head()
    totals = {"docs": n_docs, "tokens": (total.n or 0) + n_docs, "words": total.v + (n_docs > 0)}
    top = counts.orderBy(F.desc("n"), "word").limit(TABLE).toArrow()
    hashes, n = top["word"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(float)
    order = np.argsort(hashes)
    words = Vocabulary(hashes[order], np.arange(len(hashes))[order], np.log10(n + SMOOTH)[order], np.arange(ENDINGS), np.zeros(TAILS))
    shards = max(1, -(-totals["tokens"] // SHARD_TOKENS))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id())
    dealt = docs.select(text, doc.alias("doc")).withColumn("shard", F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(shards)))
    dealt = saved(dealt.mapInArrow(_encoder(Sent(spark, words)), "doc long, shard long, ids binary"))
    words.tails = np.zeros(ENDINGS, np.int64)
    near = sum_rows(dealt.select("ids"), _profiles)
    if len(near):
        words.tails = _groups(near, near.sum(1), TAILS)
    head = np.zeros(HEAD)
    head[: min(HEAD, len(n))] = n[:HEAD]
    sums = {r.ending: (r.n, r.v) for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    mass, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for ending, (a, b) in sums.items():
        mass[ending], kinds[ending] = a, b
    for ending, a in zip(top["ending"].to_numpy()[:HEAD], n[:HEAD], strict=True):
        mass[ending] -= a
        kinds[ending] -= 1
    group_n, group_v = (np.bincount(words.tails, x, minlength=TAILS) for x in (mass, kinds))
    words.tail_logs = np.log10(group_n + SMOOTH * (group_v + 1))
    net = Net.fresh(np.concatenate([head.reshape(-1, PER_CLASS).sum(1), group_n, [n_docs]]), head)
    tails = Sent(spark, words.tails)
    for k in range(ROUNDS):
        now = Sent(spark, net.flat)
        mine = dealt.filter(F.col("shard") % ROUNDS == k) if shards >= ROUNDS else dealt
        parts = mine.groupBy("shard").applyInArrow(_shard_trainer(tails, now, 0.01 / (1 + k)), "lane int, row int, part binary")
        for keys in (("lane", "row"), ("row",)):  # sums of some shards, then of these
            parts = parts.groupBy(*keys).applyInArrow(add_parts, "row int, part binary")
        parts = parts.toArrow().sort_by("row")
        if len(parts):
            whole = np.concatenate([np.frombuffer(p.as_buffer(), np.float64) for p in parts["part"]])
            net = Net(whole[:-1] / whole[-1])
    discard(dealt)
    return words, net, counts, totals


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_listed long, listed double, tail_listed double, model double, rest array<long>, times array<int>"


def _scorer(sent, end_log: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat = sent.value
        net, row = Net(flat), TaskContext.get().partitionId() << 40
        for batch in batches:
            docs, columns, rest, times = [], [], [], []
            for low, high, hashes, keys, first in _tokens(batch.column(0)):
                ids, known, at = words.ids(hashes, keys)
                log = np.where(known, words.logs[at], 0.0) if len(words.logs) else np.zeros(len(hashes))
                tail = ids >= HEAD
                sums = [np.diff(np.concatenate(([0.0], np.cumsum(x)))[first]) for x in (known, log, log * tail, np.where(tail, words.tail_logs[np.maximum(ids - HEAD, 0)], 0.0))]
                columns.append(np.array([np.diff(first) + 1, *sums]))
                docs += [ids[first[k] : first[k + 1]] for k in range(high - low)]
                for k in range(high - low):
                    own = slice(first[k], first[k + 1])
                    values, counts = np.unique(hashes[own][~known[own]], return_counts=True)
                    rest.append(values.view(np.int64))
                    times.append(counts.astype(np.int32))
            n, listed, log, tail_log, tail_total = np.concatenate(columns, axis=1) if columns else np.zeros((5, 0))
            model = likelihoods(net, docs) / np.log(10) - tail_total
            at = np.concatenate(([0], np.cumsum([len(r) for r in rest]))).astype(np.int32)
            flat_rest, flat_times = pa.array(np.concatenate(rest) if rest else np.zeros(0, np.int64)), pa.array(np.concatenate(times) if times else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(docs))), batch.column(1), batch.column(2), pa.array(n.astype(np.int64)), pa.array(listed.astype(np.int64)), pa.array(log + end_log), pa.array(tail_log), pa.array(model), pa.ListArray.from_arrays(pa.array(at), flat_rest), pa.ListArray.from_arrays(pa.array(at), flat_times)], ["row", "doc_id", "held_out", "n_tokens", "n_listed", "listed", "tail_listed", "model", "rest", "times"])
            row += len(docs)

    return run


def score(docs: DataFrame, held_out, text: str = "text") -> DataFrame:
    """log10 probabilities of every whole text of ``docs(doc_id, text)``, learnt from the rows where ``held_out`` is false.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (those that training texts have), train_tokens,
    base_score (unigram, add 0.1) and score (language model).  A null text is empty: its end alone.  Rows with equal ids are
    scored each by itself; without training rows every token is unknown; texts are scored whole, however long, and other columns ignored.  An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    words, net, counts, totals = fit(rows.filter(~F.col("held_out")), "text")
    sent = Sent(spark, (words, net.flat))
    end_log = float(np.log10(totals["docs"] + SMOOTH))
    scored = saved(rows.mapInArrow(_scorer(sent, end_log), _SCORED))
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("row", F.col("r.rest").alias("word"), F.col("r.times").alias("times"))
    found = rest.join(counts.select("word", "n"), "word", "left")
    found = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("rest_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rest_known"))
    whole = float(np.log10(totals["tokens"] + SMOOTH * (totals["words"] + 1)))
    rest_log, rest_known = F.coalesce("rest_log", F.lit(0.0)), F.coalesce("rest_known", F.lit(0))
    return scored.drop("rest", "times").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_listed") + rest_known + int(totals["docs"] > 0)).alias("n_known"), F.lit(totals["tokens"]).cast("long").alias("train_tokens"),
        (F.col("listed") + rest_log - F.col("n_tokens") * whole).alias("base_score"), (F.col("model") + F.col("tail_listed") + rest_log).alias("score"))
