"""Document quality: random Fourier features over document statistics, ridge regression, isotonic calibration.

One pass computes some thirty statistics of each whole text (numpy over Arrow batches) and saves them; texts are
not read again.  Random Fourier features approximate a Gaussian kernel over the standardised statistics; every partition sums its
part of the normal equations and Spark adds these up row by row of the matrix, so the driver only solves one system
of fixed size.  Pooled adjacent violators over score bins make the scores probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, saved, Sent, sum_rows
from .textkit import blocks, mix, word_hashes, word_spans

FEATURES, BINS = 300, 500
_KINDS = np.zeros(256, np.int64)  # byte kinds: 0 control, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 stop, 7 comma, 8 !, 9 other sign, 10 |, 11 above ASCII
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58] = 1, 2, 3
_KINDS[[33, *range(34, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 9
_KINDS[[32, 9, 10, 46, 44, 33, 124]] = 4, 4, 5, 6, 7, 8, 10
_KINDS[128:] = 11
_COUNTS = 12
STATISTICS = _COUNTS + 18


def _per(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of ``x`` over the runs that ``begin`` bounds."""
    return np.diff(np.concatenate(([0.0], np.cumsum(x)))[begin])


def _distinct(keys: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run: how many distinct keys, the count of the commonest, and the entropy of the counts."""
    distinct, most, entropy = (np.zeros(len(begin) - 1) for _ in range(3))
    for k in range(len(begin) - 1):
        one = np.sort(keys[begin[k] : begin[k + 1]])
        if len(one):
            edge = np.flatnonzero(np.concatenate(([True], one[1:] != one[:-1], [True])))
            n = np.diff(edge)
            distinct[k], most[k] = len(n), n.max()
            entropy[k] = np.log(len(one)) - (n * np.log(n)).sum() / len(one)
    return distinct, most, entropy


def statistics(texts: pa.Array) -> np.ndarray:
    """Statistics of each text, all finite; an empty text has zeros."""
    out = np.zeros((len(texts), STATISTICS))
    for low, high, data, at in blocks(texts):
        n = high - low
        size = np.diff(at).astype(float)
        doc = np.repeat(np.arange(n), np.diff(at))
        kinds = _KINDS[data]
        counts = np.bincount(doc * _COUNTS + kinds, minlength=n * _COUNTS).reshape(n, _COUNTS).astype(float)
        share = counts / np.maximum(size, 1)[:, None]
        starts, ends, first = word_spans(data, at)
        hashes = word_hashes(data, starts, ends)
        words = np.diff(first).astype(float)
        some, length = np.maximum(words, 1), (ends - starts).astype(float)
        mean = _per(length, first) / some
        spread = np.sqrt(np.maximum(0, _per(length**2, first) / some - mean**2))
        head, tail = (kinds[starts], kinds[ends - 1]) if len(starts) else (np.zeros(0), np.zeros(0))
        again = np.zeros(len(hashes))
        again[1:] = hashes[1:] == hashes[:-1]
        follower = np.concatenate((hashes[1:], [0])).astype(np.uint64) if len(hashes) else hashes
        some_words = np.diff(first) > 0
        again[first[:-1][some_words]], follower[first[1:][some_words] - 1] = 0, 0  # nothing is seen across the ends of a text
        pairs = mix(hashes + follower * np.uint64(3))
        distinct, most, entropy = _distinct(hashes, first)
        pair_distinct, pair_most, _ = _distinct(pairs, first)
        lines = counts[:, 5] + 1
        edge = np.flatnonzero(kinds == 5)
        line_at = np.searchsorted(edge, at)
        line_words = np.searchsorted(starts, edge) if len(edge) else np.zeros(0, np.int64)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * np.uint64(0x9E3779B97F4A7C15), out=sums[1:])
        before = np.concatenate(([0], line_words[:-1])) if len(edge) else line_words
        heads = line_at[:-1][np.diff(line_at) > 0]
        before[heads] = first[:-1][np.diff(line_at) > 0]
        step = sums[line_words] - sums[before]
        line_distinct, line_most, _ = _distinct(step, line_at)
        rows = [np.log1p(size), np.log1p(words), mean, spread, _per(length <= 2, first) / some, _per(length >= 12, first) / some, _per(head == 2, first) / some, _per(tail == 9, first) / some, _per((tail == 6) | (tail == 7), first) / some, _per(again, first) / some, distinct / some, most / some, entropy, pair_distinct / some, np.log1p(pair_most), np.log1p(lines), words / lines, (line_distinct + 1) / np.maximum(1, lines)]
        out[low:high] = np.column_stack([share, *rows]) * (size > 0)[:, None]
    return out


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by an array of doubles, ``stats`` (in place of a column of that name); rows and other columns stay as they are.

    A null or empty text has zeros; long texts are taken whole; an empty table stays empty.
    """
    names = [c for c in docs.columns if c not in (text, "stats")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(0))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * STATISTICS, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], stats], [*batch.schema.names[1:], "stats"])

    schema = docs.select(*names).schema.add("stats", T.ArrayType(T.DoubleType()))
    return docs.select(F.col(text).alias("__text"), *names).mapInArrow(run, schema)


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -6, 6)
        waves = np.cos(z @ self.waves + self.shifts) * np.sqrt(2 / self.waves.shape[1])
        return np.column_stack([np.ones(len(x)), z * 0.1, waves])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps, self.levels)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, STATISTICS))


def isotonic(n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing levels closest to ``mean`` with weights ``n``."""
    pools: list[list[float]] = []
    for weight, value in zip(n, mean, strict=True):
        pools.append([weight, value, 1])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w, v, k = pools.pop()
            a = pools[-1]
            a[1], a[0], a[2] = (a[0] * a[1] + w * v) / (a[0] + w), a[0] + w, a[2] + k
    return np.concatenate([np.full(int(k), v) for _, v, k in pools]) if pools else np.zeros(0)


def learn(stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = 1e-3, width: float = 0.12) -> Model:
    """Fit on all of ``labels(doc_id, quality)``: four fifths give the weights, the rest (by a hash of doc_id) the calibration.

    Labels other than 0 and 1 and those without doc_id are left out; a document with contradicting labels counts as 0; repeated documents
    count each.  Without any labelled document every score is 0.5; without one for the calibration, scores are the clipped regression.
    """
    labels = labels.select("doc_id", F.col("quality").cast("double").alias("y")).filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    part = (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0).alias("late")
    fit = saved(stats.join(labels, "doc_id").select("stats", "y", part))
    rng = np.random.default_rng(17)
    model = Model(np.zeros(STATISTICS), np.ones(STATISTICS), rng.normal(0, width, (STATISTICS, features)) * 1.0, rng.uniform(0, 2 * np.pi, features), np.zeros(1 + STATISTICS + features), np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def moments(batches):
        total = np.zeros((3, STATISTICS))
        for batch in batches:
            x = _matrix(batch.column(0))
            total += [np.full(STATISTICS, len(x)), x.sum(0), (x * x).sum(0)]
        return total

    first = fit.filter("not late").select("stats", "y")
    sums = sum_rows(first, moments)
    if not len(sums) or not sums[0, 0]:
        discard(fit)
        return model
    n = sums[0, 0]
    model.center = sums[1] / n
    model.scale = np.sqrt(np.maximum(sums[2] / n - model.center**2, 1e-12)) + 1e-6
    spark, size = stats.sparkSession, len(model.weights)
    sent = Sent(spark, model)

    def equations(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = sent.value.expand(_matrix(batch.column(0)))
            total += z.T @ np.column_stack([z, batch.column(1).to_numpy()])
        return total

    both = sum_rows(first, equations)
    model.weights = np.linalg.solve(both[:, :size] / n + ridge * np.eye(size), both[:, size] / n)
    sent = Sent(spark, model)

    def bins(batches):
        total = np.zeros((2, BINS))
        for batch in batches:
            b = np.clip(((sent.value.raw(_matrix(batch.column(0))) + 0.25) / 1.5 * BINS).astype(int), 0, BINS - 1)
            total += [np.bincount(b, minlength=BINS), np.bincount(b, batch.column(1).to_numpy(), minlength=BINS)]
        return total

    model.levels = model.steps
    counts = sum_rows(fit.filter("late").select("stats", "y"), bins)
    discard(fit)
    if len(counts) and counts[0].sum():
        used = counts[0] > 0
        model.steps = ((np.arange(BINS) + 0.5) / BINS * 1.5 - 0.25)[used]
        model.levels = np.clip(isotonic(counts[0][used], counts[1][used] / counts[0][used]), 0.001, 0.999)
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with its statistics replaced by ``score``, from 0 to 1 (in place of a column of that name); empty texts have one too, equal texts the same."""
    names = [c for c in stats.columns if c not in ("stats", "score")]
    sent = Sent(stats.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sent.value.score(_matrix(batch.column(0))))], [*batch.schema.names[1:], "score"])

    return stats.select("stats", *names).mapInArrow(run, stats.select(*names).schema.add("score", "double"))
