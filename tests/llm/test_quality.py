import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from llm.quality import STATISTICS, document_statistics, isotonic, learn, score, statistics


def test_statistics_are_finite():
    texts = pa.array([None, "", " \n\t", "a", "One two. Two!\nthree|", "é" * 10, "x " * 100000, "\0\1"])
    x = statistics(texts)
    assert x.shape == (8, STATISTICS) and np.isfinite(x).all() and not x[:2].any()
    text = "same text\nhere same\nhere same"
    one, two = statistics(pa.array([text])), statistics(pa.array(["junk here\nsame", text, "same x"]))
    assert np.allclose(one[0], two[1])


def slow_statistics(text):
    """The thirty statistics of one text, a word and a line at a time."""
    data = (text or "").encode()
    if not data:
        return [0.0] * STATISTICS
    kind = lambda b: next((k for k, signs in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t"), (5, b"\n"), (6, b"."), (7, b","), (8, b"!"), (10, b"|")) if b in signs), 11 if b > 127 else 9 if 32 < b < 127 else 0)
    kinds = Counter(map(kind, data))
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    some, lengths = max(1, len(words)), [len(w) for w in words] or [0]
    share = lambda found: sum(found) / some
    low = [w.lower() for w in words]  # words are told apart without regard to A-Z
    counts, pairs = Counter(low), Counter(zip(low, [*low[1:], None], strict=False))
    full = [tuple(sorted(re.findall(rb"[^\x20\x09-\x0d]+", line.lower()))) for line in data.split(b"\n")]
    top = lambda c: max(c.values(), default=0)
    return [
        *(kinds[k] / len(data) for k in range(12)), np.log1p(len(data)), np.log1p(len(words)), np.mean(lengths), np.std(lengths),
        share(len(w) <= 2 for w in words), share(len(w) >= 12 for w in words), share(kind(w[0]) == 2 for w in words), share(kind(w[-1]) == 9 for w in words), share(kind(w[-1]) in (6, 7) for w in words),
        share(a == b for a, b in zip(low, low[1:], strict=False)), len(counts) / some, top(counts) / some, -sum(n / some * np.log(n / some) for n in counts.values()),
        len(pairs) / some, np.log1p(top(pairs)), np.log1p(len(full)), len(words) / len(full), (len(set(full[:-1])) + 1) / len(full),
    ]


def test_statistics_equal_a_slow_version():
    r = random.Random(4)
    pieces = ["the", "The", "a", "an", "x1", "word,", "end.", "odd#", "no!", "|", "\u00e9t\u00e9", "extraordinary", "B", "2024", "\0", "~", "{", "\u2003"]
    blanks = [" ", " ", " ", "\n", "\n", "\t", "  ", "\r\n", "\x0b"]
    texts = ["".join(r.choice(pieces) + r.choice(blanks) for _ in range(r.choice([0, 1, 2, 5, 40, 300])))[: r.choice([None, -1])] for _ in range(300)]
    texts += [None, "", "\n", "\n\n\n", " x", "x", "same\nsame\nsame", "same line\n" * 50, "a " * 40_000, "long" * 50_000]
    r.shuffle(texts)
    assert np.allclose(statistics(pa.array(texts, pa.string())), [slow_statistics(t) for t in texts], atol=1e-6)


def test_labels_that_repeat_or_contradict(spark):
    r = random.Random(2)
    rows = [(k, ("!!! " if k % 2 else "calm words ") * r.randint(5, 30)) for k in range(200)]
    stats = document_statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    marks = [(k, 1 - k % 2) for k, _ in rows]
    one = learn(stats, spark.createDataFrame(marks, "doc_id long, quality int"), features=20)
    # repeated labels count once, a contradicted document counts as 0, and what is no label or has no document is left out
    again = [*marks, *marks[:50], *((k, 1) for k, y in marks[:60] if y == 0), (None, 1), (7, None), (9, 5), (10_000, 1)]
    other = learn(stats.withColumn("quality", stats.doc_id), spark.createDataFrame(again, "doc_id long, quality int"), features=20)
    assert np.allclose(one.weights, other.weights) and np.allclose(one.levels, other.levels)


def test_isotonic():
    assert np.allclose(isotonic(np.array([1, 1, 2, 1.0]), np.array([0.1, 0.5, 0.2, 0.9])), [0.1, 0.3, 0.3, 0.9])


def test_learns_held_out(spark):
    r = random.Random(1)
    rows, labels = [], []
    for k in range(800):
        words = ["".join(r.choice("aeiorstn") for _ in range(r.randint(2, 9))) for _ in range(r.randint(30, 90))]
        bad = k % 4 == 0
        rows.append((k, " ".join(w + r.choice(["%%%", "$$$"]) for w in words) if bad and k % 8 else " ".join([words[0].upper() + "!!"] * 40) if bad else ". ".join(words)))
        labels.append((k, int(not bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    stats = document_statistics(docs)
    train = {k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 != 1}
    model = learn(stats, marks.filter(marks.doc_id.isin(sorted(train))))
    got = {x.doc_id: x.score for x in score(stats, model).collect()}
    held = [(got[k], y) for k, y in labels if k not in train]
    assert all(0 <= s <= 1 for s in got.values()) and sum((s >= 0.5) == bool(y) for s, y in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None, 2.0), (2, "", 3.0)], "doc_id long, text string, score double")
    assert len(score(document_statistics(odd), model).collect()) == 2
    none = learn(stats, marks.limit(0))
    assert {x.score for x in score(stats.limit(3), none).collect()} == {0.5}


def test_fit_equals_direct_least_squares(spark):
    r = random.Random(7)
    rows = [(k, " ".join(r.choice(["a", "Bcd", "ef!", "ghijk.", "1"]) for _ in range(r.randint(1, 40)))) for k in range(400)]
    stats = document_statistics(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    labels = spark.createDataFrame([(k, int(len(t) % 3 == 0)) for k, t in rows], "doc_id long, quality int")
    model = learn(stats, labels, features=40)
    late = {x.doc_id for x in labels.filter("pmod(xxhash64(doc_id, 3), 5) = 0").collect()}
    x, y = statistics(pa.array([t for k, t in rows if k not in late])), np.array([float(len(t) % 3 == 0) for k, t in rows if k not in late])
    assert np.allclose(model.center, x.mean(0)) and np.allclose(model.scale, x.std(0), atol=1e-4)
    z = model.expand(x)
    whole = np.vstack([z / np.sqrt(len(z)), np.sqrt(1e-3) * np.eye(z.shape[1])])
    want = np.linalg.lstsq(whole, np.append(y / np.sqrt(len(z)), np.zeros(z.shape[1])), rcond=None)[0]
    assert np.allclose(model.weights, want, atol=1e-6)
    raw = model.raw(statistics(pa.array([t for k, t in rows if k in late])))
    assert (np.diff(model.levels) >= 0).all() and len(raw) == len(late)
