import random

import numpy as np
from pyspark.sql import functions as F

from llm.substring_dedup import LENGTH, drop_repeats, suffix_order


def brute(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - LENGTH + 1):
            w = b[p : p + LENGTH]
            if w in seen:
                cover[p : p + LENGTH] = b"\1" * LENGTH
            seen.add(w)
        spans = [(k, cover.index(0, k) if 0 in cover[k:] else len(b)) for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1])]
        out[i] = (len(b), spans, bytes(x for x, c in zip(b, cover) if not c))
    return out


def texts():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(60), prose(150)
    rows = [None, "", "short", "x" * 99, "x" * 100, "x" * 101, "ab" * 400, base, base, base[:300] + "#" + base[300:], base.replace(" a", " b"), passage, "\0" * 250, prose(20) + "\0" * 120]
    rows += [prose(r.randint(1, 40)) + passage[r.randint(0, 60) :] + prose(30) for _ in range(20)]
    rows += [base[k : k + 150] for k in range(0, 400, 37)]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_equals_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).repartition(5)
    got = {r.doc_id: (r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in drop_repeats(df).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_empty(spark):
    long = "y" + "abc " * 60
    df = spark.createDataFrame([(1, long), (1, long), (2, "other " * 30), (2, long), (None, long)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes) for r in drop_repeats(df).collect())
    assert len(got) == 5
    assert drop_repeats(df.limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    rows = texts()
    long = max((t for _, t in rows if t), key=len)
    rows += [(len(rows), "z" + long[50:] + "z")]
    want = brute(rows)
    df = spark.createDataFrame(rows + rows[::2] + rows[::3], "doc_id long, text string")
    for parts in (1, 7):
        out = drop_repeats(df.repartition(parts)).collect()
        assert len(out) == df.count()
        for r in out:
            assert (r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) == want[r.doc_id]


def test_suffix_order_is_lexicographic():
    r = np.random.default_rng(2)
    size = r.integers(LENGTH, 160, 60)
    rows = np.zeros((60, 168), np.uint8)
    for k, n in enumerate(size):
        rows[k, :n] = r.integers(0, 3, n)
    rows[30:40] = rows[5]
    size[30:40] = size[5]
    order = suffix_order(rows, size)
    of = lambda cell: rows[cell // 168, cell % 168 : cell % 168 + LENGTH].tobytes()
    want = sorted(of(k * 168 + c) for k in range(60) for c in range(size[k] - LENGTH + 1))
    assert [of(c) for c in order] == want
