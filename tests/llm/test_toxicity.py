import random

import numpy as np
import pyarrow as pa

from llm.toxicity import ERRORS, LEAST_WEIGHT, LONGEST, SHORTEST, Model, _features, fold, learn, score, term_weights


def test_folding():
    assert fold("1D10T") == "idiot" and fold("lоser") == "loser" and fold("st@ge 2024 v2.0") == "stage 2024 v2.0" and fold(None) == ""
    assert fold("ｗｏｒｄ") == "word"


def test_learns_and_spares(spark):
    r = random.Random(2)
    plain = [f"word{k}" for k in range(60)]
    rows, labels = [], []
    for k in range(600):
        words, bad = [r.choice(plain) for _ in range(40)], k % 5 == 0
        if bad:
            for w in r.choices(["zorgle", "z0rgle", "blick"], k=3):
                words.insert(r.randrange(40), w)
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = learn(docs, marks, exceptions=("blick lamp",))
    tests = [("a", "nice word1 zorgle zorglers blick"), ("b", "word1 word2"), ("c", None), ("d", "word3 blick lamp " * 5), ("e", "word1 " * 20000)]
    df = spark.createDataFrame([(i, t, 7.0) for i, t in tests], "doc_id string, text string, score double")
    out = score(df, model)
    assert out.columns == ["doc_id", "text", "score"]
    got = {x.doc_id: x.score for x in out.collect()}
    assert got["a"] > 0.5 > max(got["b"], got["c"], got["d"], got["e"]) and all(0 <= s <= 1 for s in got.values())
    seen = {x.doc_id: x.score >= 0.5 for x in score(docs, model).collect()}
    assert sum(seen[k] == bool(y) for k, y in labels) >= 0.99 * len(labels)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = learn(docs, none)
    assert isinstance(model, Model) and score(docs, model).head().score < 1e-9
    one_sided = spark.createDataFrame([(1, 1), (None, 0), (1, 5)], "doc_id long, toxic int")
    assert score(docs, learn(docs, one_sided)).head().score < 1e-9
    assert score(docs.limit(0), model).count() == 0


def test_matches_equal_a_slow_search():
    r = random.Random(12)
    words = ["bad", "badly", "ba", "worse", "lamp", "worse-lamp", "w0rse", "bаd", "x", "lampbad"]
    model = Model({"bad": 2.0, "badl": 3.0, "wor": 1.5, "lampb": 0.9}, ("worse lamp", "bad x"), np.zeros(5))
    texts = [None, "", " ", "bad" * 3000, "worse lamp"] + [r.choice([" ", ", "]).join(r.choice(words) for _ in range(r.randint(1, 30))) for _ in range(200)]

    def slow(text):
        text = fold(text)
        begins = [k for k in range(len(text)) if not k or not text[k - 1].isalnum()]
        spared = {j for k in begins for p in model.exceptions if text.startswith(p, k) for j in range(k, k + len(p))}
        hits = [max((w for t, w in model.weights.items() if text.startswith(t, k)), default=0.0) for k in begins if k not in spared]
        n = text.count(" ") + text.count("\n") + 1
        total, found = sum(hits), sum(h > 0 for h in hits)
        return 1, np.log1p(total), np.log1p(1000 * total / (n + 100)), np.log1p(found), np.log1p(n)

    assert np.allclose(_features(model.automaton(), pa.array(texts)), [slow(t) for t in texts])


def test_weights_equal_a_slow_count(spark):
    r = random.Random(3)
    docs = [(" ".join(r.choice(["grim", "grimly", "good", "gool", "soft"][k % 2 :]) for _ in range(6)), k % 2) for k in range(200)]
    begins = lambda text: {w[:k] for w in text.split() for k in range(SHORTEST, min(len(w), LONGEST) + 1)}
    rows, log = [], {}
    for t in sorted({t for text, _ in docs for t in begins(text)}):
        n = [sum(t in begins(text) for text, y in docs if y == k) for k in (0, 1)]
        rows.append((t, *n))
        p, q = n[1] + 0.5, n[0] + 0.5
        w = np.log(p / 101) - np.log(q / 101)
        if n[1] and w - ERRORS * np.sqrt(1 / p + 1 / q) >= LEAST_WEIGHT:
            log[t] = w
    want = {}
    for t in sorted(log, key=lambda t: (len(t), t)):
        if all(log[t] >= want[s] + 0.3 for s in want if t.startswith(s)):
            want[t] = log[t]
    got = term_weights(spark.createDataFrame(rows, "term string, without long, with long"), 100, 100)
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)
