import random
import re
from itertools import combinations

from llm.ngram_join import similar_documents

DOCS = "doc_id long, text string"


def brute(rows, n, num, den):
    sets = {}
    for i, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
        sets[i] = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {(i, len(sets[i]), root(i)) for i in sets}


def near_copies(seed=5):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for group in range(6):
        base = [r.choice(vocabulary) for _ in range(r.choice([20, 60, 90]))]
        for _ in range(25):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append(" ".join(words))
    rows += [" ".join(r.choice(vocabulary) for _ in range(30)) + " a common passage of words that many documents hold in full" for _ in range(40)]
    rows += [None, "", " \t\n", "one", "ONE", "one two", "one  two", "ünï cödé wörds", "x " * 5000, "x " * 5001]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_equals_brute_force(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, DOCS)
    for n, num in ((3, 90), (5, 80)):
        found = similar_documents(df, "text", n, num, 100).select("doc_id", "n_shingles", "component_id").collect()
        assert len(found) == len(rows)
        assert {tuple(x) for x in found} == brute(rows, n, num, 100)


def test_blocks_of_one_hub(spark, monkeypatch):
    import llm.ngram_join as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 7)
    rows = near_copies(11)
    found = module.similar_documents(spark.createDataFrame(rows, DOCS), "text", 3, 90, 100)
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in found.collect()} == brute(rows, 3, 90, 100)


def test_empty_and_clashing_columns(spark):
    assert similar_documents(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, "a b c", 5, "q"), (2, "a b c", 6, "r")], "doc_id long, text string, key long, hub string")
    assert {(x.doc_id, x.class_id, x.component_id) for x in similar_documents(df).collect()} == {(1, 1, 1), (2, 1, 1)}
