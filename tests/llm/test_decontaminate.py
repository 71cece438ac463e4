import random

from llm.decontaminate import contained_items, without_contaminated


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_equals_brute_force(spark):
    r = random.Random(8)
    words = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    items = [(k, " ".join(words(r.choice([3, 8, 25, 60, 300])))) for k in range(40)] + [(90, None), (91, ""), (92, "two words")]
    docs = [(0, None), (1, ""), (2, "two words"), (3, "two words more")]
    for k in range(10, 70):
        body = words(r.choice([5, 200, 4000]))
        item = r.choice(items[:40])[1].split()
        for _ in range(r.choice([0, 0, 1, 2])):
            item[r.randrange(len(item))] = "changed"
        at = r.randrange(len(body))
        docs.append((k, " ".join(body[:at] + (item if k % 3 else []) + body[at:]).upper() if k % 2 else " ".join(body[:at] + item + body[at:])))
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i, len(s & shingles(t)), len(s)) for i, x in items if (s := shingles(x)) for d, t in docs if 100 * len(s & shingles(t)) >= 80 * len(s)}
    assert want and {tuple(x) for x in contained_items(df, bench).collect()} == want
    kept = without_contaminated(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {d for d, _ in docs} - {w[0] for w in want}
    assert contained_items(df.limit(0), bench).count() == 0 and contained_items(df, bench.limit(0)).count() == 0


def test_scattered_items(spark):
    """Items whose shingles lie one by one, in any order and far apart, a fifth of them left out, are found all the same."""
    r = random.Random(9)
    words = lambda n: [f"v{r.randrange(1 << 40)}" for _ in range(n)]
    items, docs = [], []
    for k, (size, gap) in enumerate([(s, g) for s in (1, 2, 9, 33, 129) for g in (5, 60, 300)]):
        item = words(size + 4)
        body = [w for at in r.sample(range(size), -(-size * 8 // 10)) for w in words(gap) + item[at : at + 5]]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(body + words(gap))))
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in contained_items(df, bench).collect()} == {(k, k) for k in range(len(items))}
