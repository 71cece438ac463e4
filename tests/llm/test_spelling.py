import random
from itertools import combinations

from llm.common import saved, settled_join
from llm.queries import QUERIES
from llm.spelling import count_words, group_variants, letter_runs, neighbours


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts, ratio=2):
    beside = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if near(a, b):
            beside[a].append(b)
            beside[b].append(a)
    form = {}
    for w in counts:
        best = min(beside[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, counts[w], len(beside[w]), form[w], counts.get(form[w]), root(w)) for w in counts)


def grouped(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted(tuple(r) for r in group_variants(words).select("word", "n", "n_near", "form", "form_n", "root").collect())


def key(rows):
    return sorted(rows, key=lambda r: r[0])


def test_random_words_as_brute_force(spark):
    r, counts = random.Random(3), {}
    for letters, most in [("ab", 9), ("abcé÷ß", 6), ("xyz", 12)]:
        counts |= {"".join(r.choice(letters) for _ in range(r.randrange(1, most))): r.choice([3, 3, 5, 6, 12, 50, 400]) for _ in range(250)}
    assert key(grouped(spark, counts)) == key(brute(counts))


def test_a_hub_with_many_variants_and_a_chain(spark):
    hub = "international"
    counts = {hub: 100_000} | {hub[:k] + c + hub[k + 1 :]: 3 for k in range(len(hub)) for c in "qxz"} | {hub[:k] + "w" + hub[k:]: 4 for k in range(len(hub))}
    counts |= {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "bbbbbb": 96}
    assert key(grouped(spark, counts)) == key(brute(counts))


def test_long_words_and_runs_of_one_letter(spark):
    long = "ab" * 700
    counts = {"a" * k: k for k in range(290, 300)} | {long: 3, long[:-1]: 9, long[:600] + "c" + long[601:]: 7, long[1:]: 3, "b" + long: 100}
    assert key(grouped(spark, counts)) == key(brute(counts))


def test_no_words_null_words_and_other_columns(spark):
    assert group_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    words = spark.createDataFrame([(None, 3, 1, 2), ("", 4, 1, 2), ("alone", 5, 1, 2)], "word string, n long, side int, near int")
    assert [tuple(r) for r in group_variants(words).select("word", "n", "n_near", "form", "form_n", "root").collect()] == [("alone", 5, 0, None, None, "alone")]


def test_runs_of_letters(spark):
    docs = spark.createDataFrame([(1, "Hello, WORLD-x Ünï×÷ ñ1bĀc", 0), (None, "x" * 70_000, 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, run int")
    assert sorted(map(tuple, letter_runs(docs).collect()), key=str) == sorted([(1, "hello"), (1, "world"), (1, "x"), (1, "Ünï×÷"), (1, "ñ"), (1, "b"), (1, "c"), (None, "x" * 70_000)], key=str)
    assert count_words(spark.createDataFrame([("abcde",)] * 3 + [("abcdf",)] * 2 + [("abc",)] * 9, "run string")).collect() == [("abcde", 3)]


def test_query_on_repeated_and_null_rows(spark, tmp_path):
    text = "spelling spelling spelling speling"
    spark.createDataFrame([(None, text, "a"), (5, text, "b"), (5, text, "b"), (6, None, None)], "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.word: r for r in QUERIES["op12_spelling"](spark, str(tmp_path)).collect()}
    assert rows["spelling"].n == 9 and rows["speling"].form == "spelling" and rows["speling"].form_n == 9 and rows["speling"].root == "spelling"


def test_nothing_is_broadcast_by_an_estimate(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    words = saved(spark.createDataFrame([(w, n) for w, n in zip(["spelling", "speling", "spellinq", "other", "otter"], range(3, 8))], "word string, n long"))
    pairs = neighbours(words)
    assert sorted((r.word, r.near) for r in pairs.collect()) == [("other", "otter"), ("otter", "other"), ("speling", "spelling"), ("spelling", "speling"), ("spelling", "spellinq"), ("spellinq", "spelling")]
    # A right side counted to be too large is copied by an explode, which Spark's size leaves out.
    hops = saved(pairs.filter("word < near").select("word", "near"))
    assert settled_join(words, hops, "word", limit=0).count() == 3
    plans = [store.executionsList(k, 1).head().physicalPlanDescription() for k in range(before, store.executionsCount())]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
