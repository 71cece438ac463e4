"""Grouping of spelling variants: words one edit apart are found by walking the frontier of a trie kept as a table of edges.

A state is (word, path, candidate, depth): the candidate is the word with one edit, and its first ``depth`` letters are known to be a node of the
trie.  A word of m letters differs from a near word either in its first or in its second half, so each word walks two tries, of all words forwards and
of all words backwards, and is edited in the second half of its path alone; before that it is on its own path, which needs no look-up.  Tries are kept apart
by the words' length, so that an edit that replaces stays in its trie and one that deletes goes to the next shorter one; insertions are
deletions seen from the other word.  States advance by joins with the edges, in strides that double, so that the rounds grow with the logarithm of
the longest word; states whose node is not there vanish.

Joins here shuffle whatever Spark takes a table's size for: it knows the compressed files alone, and not that words become many rows by an explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_shuffle, discard, saved, settled_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIRST_STRIDE = 2


def letter_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run) of the maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) of each ``text``, A-Z lower-cased; a null text has none."""
    low = F.translate("text", UPPER, LOWER)
    return docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit("[a-zÀ-ÿ]++"), F.lit(0))).alias("run"))


def count_words(runs: DataFrame, least: int = 3, shortest: int = 5) -> DataFrame:
    """(word, n) of the distinct ``run`` values of at least ``shortest`` code points that occur at least ``least`` times."""
    counted = runs.filter(F.length("run") >= shortest).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least)


def _node(side: Column, path: Column, depth: Column, length: Column) -> Column:
    """The trie node reached by the first ``depth`` letters: a hash, for candidates are compared with words in full at the end."""
    return F.xxhash64(side, length, F.left(path, depth))


def _letter(path: Column, at: Column) -> Column:
    return F.substring(path, at + 1, F.lit(1))


def _without(path: Column, at: Column, new: Column | None = None) -> Column:
    """``path`` with the letter at ``at`` taken out, or replaced by ``new``."""
    return F.concat(F.left(path, at), *([] if new is None else [new]), F.substring(path, at + 2, F.length(path)))


def neighbours(words: DataFrame) -> DataFrame:
    """Pairs (word, near, near_n), both ways, of ``words(word, n)`` (distinct, saved) that differ by one inserted, deleted or replaced code point."""
    side, path, at, length = F.col("side"), F.col("path"), F.col("at"), F.length("path")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("path")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("path")))
    paths = words.select("word", "n", F.explode(sides).alias("p")).select("word", "n", "p.*")
    half = F.when(side == 0, F.floor(length / 2)).otherwise(length - F.floor(length / 2)).cast("int")
    # Every word at every place of the second half of its path: states without an edit, and the edges of the trie that edited states may use.
    steps = paths.filter(half < length).select("*", F.explode(F.sequence(half, length - 1)).alias("at"))
    edges = saved(steps.select(_node(side, path, at, length).alias("node"), _letter(path, at).alias("letter"), _node(side, path, at + 1, length).alias("child")).distinct())
    # A node has as many children as there are letters at most; those with one child leave nothing to replace by.
    forks = saved(edges.groupBy("node").agg(F.sort_array(F.collect_set("letter")).alias("letters")).filter(F.size("letters") > 1))
    replaced = steps.withColumn("node", _node(side, path, at, length)).join(by_shuffle(forks), "node")
    replaced = replaced.withColumn("new", F.explode(F.filter("letters", lambda x: x > _letter(path, at))))  # the other word finds the smaller letters
    replaced = replaced.select("word", "n", "side", _without(path, at, F.col("new")).alias("path"), (at + 1).alias("depth"))
    # Of a run of equal letters, the last of the word is deleted.
    next_at = F.when(side == 0, at + 1).otherwise(at - 1)
    last = (next_at < 0) | (next_at >= length) | (_letter(path, next_at) != _letter(path, at))
    deleted = steps.filter(last & (length > 1)).select("word", "n", "side", _without(path, at).alias("path"), at.alias("depth"))
    nodes = edges.select(F.col("child").alias("node")).distinct()
    front, ends, stride, scratch = replaced.unionByName(deleted), [], FIRST_STRIDE, [edges, forks]
    while True:
        front = front.withColumn("depth", F.least(F.col("depth") + stride, F.length("path")))
        front = front.withColumn("node", F.when(F.col("depth") < F.length("path"), _node(side, path, F.col("depth"), F.length("path"))))
        front = saved(front)
        scratch.append(front)
        ends.append(front.filter("node is null"))
        rest = front.filter("node is not null")
        if rest.isEmpty():
            break
        front, stride = rest.join(by_shuffle(nodes), "node", "left_semi").drop("node"), 2 * stride
    done = ends[0]
    for more in ends[1:]:
        done = done.unionByName(more)
    done = done.select("word", "n", F.when(side == 0, path).otherwise(F.reverse(path)).alias("near"))
    found = done.join(by_shuffle(words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))), "near")
    both = F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    pairs = saved(found.select(F.explode(both).alias("p")).select("p.*"))
    discard(*scratch)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word when ``forms(word, form)`` (saved, without circles) is followed from word; each round doubles the steps."""
    last = forms.select("word", F.col("form").alias("root"))
    made: list[DataFrame] = []
    while True:
        hop = last.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = saved(settled_join(last, hop, "root", "left"))
        if made:
            discard(made.pop())
        last = step.select("word", F.coalesce("far", "root").alias("root"))
        if step.filter("far is not null").isEmpty():
            return last
        made.append(step)


def group_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``words(word, n)``, distinct, as word, n, n_near, form, form_n and root.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that is at least ``ratio`` (2 or more) times its own, else
    null; root is the last of word, form, form's form and so on.  Null and empty words are left out; a word without near words is its own root.
    """
    words = saved(words.filter("word != ''").select("word", "n"))
    pairs = neighbours(words)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    rows = words.join(by_shuffle(best), "word", "left")
    fits = -F.col("best.minus") >= ratio * F.col("n")
    rows = saved(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n")))
    discard(pairs)
    ends = roots(rows.filter("form is not null").select("word", "form"))
    return rows.join(by_shuffle(ends), "word", "left").withColumn("root", F.coalesce("root", "word"))
