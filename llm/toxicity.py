"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding puts letters in lower case, replaces look-alike letters of other alphabets, and reads digits and signs
within words as the letters they stand for.  The lexicon holds word beginnings and its weights are log-odds of
document counts, learnt with Spark from labelled documents; words of exception phrases do not count.  What a text
holds, normalised by its length, goes through a logistic curve fitted on labelled documents that the lexicon was not learnt from.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, Sent, tidy

#: The bound of the fit: labelled documents used (a hash sample beyond it).  The lexicon has all terms of these that qualify.
FIT_ROWS = 20_000
SHORTEST, LONGEST = 3, 10
#: Terms that a task counts before it hands its counts on; they are summed by term.
HELD_TERMS = 50_000
#: A term's log-odds must exceed this by so many standard errors, which leaves out terms of too few documents to tell.
LEAST_WEIGHT, ERRORS = 0.8, 2.0

# Letters of other alphabets that look like Latin ones, and digits and signs written for letters.
LOOKALIKES = str.maketrans("аеорсухіјѕһԁԛԝкмтвнгοαεικνρτυχηɑɡℓı", "aeopcyxijshdqwkmtbhroaeiknptuxhagli")
DIGITS = str.maketrans("0134578@$", "oieastbas")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pathetic fallacy", "class clown anemonefish")

_WRITTEN = re.compile(r"(?<![^\W_])[0134578@$]{1,2}(?=[^\W\d_])|(?<=[^\W\d_])[0134578@$]{1,2}(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(LOOKALIKES)
    return _WRITTEN.sub(lambda m: m[0].translate(DIGITS), text)


def _beginnings(text: str) -> set[str]:
    return {w[:k] for w in set(_WORD.findall(fold(text))) for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of either label each word beginning occurs: parts of these counts, several for a term of a large partition."""
    counts: dict[str, list[int]] = {}

    def part() -> pa.RecordBatch:
        columns = [pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, ["term", "without", "with"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            for term in _beginnings(text.as_py()):
                counts.setdefault(term, [0, 0])[toxic] += 1
            if len(counts) >= HELD_TERMS:
                yield part()
    yield part()


@dataclass
class Model:
    """Weights of word beginnings, exception phrases, and the logistic curve over what ``features`` gives."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: np.ndarray

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(fold(phrase), (len(fold(phrase)), None))
        found.make_automaton()
        return found


def _features(automaton: ahocorasick.Automaton, texts: pa.Array) -> np.ndarray:
    out = np.zeros((len(texts), 5))
    for row, text in enumerate(texts):
        text = fold(text.as_py())
        hits, spared = {}, []
        if len(automaton):
            for end, (size, weight) in automaton.iter(text):
                start = end - size + 1
                if start and text[start - 1].isalnum():
                    continue
                if weight is None:
                    spared.append((start, end))
                elif weight > hits.get(start, 0.0):
                    hits[start] = weight
        if spared:
            hits = {s: w for s, w in hits.items() if not any(a <= s <= b for a, b in spared)}
        total, words = sum(hits.values()), text.count(" ") + text.count("\n") + 1
        out[row] = 1, np.log1p(total), np.log1p(1000 * total / (words + 100)), np.log1p(len(hits)), np.log1p(words)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _featured(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.value.automaton()
        for batch in batches:
            x = _features(automaton, batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x.T] + [batch.column(1)], [f"x{k}" for k in range(5)] + ["toxic"])

    return run


def term_weights(counts: DataFrame, clean: int, toxic: int) -> dict[str, float]:
    """Log-odds of the terms of ``counts(term, without, with)`` that qualify, each longer one only where it says more than its beginnings."""
    p, n = F.col("with") + 0.5, F.col("without") + 0.5
    weight = F.log(p / (toxic + 1)) - F.log(n / (clean + 1))
    rows = counts.filter("with > 0").select("term", weight.alias("weight")).filter(F.col("weight") - ERRORS * F.sqrt(1 / p + 1 / n) >= LEAST_WEIGHT)
    terms: dict[str, float] = {}
    for row in sorted(rows.collect(), key=lambda r: (len(r.term), r.term)):
        shorter = max((terms[row.term[:k]] for k in range(SHORTEST, len(row.term)) if row.term[:k] in terms), default=-9.0)
        if row.weight >= shorter + 0.3:
            terms[row.term] = row.weight
    return terms


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = FIT_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Fit on ``labels(doc_id, toxic)`` and their documents: at most about ``rows`` of them, chosen by a hash of doc_id.

    Half of these give the lexicon (what is collected are its terms, bounded by their texts), the other half the curve.  Labels other
    than 0 and 1 and those without doc_id are left out; a document with contradicting labels counts as toxic.  Null texts are empty, long ones
    are taken whole, repeated documents count each.  Without labelled documents of both kinds in both halves nothing
    can be learnt: then every score is 0, so that no document is rejected.  Other columns are ignored.
    """
    spark = docs.sparkSession
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, rows / max(1, labels.count()))
    chosen = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    fit = saved(docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)) == 0).alias("lexicon")))
    sizes = {(r.lexicon, r.toxic): r["count"] for r in fit.groupBy("lexicon", "toxic").count().collect()}
    model = Model({}, exceptions, np.array([-1000.0, 0, 0, 0, 0]))
    if len(sizes) < 4:
        discard(fit)
        return model
    counts = fit.filter("lexicon").select("text", "toxic").mapInArrow(tidy(_count_terms), "term string, without long, with long").groupBy("term").agg(F.sum("without").alias("without"), F.sum("with").alias("with"))
    model.weights = term_weights(counts, sizes[True, 0], sizes[True, 1])
    sent = Sent(spark, model)
    schema = ", ".join(f"x{k} double" for k in range(5)) + ", toxic int"
    seen = fit.filter("not lexicon").select("text", "toxic").mapInArrow(tidy(_featured(sent)), schema).toPandas()
    model.curve = _logistic(seen[[f"x{k}" for k in range(5)]].to_numpy(float), seen["toxic"].to_numpy(float))
    discard(fit)
    return model


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, curve = model.value.automaton(), model.value.curve
        for batch in batches:
            x = _features(automaton, batch.column(0))
            score = 1 / (1 + np.exp(-np.clip(x @ curve, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score)], [*batch.schema.names[1:], "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1, higher: more likely toxic) at its end, in place of one of that name; null texts count as empty.

    Every row is scored by its whole text alone, so repeated rows score alike; rows and other columns stay as they are.  An empty table stays empty.
    """
    names = [c for c in docs.columns if c != "score"]
    sent = Sent(docs.sparkSession, model)
    wide = docs.select(F.col(text).alias("__text"), *names)
    schema = docs.select(*names).schema.add("score", "double")
    return wide.mapInArrow(tidy(_scored(sent)), schema)
