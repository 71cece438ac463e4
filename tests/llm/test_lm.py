import json
import math
import random
import uuid
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import llm.lm as module
from llm.lm import END, HEAD, WINDOW, Net, fit, likelihoods, score, train


def test_gradients():
    rng = np.random.default_rng(0)
    net = Net.fresh(np.ones(65), np.ones(HEAD))
    h, target = rng.normal(size=(6, net.wc.shape[0])).astype(np.float64), np.array([0, 5, 40, HEAD + 3, END, 1000])
    net.flat = net.flat.astype(np.float64)
    out, dh, g = net.log_probs(h, target, grad=True)
    for row, col in ((0, 1), (3, 2), (5, 7)):
        up, down = h.copy(), h.copy()
        up[row, col] += 1e-4
        down[row, col] -= 1e-4
        slope = -(net.log_probs(up, target)[0].mean() - net.log_probs(down, target)[0].mean()) / 2e-4
        assert abs(slope - dh[row, col]) < 1e-4
    assert set(g) == {"wc", "bc", "u", "bu"} and (out < 0).all()


def test_state_is_carried_across_windows_and_probabilities_add_up():
    net = Net.fresh(np.ones(65), np.ones(HEAD))
    docs = [np.arange(200) % 50, np.zeros(0, np.int64), np.array([3, HEAD + 1])]
    got = likelihoods(net, docs)
    for d, want in zip(docs, got, strict=True):
        h, last, total = np.zeros((1, net.wh.shape[0])), END, 0.0
        for t in [*d, END]:
            h = net.step(net.inputs()[[last]], h)[0]
            total += float(net.log_probs(h, np.array([t]))[0][0])
            last = t
        assert abs(total - want) < 1e-2
    h = np.repeat(np.random.default_rng(1).normal(size=(1, net.wh.shape[0])), END + 1, 0)
    assert abs(np.exp(net.log_probs(h, np.arange(END + 1))[0]).sum() - 1) < 1e-4


def test_training_helps():
    docs = [np.tile([1, 2, 3, 4, 5, 6, 7], 40) for _ in range(60)]
    net = Net.fresh(np.ones(65), np.ones(HEAD))
    before = likelihoods(net, docs[:1])[0]
    train(net, docs)
    assert likelihoods(net, docs[:1])[0] > before / 2 and WINDOW < len(docs[0])


def test_scores(spark):
    r = random.Random(3)
    # two vocabularies that never mix: context tells them apart, single counts do not
    rows = [(k, " ".join(f"{'ab'[k % 2]}{int(r.paretovariate(1))}" for _ in range(r.randint(1, 80)))) for k in range(400)]
    rows += [(900, None), (901, ""), (902, "NEW words ü"), (903, "a1 " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(2))
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    got = {x.doc_id: x for x in score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).collect()}
    tokens = lambda t: [*(t or "").lower().split(), "\n"]
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    for i, t in rows:
        x, words = got[i], tokens(t)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held(i), len(words), sum(counts[w] > 0 for w in words), total)
        assert abs(x.base_score - base) < 1e-6 * max(1, abs(base)) and x.score < 0
    pairs = [(got[i].score, got[i].base_score) for i, _ in rows[:400] if held(i)]
    assert sum(s for s, _ in pairs) > sum(b for _, b in pairs)
    assert score(df.limit(0), F.lit(False)).count() == 0


def test_every_training_document_trains_once_and_copies_are_dealt_apart(spark, monkeypatch, tmp_path):
    def note(net, docs, rate=0.01):
        (tmp_path / uuid.uuid4().hex).write_text(json.dumps([d.tolist() for d in docs]))
        net.flat[:] = len(docs)
        return net

    monkeypatch.setattr(module, "train", note)
    monkeypatch.setattr(module, "SHARD_TOKENS", 1000, raising=False)
    rows = [(k, f"a{k // 60} b{k % 60}") for k in range(3000)] + [(k, "copy copy copy copy") for k in range(3000, 3600)] + [(None, "null")] * 50
    _, net, _, _ = fit(spark.createDataFrame(rows, "doc_id long, text string"), "text")
    shards = [json.loads(f.read_text()) for f in tmp_path.iterdir()]
    seen = Counter(tuple(d) for s in shards for d in s)
    assert sum(seen.values()) == 3650 and len(seen) == 3002 and sorted(seen.values())[-2:] == [50, 600]
    assert max(sum(len(d) == 4 for d in s) for s in shards) < 200
    assert net.flat.std() < 1e-3 * net.flat.mean()


def test_words_are_found_by_the_beginnings_of_their_hashes():
    r = np.random.default_rng(4)
    low = np.uint64(1 << 47)
    close = np.arange(40, dtype=np.uint64) * np.uint64(5) + low * np.uint64(77)  # all begin alike
    table = np.unique(np.concatenate((r.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2), close, np.array([0, (1 << 64) - 1], np.uint64))))
    asked = np.concatenate((table, table + np.uint64(1), table - np.uint64(1), r.integers(0, 1 << 63, 5000, dtype=np.uint64), np.array([0, 1, (1 << 64) - 1, (1 << 64) - 2], np.uint64)))
    for some in (table, table[:1], table[1:-1], table[:0]):
        words = module.Vocabulary(some, np.arange(len(some)), np.zeros(len(some)), np.arange(module.ENDINGS) % module.TAILS, np.zeros(module.TAILS))
        ids, known, at = words.ids(asked, np.full(len(asked), 9))
        place = {int(h): k for k, h in enumerate(some)}
        assert known.tolist() == [int(h) in place for h in asked]
        assert all(some[k] == h and i == (k if k < HEAD else HEAD + 9) for i, k, h in zip(ids[known], at[known], asked[known], strict=True)) and (ids[~known] == HEAD + 9).all()


def test_operations_run_along_tokens_and_large_weights_do_not_overflow():
    net, r = Net.fresh(np.ones(65), np.ones(HEAD)), np.random.default_rng(6)
    h = np.ascontiguousarray(r.uniform(-1, 1, (net.wh.shape[0], 300)).astype(np.float32)).T
    x = net.inputs().T.take(r.integers(0, END + 1, 300), axis=1).T
    assert all(a.flags.f_contiguous for a in (x, net.inputs(), net.step(x, h)[0], net.step(x, h)[3]))
    target = r.integers(0, END + 1, 300)
    calm, dh, _ = net.log_probs(h, target, grad=True)
    assert dh.flags.f_contiguous and dh.shape == h.shape and calm.dtype == np.float32
    net.wc *= 5e5
    net.u *= 5e5
    with np.errstate(over="raise", invalid="raise"):
        wild = net.log_probs(h, target)[0]
    assert np.isfinite(wild[wild > -80]).all() and not np.isnan(wild).any() and (wild <= 0).all()


def test_gradients_of_training_windows():
    net, r = Net.fresh(np.ones(65), np.ones(HEAD)), np.random.default_rng(8)
    docs = [r.integers(0, 60, 50) for _ in range(300)]
    want = Net(net.flat.copy())
    # one window of one update: the first step of Adam has the sign of each gradient
    tokens = np.concatenate([np.append(d, END) for d in docs])[: module.UPDATES * WINDOW]
    one = tokens[:WINDOW]
    train(net, [one[:-1]], rate=1e-3)
    moved = net.flat - want.flat

    def loss(flat):
        return -float(likelihoods(Net(flat), [one[:-1]])[0]) / WINDOW

    checked = 0
    for k in r.permutation(np.flatnonzero(np.abs(moved) > 9e-4))[:60]:
        up, down = want.flat.copy(), want.flat.copy()
        up[k] += 0.02
        down[k] -= 0.02
        slope = (loss(up) - loss(down)) / 0.04
        if abs(slope) > 2e-4:
            assert (slope > 0) == (moved[k] < 0)
            checked += 1
    assert checked >= 10
