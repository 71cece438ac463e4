import random
import re
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa

from llm.common import tidy
from llm.ngram_join import frequent
from llm.textkit import blocks, word_hashes, word_spans


def _peak(f) -> float:
    tracemalloc.start()
    f()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / (1 << 20)


def _kept_now() -> float:
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_hashing_a_block_needs_little_memory_and_pieces_do_not_show():
    r = random.Random(2)
    text = " ".join("".join(r.choices("abcXYZé", k=r.randint(1, 12))) for _ in range(260_000))
    text += " " + "w" * 400_000 + " " + text[:5000]
    (_, _, data, at), = blocks(pa.array([text]))
    starts, ends, _ = word_spans(data, at)
    got = []
    assert _peak(lambda: got.append(word_hashes(data, starts, ends))) < 24  # of which 2 are the result
    some = [*range(0, len(starts), 997), *range(len(starts) - 900, len(starts))]
    alone = [word_hashes(np.ascontiguousarray(data[starts[k] : ends[k]]), np.array([0]), ends[k : k + 1] - starts[k])[0] for k in some]
    assert (got[0][some] == np.array(alone)).all()


def test_frequent_values_take_one_copy():
    r = np.random.default_rng(1)
    parts = [r.integers(0, 1 << 62, 500_000, dtype=np.uint64) for _ in range(3)] + [np.full(20, 7, np.uint64), np.arange(50, dtype=np.uint64)]
    for least in (1, 2, 4, 16, 22, 10**7):
        counts = Counter(np.concatenate(parts[3:]).tolist()) if least > 1 else Counter(np.concatenate(parts).tolist())
        values, n = frequent(list(parts), least)
        assert dict(zip(values.tolist(), n.tolist(), strict=True)) == {v: c for v, c in counts.items() if c >= least}
    assert len(frequent([np.zeros(0, np.uint64)], 4)[0]) == 0
    given = list(parts)
    assert _peak(lambda: frequent(given, 4)) < 20 and not given  # one copy of 11.5 MB; np.unique takes three and more


def test_a_worker_gives_freed_memory_back():
    pins = []

    def run(batches):
        for batch in batches:
            held = []
            for _ in range(40_000):  # small blocks, with something that stays between
                held.append(np.ones(400))
                if len(held) % 4000 == 0:
                    pins.append(bytes(900))
            yield batch
            del held

    before = _kept_now()
    assert len(list(tidy(run)([1]))) == 1
    assert _kept_now() - before < 40  # of 122
