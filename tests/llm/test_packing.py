import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from llm.packing import Encoder, balance, capacities, pack

ODD = [None, "", " ", "  ", "a", "a ", "a  b", "a \n b", "a\n \nb", "a\n b", "\ta b", "x's it's  'S", "naïve  café  x", "<|endoftext|> a", "b<|endoftext|>", "a <|endoftext|>  <|endoftext|>", "a word<|endoftext|>, x", "one.\nTwo,\nthree\n\nfour\t\nfive \nsix\n", "x ab's, c'll! it'", "a é,\nÉ. ×x÷ a_b_ _", "q \"quoted\" (word) end.)", "\r\n a \r\n", "1 2 3  45", "a\u0085 b", "é " * 50, "日本 語 テキスト", "a\x1c b", " \n", "\n ", "word " * 9000]


def test_ids_equal_the_tokenizers_library():
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ours = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ODD:
        assert ours.document(text) == np.array(reference.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_ids_of_real_texts():
    import pyarrow.parquet as pq

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ours = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist():
        assert ours.document(text) == np.array(reference.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_balance_is_a_partition_without_padding():
    r = random.Random(4)
    lengths = [r.randint(1, 2047) for _ in range(700)] + [1] * 50
    pieces, cost = balance(lengths, 2048)
    by_doc, by_sequence = {}, {}
    for doc, start, size, k, offset in pieces:
        by_doc.setdefault(doc, []).append((start, size))
        by_sequence.setdefault(k, []).append((offset, size))
    for doc, length in enumerate(lengths):
        at = 0
        for start, size in sorted(by_doc[doc]):
            assert start == at and size > 0
            at += size
        assert at == length
    for k, parts in by_sequence.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == 2048 or at & (at - 1) == 0
    assert len(cost) == len(by_sequence) and sum(capacities(sum(lengths), 2048)) == sum(lengths)


def test_balance_takes_the_lowest_cost_sequence_with_room():
    r = random.Random(6)
    for square in (64, 4096):
        lengths = [r.choice([1, 3, r.randint(1, 255)]) for _ in range(120)]
        room = capacities(sum(lengths), 256)
        cost, filled, waiting, want = [0.0] * len(room), [0] * len(room), [(-n, doc, 0) for doc, n in enumerate(lengths)], []
        while waiting:  # the rule by search over all sequences
            waiting.sort()
            n, doc, start = waiting.pop(0)
            fit = [k for k in range(len(room)) if room[k] >= -n]
            k = min(fit, key=lambda k: (cost[k], k)) if fit else max(range(len(room)), key=lambda k: (room[k], -k))
            now = min(-n, room[k])
            want.append((doc, start, now, k, filled[k]))
            filled[k], room[k], cost[k] = filled[k] + now, room[k] - now, cost[k] + now + now * now / square
            if now < -n:
                waiting.append((n + now, doc, start + now))
        pieces, costs = balance(lengths, 256, square)
        assert pieces == want and np.allclose(costs, cost)


def test_pack(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)], "doc_id long, text string, ids string")
    rows = pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    encoder, got = Encoder(public_tokenizers.path("byte_bpe_50k.json")), {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
    for k, text in enumerate(ODD):
        whole = b"".join(x[1] for x in sorted(got[k]))
        assert whole == encoder.document(text) + np.array([1], "<u4").tobytes() and got[k][0][2] == len(whole) // 4
    seen = {}
    for r in rows:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seen.values():
        total = sum(p[1] for p in parts)
        assert total == 2048 or total & (total - 1) == 0
    assert pack(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
