from collections import Counter

from pyspark.sql import functions as F

import llm.line_dedup as module


def brute(rows, ratio, least):
    pages, lines = Counter(), Counter()
    for _, host, text in rows:
        pages[host] += 1
        for x in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            lines[host, x] += 1
    boiler = {(h, x) for (h, x), n in lines.items() if n >= least and n > ratio * pages[h]}
    out = []
    for i, host, text in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        all_lines = text.split("\n")
        kept = [x for x in all_lines if not x.strip(" ") or (host, x.strip(" ")) not in boiler]
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return Counter(out)


def rows():
    out = [(k, "big" if k % 3 else None, f"head\nline {k}\n  head \n\nfoot {k % 4}\r\nend") for k in range(60)]
    return out + [(100, "small", "only\nonly"), (101, "big", None), (102, "big", ""), (103, "big", "head"), (103, "big", "head"), (104, "big", "x\n" * 20000)]


def test_equals_brute_force_and_salted(spark, monkeypatch):
    df = spark.createDataFrame(rows(), "doc_id long, source string, text string").withColumn("_salt", F.lit(1)).withColumn("lines", F.lit("l"))
    for limit in (1 << 20, 0):
        monkeypatch.setattr(module, "BROADCAST_ROWS", limit)
        out = module.drop_boilerplate(df, "source", "text", 0.2, 5)
        assert out.columns == [*df.columns, "lines_in", "lines_dropped"]
        assert Counter((r.doc_id, r.text, r.lines_in, r.lines_dropped) for r in out.collect()) == brute(rows(), 0.2, 5)
    assert module.drop_boilerplate(df.limit(0)).count() == 0


def test_small_sites(spark):
    df = spark.createDataFrame([(1, "a", "own\nshared"), (2, "a", "other\nshared"), (3, "b", "alone")], "doc_id long, source string, text string").withColumn("lines_in", F.lit("q"))
    got = {r.doc_id: (r.text, r.lines_dropped) for r in module.drop_boilerplate(df).collect()}
    assert got == {1: ("own", 1), 2: ("other", 1), 3: ("alone", 0)}
