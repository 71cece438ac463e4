import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def tables(spark, folder):
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeioustrnlm") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(40)
    docs, labels = [], []
    for k in range(300):
        text = prose(60) + "\nShared footer of the site\n" + prose(20)
        if k % 10 == 0:
            text = text.replace(" ", " idiot ", 3).replace("\n", " scum\n", 1)
        docs.append((k, text))
        labels.append((k, 1, int(k % 10 == 0)))
    near = prose(200).split()
    for k in range(300, 306):
        copy = list(near)
        copy[k - 250] = "changed"
        docs.append((k, " ".join(copy)))
    docs += [(400, prose(30) + " " + item + " " + prose(30)), (401, None), (402, ""), (403, prose(9000))]
    rows = [(i, t, "en", f"src{i % 2}" if i < 300 else "other", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {i: t for i, t in docs}


def test_toxicity_stage_decides_as_operator_9(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "t", "en", "s", 1) for k in range(101)], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(corpus_pipeline, "_table", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline, "learn", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline, "score", lambda d, _: d.withColumn("score", d.doc_id / 100))
    assert {x.doc_id for x in corpus_pipeline.toxicity(spark, docs, "").collect()} == set(range(30))


def test_stages(spark, tmp_path):
    texts, folder = tables(spark, str(tmp_path)), str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        out[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: {x.doc_id for x in out[name].select("doc_id").distinct().collect()}
    assert ids("toxicity") == {i for i in texts if not (i < 300 and i % 10 == 0)}
    lines = {x.doc_id: x.text for x in out["line_dedup"].collect()}
    assert set(lines) == ids("toxicity") and not any(t and "Shared footer" in t for t in lines.values()) and lines[403] == texts[403]
    assert ids("near_duplicates") == ids("line_dedup") - set(range(301, 306))
    assert ids("decontamination") == ids("near_duplicates") - {400}
    assert ids("packing") == ids("decontamination")
    whole = corpus_pipeline.run(spark, folder)
    assert {(x.doc_id, x.start, x.length) for x in whole.collect()} and {x.doc_id for x in whole.collect()} == ids("packing")


def test_stages_on_odd_and_empty_rows(spark, tmp_path):
    folder = str(tmp_path)
    words = " ".join(f"word{k} of" for k in range(60))
    item = " ".join(f"item{k} asks" for k in range(20))
    rows = [(None, words, None, None, 1, 0.5), (None, words, None, None, 1, 0.5), (1, words, "en", None, 1, 0.5), (1, words, "en", None, 1, 0.5), (2, words + " end", "en", "s", 1, None), (3, None, None, "s", None, None), (3, None, None, "s", None, None), (4, "", "en", "s", 0, 1.0), (5, item, "en", None, 1, 0.1), (5, item, "en", None, 1, 0.1)]
    # extra columns carry names that stages use themselves
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").selectExpr("*", "doc_id AS component_id", "text AS line", "1 AS length")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (None, "nothing holds this"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder)
        assert name == "packing" or found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = sorted((x.doc_id for x in found.collect()), key=lambda i: (i is not None, i))
        assert stage(spark, docs.limit(0), folder).count() == 0
    every = [None, None, 1, 1, 2, 3, 3, 4, 5, 5]
    assert kept["toxicity"] == kept["line_dedup"] == every  # labels of one kind reject nothing
    assert set(kept["packing"]) == set(every)  # a row for each piece
    assert kept["near_duplicates"] == [None, None, 1, 1, 3, 3, 4, 5, 5]  # 2 goes for 1
    assert kept["decontamination"] == [None, None, 1, 1, 2, 3, 3, 4]
