import json

from pyspark.sql import functions as F

from sitepack.operators import extract, payload, report, resolve, rewrite
from sitepack.sources import io


def build(spark, files, keys=()):
    pages = spark.createDataFrame([("s", p, t) for p, t in files.items()], "site string, page string, text string")
    tags = extract.tags(pages)
    names = [("s", p) for p in files] + [("s", k[0]) for k in keys]
    refs = resolve.look_up(resolve.resolve(extract.references(tags).withColumn("base", F.col("page"))), spark.createDataFrame(names, "site string, rel string"))
    store = spark.createDataFrame([("s", *k) for k in keys], "site string, rel string, is_text boolean, key string")
    return pages, tags, refs, store


def test_rewrite(spark):
    key = "k" * 16
    html = '<html manifest=m><head><meta charset=sjis><base target="_self"><title>t</title></head><body><a href="b.html?x#y" target=_self>b</a><a href=#f>f</a><a href="n.zip">z</a><img src="i.png#q" srcset="i.png 1x, gone.png 2x"><script src="s.js" integrity="abc" crossorigin></script><a href="https://e.org" target=_self>e</a><meta http-equiv=refresh content="1.5;url=b.html"></body></html>'
    pages, tags, refs, store = build(spark, {"a.html": html, "b.html": "<p>b"}, [("n.zip", False, key), ("i.png", False, key), ("s.js", True, key)])
    heads = extract.page_heads(tags, ["site", "page"])
    changes = rewrite.link_changes(refs, tags, store)
    for more in (rewrite.resource_changes(refs, store, tags), rewrite.removal_changes(tags), rewrite.head_changes(tags, heads, "shim()"), rewrite.refresh_changes(refs, tags)):
        changes = changes.unionByName(more)
    out = {r.page: r.text for r in rewrite.apply_changes(pages, changes).collect()}["a.html"]
    token = f"sitepack-res-{key}"
    for part in ('href="#/b.html?x#y"', 'data-sitepack-route="route"', 'href="#/a.html#f"', f'href="{token}"', 'download="n.zip"', f'src="{token}#q"', f'srcset="{token} 1x, gone.png 2x"', f'<script src="{token}"', '<head><meta charset="utf-8"><base target="_top"><script>shim()</script>', 'data-sitepack-page="a.html"', "<script>setTimeout(function(){top.location.hash=\"#/b.html\"},1500);</script>", '<a href="https://e.org" >e</a>'):
        assert part in out, (part, out)
    for part in ("sjis", "integrity", "crossorigin", "_self", "manifest", "http-equiv"):
        assert part not in out, (part, out)


def test_frames(spark):
    from sitepack.operators import graph

    files = {"a.html": '<iframe src="b.html"></iframe>', "b.html": 'B<iframe src="c.html"></iframe>', "c.html": 'C"<iframe src="a.html"></iframe>'}
    pages, tags, refs, _ = build(spark, files)
    edges = refs.filter("role = 'frame'").select("site", F.col("page").alias("src"), F.col("rel").alias("dst"), F.col("seq").cast("long").alias("seq"))
    embedded, refused = graph.closure(edges, pages.select("site", "page").filter("page = 'a.html'"))
    out = rewrite.embed_frames(pages, embedded).head().text
    assert 'srcdoc="B&lt;iframe' in out and "C&amp;quot;&amp;lt;iframe" in out and 'src="b.html"' not in out and refused.count() == 1


def test_sprites(spark):
    html = '<body><svg><use href="s.svg#dot"/></svg><svg><use href="s.svg#bar"/></svg><svg><use href="s.svg"/></svg><svg><use href="t.svg#x"/></svg></body>'
    pages, tags, refs, _ = build(spark, {"a.html": html, "s.svg": "", "t.svg": ""})
    sprites = spark.createDataFrame([("s", "s.svg", '<?xml version="1.0"?><svg><symbol id="dot"/></svg>'), ("s", "t.svg", "no")], "site string, rel string, text string")
    changes, bad = rewrite.sprite_changes(refs.filter("page = 'a.html'"), sprites, tags.filter("page = 'a.html'"))
    out = {r.page: r.text for r in rewrite.apply_changes(pages, changes).collect()}["a.html"]
    assert out.count("<symbol") == 1 and 'href="#dot"' in out and 'href="#bar"' in out and out.startswith("<body><svg aria-hidden")
    assert {r.code for r in bad.collect()} == {"sprite_without_fragment", "sprite_not_svg"}


def test_payload_round_trip(spark):
    hostile = 'a</script><!--    "quoted" \\ \n é'
    pages = spark.createDataFrame([("s", "i.html", hostile, f"<p>{hostile}"), ("s", "b.html", "", "")], "site string, page string, title string, html string")
    res = spark.createDataFrame([("s", "1" * 16, "text/css", True, hostile), ("s", "2" * 16, "image/png", False, "data:image/png;base64,AA")], "site string, key string, mime string, is_text boolean, value string")
    sites = spark.createDataFrame([("s", "i.html"), ("empty", "x.html")], "site string, entry string")
    packed = payload.payloads(sites, pages, res)
    text = {r.site: r.payload for r in packed.collect()}
    assert not any(x in text["s"] for x in ("</", "<!--", " ", " ", "\n"))
    assert json.loads(text["s"])["pages"]["i.html"]["title"] == hostile and json.loads(text["empty"])["pages"] == {}
    heads = spark.createDataFrame([("s", "i.html", "T & <t>", "fr")], "site string, page string, title string, lang string")
    docs = payload.documents(packed, payload.titles(sites, heads))
    html = {r.site: r.html for r in docs.collect()}
    assert "<title>T &amp; &lt;t&gt;</title>" in html["s"] and ' lang="fr"' in html["s"] and "lang" not in html["empty"].split("<head>")[0] and "<title>empty</title>" in html["empty"]
    back, stored = payload.read_back(docs)
    assert {(r.page, r.title, r.html) for r in back.collect()} == {("i.html", hostile, f"<p>{hostile}"), ("b.html", "", "")}
    assert {(r.key[0], r.mime, r.is_text, r.value) for r in stored.collect()} == {("1", "text/css", True, hostile), ("2", "image/png", False, "data:image/png;base64,AA")}
    broken = spark.createDataFrame([("s", "i.html", '<a href="#/gone.html">sitepack-res-' + "f" * 16)], "site string, page string, html string")
    assert {(r.kind, r.name) for r in payload.integrity(broken, res).collect()} == {("resource", "f" * 16), ("page", "gone.html")}


def test_diagnostics(spark):
    _, _, refs, _ = build(spark, {"a.html": '<a href="gone.html"></a><a href="../../x"></a><a href="100%"></a><form action="b.html"></form><link rel=next href="nope.html"><link rel=prefetch href=p>', "b.html": ""})
    rows = report.diagnostics(refs)
    assert sorted(r.code for r in rows.collect()) == ["form", "invalid", "missing", "outside", "removed"]
    assert {(r.level, r.n) for r in report.level_counts(rows).collect()} == {("warning", 4), ("info", 1)}
    assert report.strict_failures(rows).head().warnings == 4 and report.visible(rows).count() == 4
    line = spark.createDataFrame([("warning", "p", 'r"', "m"), ("info", "", "", "m")], "l string, p string, r string, m string").select(report.format_line(*(F.col(c) for c in "lprm"))).collect()
    assert [r[0] for r in line] == ['warning: p: "r\\"": m', "info: m"]


def test_sizes(spark):
    cases = {"10": 10, "5B": 5, "64K": 65536, "1.5MB": 1572864, "2GiB": 2 << 30, "1k": 1024, "1T": None, "": None, "x": None, "-1": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", report.parse_size(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KiB", 1536: "1.5 KiB", 1 << 20: "1.0 MiB", 3 << 30: "3.0 GiB"}
    rows = spark.createDataFrame([(k,) for k in sizes], "n long").select("n", report.human_size(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in rows} == sizes


def test_sources(spark, tmp_path):
    trees = {"one/index.html": b"<p>", "one/docs/a.html": b"x", "two/b.css": b"z", "one/_static/.e": b"", "two/a b%20/\u00e4.txt": b"long" * 9, "two/b/c/d/e": b"", "no site": b"x"}
    for name, data in trees.items():
        (tmp_path / "sites" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "sites" / name).write_bytes(data)
    for root in (str(tmp_path / "sites"), (tmp_path / "sites").as_uri() + "/"):
        got = {f"{r.site}/{r.rel}": (bytes(r.content), r.length) for r in io.read_trees(spark, root, 10).collect()}
        assert got == {k: (v, len(v)) for k, v in trees.items() if k != "no site"}
    (tmp_path / "none").mkdir()
    assert io.read_trees(spark, str(tmp_path / "none")).count() == 0
    bundles = spark.createDataFrame([("s", 0, "<html>"), ("t", 0, "x")], "site string, part long, text string")
    io.write_bundles(bundles, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    io.write_tables(str(tmp_path / "tables"), pages=spark.createDataFrame([("s", 1)], "site string, ord long"))
    assert spark.read.parquet(str(tmp_path / "tables/pages")).count() == 1
    used = spark.createDataFrame([("s", "b"), ("s", "a"), ("s", "b")], "site string, rel string")
    assert [r.rel for r in io.manifest(used, used).collect()] == ["a", "b"]


def test_modules_and_unreadable_pages(spark):
    from sitepack.operators import graph

    html = '<script type=module>import "./x.js"</script><script type=module src="m.js"></script><script type=module src="n.js"></script><script>import "y"</script>'
    _, tags, refs, _ = build(spark, {"a.html": html}, [("m.js", True, "k"), ("n.js", True, "k")])
    scripts = spark.createDataFrame([("s", "m.js", "import a from 'b'"), ("s", "n.js", "let a")], "site string, rel string, text string")
    assert sorted(r.ref for r in extract.module_imports(tags, refs, scripts).collect()) == ["", "m.js"]
    edges = spark.createDataFrame([("s", "a", "b", 0), ("s", "b", "c", 0)], "site string, src string, dst string, seq long")
    bad = spark.createDataFrame([("s", "b")], "site string, page string")
    reached = graph.crawl(graph.readable_edges(edges, bad), spark.createDataFrame([("s", "a")], "site string, entry string"))
    fine, met = graph.readable_pages(reached, bad)
    assert [r.page for r in fine.collect()] == ["a"] and [r.code for r in met.collect()] == ["unreadable"]
    diags = report.diagnostics(refs, met, extract.module_imports(tags, refs, scripts))
    assert sorted(r.code for r in diags.collect()) == ["module_import", "module_import", "unreadable"]
    sites = spark.createDataFrame([("s", "a.html")], "site string, entry string")
    rows = report.summary(sites, reached.select("site", "page"), spark.createDataFrame([("s", "T")], "site string, title string"), spark.createDataFrame([("s", 2, 30)], "site string, resources long, resource_bytes long"))
    assert tuple(rows.head()) == ("s", "a.html", "T", 2, 2, 30)
    kinds = spark.createDataFrame([("s", "missing")], "site string, kind string")
    assert graph.entry_errors(sites, kinds).head().code == "entry_missing"


def test_changes_of_long_tags(spark):
    from sitepack.operators.rewrite import change_segment

    long = "x" * 50_000
    cases = [(f"<a title={long} HREF=b>", "set", "href", "c", f'<a title={long} href="c">'), (f'<img alt="{long}>" src=\'q\'/>', "drop", "src", "", f'<img alt="{long}>" />'), ("<a>", "set", "href", 'x"$1\\', '<a href="x&quot;$1\\">'), ("<a data-href=1 href>", "set", "href", "z", '<a data-href=1 href="z">'), ("<script src=a>href=1</script>", "set", "href", "k", '<script href="k" src=a>href=1</script>'), ("<b id='href=9' x>", "drop", "href", "", "<b id='href=9' x>")]
    df = spark.createDataFrame(cases, "s string, op string, attr string, value string, want string")
    for r in df.withColumn("got", change_segment(F.col("s"), F.col("op"), F.col("attr"), F.col("value"))).collect():
        assert r.got == r.want, r.s[:40]
