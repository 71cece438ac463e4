import base64
import re

from pyspark.sql.functions import input_file_name

from sitepack.operators import expansion, graph, parts, spread
from sitepack.plans.build import build

PAGE = '<html><head><meta charset="koi8-r"><base href="sub/"><meta http-equiv="Content-Security-Policy" content="x"></head><body><a href="../b.html">b</a><a href="../drafts/c.html">c</a><a href="big.bin">big</a><a href="small.bin">small</a><link rel="stylesheet" href="s.css"><script src="t.js"></script><img src="https://e.org/i.png"><form action="../b.html"></form></body></html>'


def files():
    rows = {
        "index.html": PAGE.encode("koi8-r"), "b.html": b'<p>b<iframe src="index.html"></iframe>', "drafts/c.html": b"no", "lost.html": b'<img src="sub/big.bin">',
        "sub/big.bin": b"x" * 100, "sub/small.bin": b"y" * 10, "sub/s.css": 'a::after { content: "\u0436" } b { src: url(gone.woff) }'.encode("koi8-r"), "sub/t.js": '"\u0436"'.encode("koi8-r"), "sub/empty.css": b"",
    }
    return [("one", k, bytearray(v)) for k, v in rows.items()] + [("two", "x.html", bytearray(b"x"))]


SITE = "site string, entry string"
FILES = "site string, rel string, content binary"


def test_build(spark):
    table = spark.createDataFrame(files(), FILES)
    sites = spark.createDataFrame([("one", "./index.html#top"), ("two", "gone.html"), ("three", "x.html")], SITE)
    out = build(table, sites, max_resource_size=80, excludes=["drafts"])
    pages = {r.page: r.html for r in out.pages.collect()}
    assert sorted(pages) == ["b.html", "index.html"]
    page = pages["index.html"]
    # Routes, an excluded page and a file over the limit left as they were, the smaller file a placeholder with a name to save it under.
    assert 'href="#/b.html"' in page and 'href="../drafts/c.html"' in page and 'href="big.bin"' in page and 'download="small.bin"' in page
    assert "<base href" not in page and "Content-Security" not in page and "koi8" not in page and 'src="https://e.org/i.png"' in page
    # The framed page stands in its frame, already rewritten.
    assert "srcdoc=" in pages["b.html"] and "#/b.html" in pages["b.html"]
    stored = {(r.mime, r.value) for r in out.resources.collect()}
    # A script and a sheet without a charset of their own are read by that of the page that refers to them.
    css = 'a::after { content: "\u0436" } b { src: url(gone.woff) }'
    assert stored == {("text/plain", "data:text/plain;base64,eXl5eXl5eXl5eQ=="), ("text/css", css), ("text/javascript", '"\u0436"')}
    codes = sorted((r.page, r.code) for r in out.diagnostics.collect())
    assert codes == [("index.html", "csp"), ("index.html", "decoded"), ("index.html", "excluded"), ("index.html", "form"), ("index.html", "too_large"), ("sub/s.css", "decoded"), ("sub/s.css", "missing"), ("sub/t.js", "decoded")]
    assert {(r.site, r.rel) for r in out.manifest.collect()} == {("one", x) for x in ("index.html", "b.html", "sub/small.bin", "sub/s.css", "sub/t.js", "sub/big.bin")}
    # Sites with a bad entry, or without any file, are errors, and nothing else is made of them.
    assert {(r.site, r.ref, r.code) for r in out.errors.collect()} == {("two", "gone.html", "entry_missing"), ("three", "x.html", "entry_missing")}
    assert {r.site: (r.entry, r.pages, r.resources) for r in out.summary.collect()} == {"one": ("index.html", 2, 3)}
    assert out.dangling.isEmpty() and {r.site for r in out.bundles.collect()} == {"one"}


def test_limits_bases_and_unreadable_pages(spark):
    rows = {
        "a.html": '<base href="https://e.org/"><a href="#x">x</a>', "b.html": '<base href="../../out/"><a href="c.html">c</a>', "c.html": '<base href="100%">', "gone.html": None,
        "index.html": '<a href="a.html"></a><a href="b.html"></a><a href="gone.html"></a><form action="big.bin"></form><link rel="stylesheet" href="s.css"><link rel=stylesheet href="huge.css"><style>i { src: url(big.bin) }</style><svg><use href="big.svg#d"/></svg><img src="b.html"><iframe src="gone.html"></iframe><meta http-equiv="refresh" content="1;url=https://e.org/">',
        "s.css": "@import 'huge.css'; p { src: url(big.bin) } q { src: url(small.bin) }", "huge.css": "/*" + "x" * 200 + "*/", "big.bin": "y" * 200, "small.bin": "z", "big.svg": "<svg>" + " " * 200 + "</svg>",
    }
    table = spark.createDataFrame([("s", k, None if v is None else bytearray(v.encode())) for k, v in rows.items()], FILES)
    # Eight levels of ten frames each: refused by their size alone.
    deep = [("f", f"l{k}.html", bytearray((f'<iframe src="l{k + 1}.html"></iframe>' * 10).encode())) for k in range(8)] + [("f", "l8.html", bytearray(b"<p>"))]
    table = table.unionByName(spark.createDataFrame(deep, FILES))
    built = build(table, spark.createDataFrame([("s", "index.html"), ("f", "l0.html")], SITE), max_resource_size=100)
    assert sorted((r.page, r.ref, r.code) for r in built.diagnostics.filter("site = 'f'").collect()) == [("l0.html", "l1.html", "frames_too_large")] * 10
    assert built.pages.filter("site = 'f'").head().html.count("<iframe src=") == 10
    out = built._replace(**{k: getattr(built, k).filter("site = 's'") for k in ("pages", "resources", "diagnostics", "manifest")})
    assert sorted(r.page for r in out.pages.collect()) == ["a.html", "b.html", "c.html", "index.html"]
    found = sorted((r.page, r.ref, r.code) for r in out.diagnostics.collect())
    assert found == sorted([("a.html", "https://e.org/", "base_external"), ("b.html", "../../out/", "base_outside"), ("c.html", "100%", "base_invalid"), ("gone.html", "", "unreadable"), ("index.html", "big.bin", "form"), ("index.html", "https://e.org/", "refresh"),
        ("index.html", "huge.css", "too_large"), ("index.html", "big.bin", "too_large"), ("index.html", "big.svg#d", "too_large"), ("s.css", "huge.css", "too_large"), ("s.css", "big.bin", "too_large")])
    read = {r.rel for r in out.manifest.collect()}
    assert "big.bin" in read and "huge.css" in read and "small.bin" in read


def test_options_of_each_site(spark):
    text = '<a href="b.html">b</a><a href="old/c.html">c</a><img src="i.png">\u0436'.encode("koi8-r")
    rows = [(s, rel, bytearray(data)) for s in ("one", "two", "three") for rel, data in (("index.html", text), ("b.html", b"b"), ("old/c.html", b"c"), ("i.png", b"x" * 50))]
    sites = spark.createDataFrame([("one", "", 10, None, "koi8-r"), ("two", "index.html", None, True, None), ("three", "index.html", 0, False, None), ("four", "index.html", 0, False, None)], SITE + ", max_resource_size long, single_page boolean, default_charset string")
    patterns = spark.createDataFrame([("one", "old"), ("two", "*.png"), ("three", "[a"), ("three", "b.html"), ("four", "[")], "site string, pattern string")
    out = build(spark.createDataFrame(rows, FILES), sites, excludes=patterns, max_resource_size=1000)
    assert {(r.site, r.ref, r.code) for r in out.errors.collect()} == {("three", "[a", "exclude_malformed"), ("four", "[", "exclude_malformed"), ("four", "index.html", "entry_missing")}
    assert {(r.site, r.page) for r in out.pages.collect()} == {("one", "index.html"), ("one", "b.html"), ("two", "index.html")}
    html = {r.site: r.html for r in out.pages.filter("page = 'index.html'").collect()}
    assert "\u0436" in html["one"] and "\ufffd" in html["two"]
    assert {(r.site, r.ref, r.code) for r in out.diagnostics.collect()} == {("one", "old/c.html", "excluded"), ("one", "i.png", "too_large"), ("one", "", "decoded"), ("two", "i.png", "excluded")}


def test_keys_that_collide_in_every_round(spark):
    images = {f"i/{k}.png": f"image {k}".encode() for k in range(14)}
    sheets_ = {f"s/{k}.css": (f"@import '{k + 12}.css'; " if k < 12 else "").encode() + f"p {{ src: url(../i/{k % 14}.png) }}".encode() for k in range(24)}
    sheets_["s/same.css"] = sheets_["s/23.css"]
    scripts = {f"j/{k}.js": f"f({k})".encode() for k in range(14)}
    page = "".join([*(f'<img src="{i}">' for i in images), *(f'<link rel="stylesheet" href="{c}">' for c in sheets_), *(f'<script src="{j}"></script>' for j in scripts)])
    rows = {"index.html": page.encode(), **images, **sheets_, **scripts}
    table = spark.createDataFrame([("s", k, bytearray(v)) for k, v in rows.items()], FILES)
    out = build(table, spark.createDataFrame([("s", "index.html")], SITE), key=1)
    stored = {r.key: r for r in out.resources.collect()}
    assert len(stored) == out.resources.count() == 14 + 24 + 14 and out.dangling.isEmpty()
    assert {len(k) for k in stored} >= {1, 9} and sum(len(k) == 1 for k in stored) == len({k[0] for k in stored})

    def content(text):
        """The text with each key followed by what it names."""
        return re.sub("sitepack-res-([0-9a-f]+)", lambda m: "[" + (content(stored[m[1]].value) if stored[m[1]].is_text else base64.b64decode(stored[m[1]].value.split(",")[1]).decode()) + "]", text)

    def expected(name):
        text = rows[name].decode()
        text = re.sub("@import '(.*?)'", lambda m: f'@import "[{expected("s/" + m[1])}]"', text)
        return re.sub(r"url\(../(.*?)\)", lambda m: f'url("[{rows[m[1]].decode()}]")', text)

    shown = content(out.pages.head().html)
    assert all(f'"[{rows[i].decode()}]"' in shown for i in [*images, *scripts]) and all(f'href="[{expected(c)}]"' in shown for c in sheets_)


def test_nothing_is_broadcast_by_an_estimate(spark, monkeypatch):
    for module in (graph, spread):
        monkeypatch.setattr(module, "BROADCAST_ROWS", -1, raising=False)  # every table is counted to be too large
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = build(spark.createDataFrame(files(), FILES), spark.createDataFrame([("one", "index.html"), ("two", "x.html")], SITE), max_resource_size=80, excludes=["drafts"], part=50)
    assert max(r["count"] for r in out.bundles.groupBy(input_file_name()).count().collect()) <= 8 < out.bundles.count()
    pages, stored = parts.read_parts(out.bundles)
    assert {(r.site, r.page) for r in pages.collect()} == {("one", "index.html"), ("one", "b.html"), ("two", "x.html")}
    assert {r.site: (r.pages, r.resources, r.files) for r in out.summary.collect()} == {"one": (2, 3, 6), "two": (1, 0, 1)}
    assert sorted(r.code for r in out.diagnostics.collect()) == ["csp", "decoded", "decoded", "decoded", "excluded", "form", "missing", "too_large"]
    values = stored.select("site", "key", "mime", "is_text", stored.value.cast("binary").alias("data"))
    assert expansion.expand(values).count() == 3
    plans = [store.executionsList(k, 1).head().physicalPlanDescription() for k in range(before, store.executionsCount())]
    assert sum("SortMergeJoin" in p for p in plans) > 20
    # Sums over partitions are broadcast, a row for each.
    assert {k for p in plans for k in re.findall(r"\) Broadcast\w*Join.*\nLeft keys \[\d+\]: \[(.*)#", p)} == {"_part"}
