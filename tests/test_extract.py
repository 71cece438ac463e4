from pyspark.sql import functions as F

from sitepack.functions import charset, css
from sitepack.operators import extract, sheets


def refs_of(spark, html):
    tags = extract.tags(spark.createDataFrame([("s", "p.html", html)], "site string, page string, text string"))
    return [(r.tag, r.attr, r.role, r.raw) for r in extract.references(tags).orderBy("seq", "part").collect()]


def test_segments_are_lossless(spark):
    texts = ["", "plain", "<", "a < b > c", "<!-- <a href=x> --><p>", "<script>var a='</p>';if(a<b){}</script>x", "<a href='x>y'>t</a>", "<title>a<b</title>", "<div class=\"a", "<style>a{}</style", "<!doctype html><?php ?>", "é<b>日本</b>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", F.array_join(extract.segments(F.col("t")), "").alias("back")).collect():
        assert r.back == r.t


def test_references(spark):
    html = """<html><body background="bg.png"><!-- <a href="no.html"> --><a HREF='a.html' href="b.html">x</a><a>none</a><img src=i.png srcset="i1.png 1x, i2.png 2x"><video src="v.mp4" poster="p.png"></video>
    <script src="s.js"></script><script src="d.json" type="application/json"></script><script>"<a href='no2.html'>"</script><link rel="stylesheet" href="c.css"><link rel="stylesheet" type="text/less" href="l.less"><link rel="shortcut icon" href="f.ico"><link rel=next href="n.html"><link rel="prefetch" href="pf.js"><link rel="preload" as="script" href="ps.js">
    <form action="/post"><input type=image src="in.png"><button formaction="fa"></button></form><iframe src="fr.html"></iframe><iframe src="no3.html" srcdoc="x"></iframe><meta http-equiv="refresh" content="5; url='r.html'"><svg><use xlink:href="sp.svg#a"/><image href="im.png" xlink:href="no4.png"/></svg><template><img src="t.png"></template><noscript><img src="ns.png"></noscript><p style="background:url(x.png)"><style>a{}</style><object data="o.bin"></object></body></html>"""
    got = refs_of(spark, html)
    assert ("a", "href", "link", "a.html") in got and not any("no" in r[3] and r[3][2:3] in ".234" for r in got)
    want = [("body", "background", "resource", "bg.png"), ("img", "src", "resource", "i.png"), ("img", "srcset", "resource", "i1.png"), ("img", "srcset", "resource", "i2.png"), ("video", "poster", "resource", "p.png"), ("script", "src", "script", "s.js"), ("script", "src", "other_script", "d.json"), ("link", "href", "style", "c.css"), ("link", "href", "other_style", "l.less"), ("link", "href", "resource", "f.ico"), ("link", "href", "page", "n.html"), ("link", "href", "remove", "pf.js"), ("link", "href", "script", "ps.js"), ("form", "action", "form", "/post"), ("input", "src", "resource", "in.png"), ("button", "formaction", "form", "fa"), ("iframe", "src", "frame", "fr.html"), ("meta", "content", "refresh", "r.html"), ("use", "xlink:href", "sprite", "sp.svg#a"), ("image", "href", "resource", "im.png"), ("img", "src", "resource", "t.png"), ("img", "src", "resource", "ns.png"), ("p", "style", "style_attr", "background:url(x.png)"), ("style", "", "style_text", "a{}"), ("object", "data", "resource", "o.bin")]
    assert [w for w in want if w not in got] == []


def test_heads(spark):
    html = "<html lang=fr><head><base target=_blank><base href='/x/'><title> A &amp;\n B </title><title>no</title></head>"
    tags = extract.tags(spark.createDataFrame([("s", "p", html)], "site string, page string, text string"))
    r = extract.page_heads(tags, ["site", "page"]).head()
    assert (r.title, r.lang, r.base_href, r.base_target) == ("A & B", "fr", "/x/", "_blank")


def test_srcset(spark):
    cases = [("a.png", [("a.png", "")]), ("a.png 1x, b.png 2x", [("a.png", "1x"), ("b.png", "2x")]), ("a.png,b.png", [("a.png,b.png", "")]), ("a.png, b.png", [("a.png", ""), ("b.png", "")]), (" , a.png 100w ,b.png", [("a.png", "100w"), ("b.png", "")]), ("a.png f(1,2), b.png", [("a.png", "f(1,2)"), ("b.png", "")]), ("data:image/png;base64,AA 1x", [("data:image/png;base64,AA", "1x")]), ("", [])]
    df = spark.createDataFrame([(s,) for s, _ in cases], "s string")
    got = {r.s: [(c.url, c.desc) for c in r.c] for r in df.select("s", extract.srcset(F.col("s")).alias("c")).collect()}
    assert got == dict(cases)


def test_small_functions(spark):
    kinds = {"": True, "text/javascript": True, "MODULE": True, "application/json": False, "text/javascript; charset=x": True, "importmap": False, "text/template": False}
    assert all(r.got == r.want for r in spark.createDataFrame(list(kinds.items()), "t string, want boolean").withColumn("got", extract.is_javascript(F.col("t"))).collect())
    sources = {'import "./a.js";': True, "import a from 'a'": True, "import {b} from './b'": True, "import * as c from 'c'": True, "export * from './d'": True, "export {e} from 'e'": True, "const i = await import('./f.js')": True, "x.important()": False, "let importer = 1": False, "export const a = 1": False, "": False}
    got = spark.createDataFrame(list(sources.items()), "t string, want boolean").withColumn("got", extract.has_module_imports(F.col("t"))).collect()
    assert [r.t for r in got if r.got != r.want] == []
    pauses = {"5; url=a.html": (5.0, "a.html"), "0;URL='b.html'": (0.0, "b.html"), "1.5, c.html": (1.5, "c.html"), "7": None, "x; url=a": None}
    rows = spark.createDataFrame([(k,) for k in pauses], "t string").select("t", extract.refresh(F.col("t")).alias("r")).collect()
    assert {r.t: (r.r.seconds, r.r.url) if r.r else None for r in rows} == pauses


def test_charsets(spark):
    cases = [(b"\xef\xbb\xbfabc", None, "abc", "utf-8"), (b"\xff\xfea\x00", "latin1", "a", "utf-16le"), (b"\xfe\xff\x00a", None, "a", "utf-16be"), ("日本".encode("shift_jis"), " Shift_JIS ", "日本", "shift_jis"), (b"\xe9", "latin1", "é", "windows-1252"), (b"a\xffb", None, "a�b", "utf-8"), (b"abc", "nonsense", "abc", "utf-8"), (b"", None, "", "utf-8")]
    df = spark.createDataFrame([(k, bytearray(c[0]), c[1]) for k, c in enumerate(cases)], "k int, content binary, label string")
    got = {r.k: (r.text, r.charset) for r in charset.decode(df, [F.col("label")]).collect()}
    assert got == {k: c[2:] for k, c in enumerate(cases)}
    html = {b'<meta charset="utf-8">': "utf-8", b"<META CHARSET=sjis>": "sjis", b"<!-- <meta charset=a> --><meta charset='b'>": "b", b'<meta http-equiv="Content-Type" content="text/html; charset=euc-jp">': "euc-jp", b"<p>": None, b" " * 1024 + b"<meta charset=x>": None}
    df = spark.createDataFrame([(bytearray(k),) for k in html], "c binary").select("c", charset.sniff_html(F.col("c")).alias("s"))
    assert {bytes(r.c): r.s for r in df.collect()} == html
    sheet = {b'@charset "sjis"; a{}': "sjis", b' @charset "x";': None, b"@charset 'x';": None}
    df = spark.createDataFrame([(bytearray(k),) for k in sheet], "c binary").select("c", charset.sniff_css(F.col("c")).alias("s"))
    assert {bytes(r.c): r.s for r in df.collect()} == sheet


def test_css_scan():
    texts = ["", "a{}", "a{b:url(x.png)}", "a{b:url( 'x y.png' )}/* url(no) */", "@import 'a.css' screen;@import url(b.css);", "a{content:'url(no)'}", "a{b:image-set('i.png' 1x, url(j.png) 2x)}", "a{b:-webkit-image-set(\"k.png\" 1x)}", "a{b:url(a\\)b.png)}", "@import", "a{b:url(", "'unclosed", "/* unclosed"]
    for t in texts:
        assert "".join(p[0] for p in css.scan(t)) == t
    of = lambda t: [(k, r) for _, k, r in css.scan(t) if k]
    assert of(texts[3]) == [("url", "x y.png")]
    assert of(texts[4]) == [("import", "a.css"), ("import", "b.css")]
    assert of(texts[5]) == []
    assert of(texts[6]) == [("url", "i.png"), ("url", "j.png")]
    assert of(texts[7]) == [("url", "k.png")] and of(texts[8]) == [("url", "a)b.png")]
    assert css.unquote("'a\\62 c'") == "abc" and css.unquote("\\0") == "�" and css.unquote("'a\\\nb'") == "ab"
    assert css.unquote(css.escape('a"b\\c\nd')) == 'a"b\\c\nd'


def test_sheets_bottom_up(spark):
    rows = spark.createDataFrame([("s", "a.css", "@import 'b.css'; a{b:url(i.png)}"), ("s", "b.css", "b{c:url(i.png)}")], "site string, page string, text string")
    refs = spark.createDataFrame([("s", "a.css", "b.css", "import", "b.css", ""), ("s", "a.css", "i.png", "url", "i.png", "x"), ("s", "b.css", "i.png", "url", "i.png", "")], "site string, page string, raw string, kind string, rel string, fragment string")
    edges = spark.createDataFrame([("s", "a.css", "b.css", 0)], "site string, src string, dst string, seq long")
    binary = spark.createDataFrame([("s", "i.png", "0" * 16)], "site string, rel string, key string")
    out = {r.page: r for r in sheets.rewrite_bottom_up(rows, refs, edges, binary).collect()}
    assert out["b.css"].text == f'b{{c:url("sitepack-res-{"0" * 16}")}}'
    assert out["a.css"].text == f'@import "sitepack-res-{out["b.css"].key}"; a{{b:url("sitepack-res-{"0" * 16}#x")}}'


def test_decoding_rules(spark):
    rows = [(0, "a\ufeffb".encode(), ""), (1, b"\xef\xbb\xbfx\xef\xbb\xbfy", "koi8-r"), (2, "αβ".encode("cp1253"), "windows-1253"), (3, "привіт".encode("koi8-u"), " KOI8-U "), (4, "שלום".encode("iso8859-8"), "iso_8859-8:1988"), (5, b"caf\xe9", "x-user-defined"), (6, b"plain", "utf-16le"), (7, "ž".encode("iso8859-13"), "iso885913"), (8, "ŕ".encode("iso8859-2"), "iso-ir-101")]
    df = spark.createDataFrame([(k, bytearray(c), label) for k, c, label in rows], "k int, content binary, label string")
    got = {r.k: r.text for r in charset.decode(df, [F.col("label")]).collect()}
    assert got == {0: "a\ufeffb", 1: "x\ufeffy", 2: "αβ", 3: "привіт", 4: "שלום", 5: "café", 6: "plain", 7: "ž", 8: "ŕ"}
    sheets_ = {' \n@charset  "x" ;\n\nq{}': "q{}", "@charset 'x'; q{}": "@charset 'x'; q{}", 'q{} @charset "x";': 'q{} @charset "x";', '@charset "";q': "q"}
    df = spark.createDataFrame([(k,) for k in sheets_], "t string")
    assert {r.t: r.s for r in df.select("t", charset.strip_css_charset(F.col("t")).alias("s")).collect()} == sheets_


def test_module_import_rules(spark):
    rows = {"// we import data from x": False, "  import x from 'y'": True, "a(); import{b}from 'c'": True, "important = 1": False, "export default 1": False, "}export { a } from \"b\"": True, "x = import ('y')": True, "import\n'side'": True, "": False}
    df = spark.createDataFrame(list(rows.items()), "t string, want boolean")
    for r in df.withColumn("got", extract.has_module_imports(F.col("t"))).collect():
        assert r.got is r.want, r.t
