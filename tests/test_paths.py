import pytest
from pyspark.sql import functions as F

from sitepack.functions import paths
from sitepack.operators import resolve

# A shop's site; each case says which rule it holds.
FILES = ["index.html", "shop/index.html", "shop/cart.htm", "shop/tea/green.html", "shop/tea/index.html", "style/main.css", "pics/tea pot.jpg", "pics/ß.png", "private/plan.html", "readme.bak", "LICENSE", "odd.html/leaf.txt", "v1.2/notes.html"]
EXCLUDES = ["private", "*.bak"]
TEA = "shop/tea/green.html"
# rule, raw, base, kind, rel, query, fragment, is_html
CASES = [
    ("nothing is empty", "", TEA, "empty", "", "", "", False),
    ("white space is stripped before anything else", " \n ", TEA, "empty", "", "", "", False),
    ("a lone fragment stays on the page", "#price", TEA, "fragment", "", "", "price", False),
    ("a fragment may be empty", "#", "index.html", "fragment", "", "", "", False),
    ("a scheme leaves the site", "ftp://files.test/x", TEA, "external", "", "", "", False),
    ("any scheme does", "tel:+4930", TEA, "external", "", "", "", False),
    ("so does an authority", "//img.test/p.jpg", TEA, "external", "", "", "", False),
    ("a percent sign needs two hex digits", "5%off.html", TEA, "invalid", "", "", "", False),
    ("in the fragment too", "cart.htm#%g0", "shop/index.html", "invalid", "", "", "", False),
    ("a first segment with a colon is no path", "9:30.html", TEA, "invalid", "", "", "", False),
    ("a port is digits", "http://shop.test:port/", TEA, "invalid", "", "", "", False),
    ("control characters within are refused", "car\x02t.htm", "shop/index.html", "invalid", "", "", "", False),
    ("a path is seen from its page's directory", "cart.htm", "shop/index.html", "file", "shop/cart.htm", "", "", True),
    ("a leading slash means the root", "/style/main.css", TEA, "file", "style/main.css", "", "", False),
    ("dots are resolved", "./../cart.htm", TEA, "file", "shop/cart.htm", "", "", True),
    ("climbing above the root is outside", "../../../x.html", TEA, "outside", "../x.html", "", "", False),
    ("from the root as well", "/../../x", "index.html", "outside", "../../x", "", "", False),
    ("a directory with a slash is its index", "/shop/tea/", "index.html", "file", "shop/tea/index.html", "", "", True),
    ("and without one", "shop", "index.html", "file", "shop/index.html", "", "", True),
    ("two dots name a directory", "..", TEA, "file", "shop/index.html", "", "", True),
    ("the root is a directory", "/", TEA, "file", "index.html", "", "", True),
    ("a directory without an index is missing", "pics", "index.html", "missing", "pics/index.html", "", "", True),
    ("a directory may look like a page", "odd.html", "index.html", "missing", "odd.html/index.html", "", "", True),
    ("a directory may have dots", "v1.2/", "index.html", "missing", "v1.2/index.html", "", "", True),
    ("what is not there is missing", "black.html", TEA, "missing", "shop/tea/black.html", "", "", True),
    ("a file has no inside", "/LICENSE/x", TEA, "missing", "LICENSE/x", "", "", False),
    ("a slash after a file is dropped", "cart.htm/", "shop/index.html", "file", "shop/cart.htm", "", "", True),
    ("query and fragment are split off", "/shop/cart.htm?n=2&n=3#sum", TEA, "file", "shop/cart.htm", "n=2&n=3", "sum", True),
    ("a query alone is the page itself", "?sort=up", TEA, "file", TEA, "sort=up", "", True),
    ("escapes in the path are resolved", "/pics/tea%20pot.jpg", TEA, "file", "pics/tea pot.jpg", "", "", False),
    ("also of UTF-8", "/pics/%C3%9F.png", TEA, "file", "pics/ß.png", "", "", False),
    ("escapes in the fragment stay", "/#%41", TEA, "file", "index.html", "", "%41", True),
    ("a plus is a plus", "/pics/tea+pot.jpg", TEA, "missing", "pics/tea+pot.jpg", "", "", False),
    ("backslashes are slashes", "\\style\\main.css", TEA, "file", "style/main.css", "", "", False),
    ("tabs and line ends within are dropped", "ca\tr\nt.htm", "shop/index.html", "file", "shop/cart.htm", "", "", True),
    ("an excluded directory beats its files", "/private/plan.html", TEA, "excluded", "private/plan.html", "", "", True),
    ("an excluded ending holds anywhere", "/readme.bak", TEA, "excluded", "readme.bak", "", "", False),
    ("excluded beats missing", "none.bak", TEA, "excluded", "shop/tea/none.bak", "", "", False),
    ("a base may be a directory", "cart.htm", "shop/", "file", "shop/cart.htm", "", "", True),
    ("or the root", "LICENSE", "", "file", "LICENSE", "", "", False),
]


def test_resolve(spark):
    files = spark.createDataFrame([("s", f) for f in FILES], "site string, rel string")
    rows = spark.createDataFrame([(k, "s", c[1], c[2]) for k, c in enumerate(CASES)], "k int, site string, raw string, base string")
    got = {r.k: (r.kind, r.rel, r.query, r.fragment, r.is_html) for r in resolve.look_up(resolve.resolve(rows), files, EXCLUDES).collect()}
    for k, c in enumerate(CASES):
        assert got[k] == c[3:], c[0]


def test_external_base(spark):
    rows = spark.createDataFrame([("s", "a.html", True), ("s", "#x", True), ("s", "", True), ("s", "100%", True)], "site string, raw string, ext boolean").withColumn("base", F.lit("p.html"))
    files = spark.createDataFrame([("s", "a.html")], "site string, rel string")
    assert {(r.raw, r.kind) for r in resolve.look_up(resolve.resolve(rows, base_external="ext"), files).collect()} == {("a.html", "external"), ("#x", "fragment"), ("", "empty"), ("100%", "external")}


def test_base_of(spark):
    p = TEA
    cases = [(p, "", p, "file"), (p, "#a", p, "file"), (p, "?b", p, "file"), (p, "http://cdn.test/x/", p, "external"), (p, "//cdn.test", p, "external"), (p, "/lib/", "lib/", "file"), (p, "/lib", "lib", "file"), (p, "../", "shop/", "file"), (p, "..", "shop/", "file"), (p, ".", "shop/tea/", "file"), (p, "old/", "shop/tea/old/", "file"), (p, "old/a.html", "shop/tea/old/a.html", "file"), (p, "../../../", p, "outside"), (p, "x%", p, "invalid"), ("index.html", "/", "", "file")]
    rows = spark.createDataFrame(cases, "page string, href string, base string, kind string")
    for r in rows.select("*", paths.base_of(F.col("page"), F.col("href")).alias("got")).collect():
        assert (r.got.base, r.got.kind) == (r.base, r.kind), (r.page, r.href)


def test_excluded(spark):
    shapes = {  # pattern: paths that it takes, paths that it leaves
        "private": (["private/plan.html", "private/a/b", "x/private/y"], ["private.html", "my private"]),
        "*.bak": (["readme.bak", "shop/x.bak", "x.bak/y"], ["x.bak.html", "bak"]),
        "shop/old/*": (["shop/old/a", "shop/old/b/c"], ["shop/a", "x/shop/old/a"]),
        "shop/old": (["shop/old/a", "shop/old"], ["shop/older"]),
        "shop/*.htm": (["shop/cart.htm"], ["shop/a/cart.htm", "cart.htm"]),
        "/top": (["top/a", "top"], ["tops"]),
        "./shop/?": (["shop/a", "shop/b/c"], ["shop/ab"]),
        "[x-z]*": (["y/a", "a/zebra"], ["a/b"]),
        "[^x]": (["a", "x/b"], ["x/x"]),
        "\\?": (["?", "a/?"], ["a"]),
    }
    for pattern, (taken, left) in shapes.items():
        rows = spark.createDataFrame([(x, x in taken) for x in taken + left], "rel string, want boolean")
        for r in rows.withColumn("got", paths.excluded(F.col("rel"), [pattern])).collect():
            assert r.got is r.want, (pattern, r.rel)


@pytest.mark.parametrize("pattern", ["x[", "[]y", "shop/[a", "end\\", "[b-]"])
def test_malformed_patterns(pattern):
    with pytest.raises(ValueError):
        paths.glob_pattern(pattern)


def test_routes(spark):
    cases = [("shop/index.html", "", "", "#/shop/index.html"), ("tea pot/a.html", "n=2", "end", "#/tea%20pot/a.html?n=2#end"), ("straße.html", "", "", "#/stra%C3%9Fe.html"), ("a=b&c:d@e+f$.html", "", "x", "#/a=b&c:d@e+f$.html#x"), ("(a)*'b'!.html", "", "", "#/%28a%29%2A%27b%27%21.html"), ("5%.html", "q", "", "#/5%25.html?q"), ("~x_y-z.html", "", "", "#/~x_y-z.html")]
    rows = spark.createDataFrame(cases, "rel string, q string, f string, want string").withColumn("got", paths.route(F.col("rel"), F.col("q"), F.col("f")))
    for r in rows.withColumn("back", paths.parse_route(F.col("got"))).collect():
        assert r.got == r.want
        assert (r.back.path, r.back.query, r.back.fragment) == (r.rel, r.q, r.f)


def test_percent_and_html(spark):
    cases = [("abc-_.!~*'()", "abc-_.!~*'()"), ("a b", "a%20b"), ("é", "%C3%A9"), ("a+b/c?d#e&f=g", "a%2Bb%2Fc%3Fd%23e%26f%3Dg"), ("😀", "%F0%9F%98%80"), ("", "")]
    rows = spark.createDataFrame(cases, "t string, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", paths.encode_component(F.col("t"))).collect())
    names = {"a.html": True, "a.htm": True, "A.HTML": True, "dir/a.html": True, "a.xhtml": False, "a.css": False, "html": False, "a.html.bak": False}
    got = spark.createDataFrame(list(names.items()), "p string, want boolean").withColumn("got", paths.is_html(F.col("p"))).collect()
    assert all(r.got == r.want for r in got)
