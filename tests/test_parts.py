import random

from pyspark.sql import functions as F
from sitepack.operators import parts, payload

SITES = "site string, entry string"
PAGES = "site string, page string, title string, html string"
RES = "site string, key string, mime string, is_text boolean, value string"
NAMED = "site string, title string, lang string"


def tables(spark, seed=1):
    r = random.Random(seed)
    some = lambda: "".join(r.choice(['\\', '"', "{", "}", ",", "<", "\n", "é", "😀", "ab", "&", ":", " "]) for _ in range(r.choice([0, 1, 3, 40, 400])))
    pages = [(s, f"p{k}{some()[:5]}.html", some() or None, some()) for s in ("one", "two", "no resources") for k in range(r.randrange(1, 12))]
    res = [(s, f"{k:016x}", "text/css", True, some()) for s in ("one", "two", "no pages") for k in range(5)] + [("one", f"b{k:015x}", "image/png", False, "data:image/png;base64," + "Q" * (k * 50)) for k in range(4)]
    sites = [(s, "p0.html") for s in ("one", "two", "no resources", "no pages", "nothing")]
    named = [(s, 'a "title" <' + s + ">", "fr" if s == "one" else "") for s, _ in sites]
    return (spark.createDataFrame(x, y) for x, y in ((sites, SITES), (pages + [("other", "x", "", "")], PAGES), (res, RES), (named, NAMED)))


def joined(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.site, r.part)):
        assert r.part == len(out.setdefault(r.site, []))
        out[r.site].append(r.text)
    return out


def test_parts_are_the_documents_of_one_row(spark):
    sites, pages, res, named = tables(spark)
    want = {r.site: r.html for r in payload.documents(payload.payloads(sites, pages, res), named).collect()}
    for size in (7, 1000):
        got = joined(parts.parts(sites, pages, res, named, part=size))
        assert {s: "".join(t) for s, t in got.items()} == want
        assert all(len(t) == size for texts in got.values() for t in texts[:-1])
    bare = joined(parts.parts(sites, pages, res, part=50))
    assert {s: "".join(t) for s, t in bare.items()} == {r.site: r.payload for r in payload.payloads(sites, pages, res).collect()}
    import hashlib

    assert {r.site: (r.md5, r.chars) for r in parts.digests(parts.parts(sites, pages, res, named, part=31)).collect()} == {s: (hashlib.md5(t.encode()).hexdigest(), len(t)) for s, t in want.items()}


def test_reading_across_borders(spark):
    sites, pages, res, named = tables(spark, 2)
    want_pages = {(r.site, r.page, r.title or "", r.html) for r in pages.collect() if r.site != "other"}
    want_res = {tuple(r) for r in res.collect()}
    for size in (16, 1 << 20):
        got, stored = parts.read_parts(parts.parts(sites, pages, res, named, part=size))
        assert {tuple(r) for r in got.select("site", "page", "title", "html").collect()} == want_pages
        assert {tuple(r) for r in stored.select("site", "key", "mime", "is_text", "value").collect()} == want_res


def test_parts_of_unequal_lengths_and_no_rows(spark):
    sites, pages, res, named = tables(spark, 3)
    r, rows = random.Random(5), []
    for d in payload.documents(payload.payloads(sites, pages, res), named).collect():
        at, k = 0, 0
        while at < len(d.html):
            step = r.choice([1, 2, 30, 500])
            rows.append((d.site, k, d.html[at : at + step]))
            at, k = at + step, k + 1
    got, stored = parts.read_parts(spark.createDataFrame(rows, "site string, part long, text string"))
    assert got.count() == pages.filter("site != 'other'").count() and stored.count() == res.count()
    assert got.select(F.sum(F.xxhash64("site", "page", "html").cast("decimal(38,0)"))).head() == pages.filter("site != 'other'").select(F.sum(F.xxhash64("site", "page", "html").cast("decimal(38,0)"))).head()
    none = parts.parts(sites.limit(0), pages, res, named)
    assert none.count() == 0 and parts.read_parts(none)[0].count() == 0
