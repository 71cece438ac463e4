"""Queries of the whole build over sites that Spark derives from ``documents``, each with its twin in DuckDB SQL.

Seven sites take the documents in turn.  A document is a page that links to up to four others (a tree from page 0), to a file with its text, and to
shared files: sheets that import each other, a script, an image, a sprite, and a frame that embeds itself and links to a page of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import bind
from ..operators import expansion, parts, rewrite, store
from .build import Build, build, checked_sites
from .queries import query, table

SITES = 7
SVG = '<svg xmlns="http://www.w3.org/2000/svg"><symbol id="dot"></symbol></svg>'
# The files that every site has, with {site} for its name.
SHARED = {
    "css/a.css": '@import "b.css";\nbody { background: url(../img/dot.png) }',
    "css/b.css": '@import "a.css";\np { src: url("../img/dot.png#x") }',
    "js/app.js": 'console.log("{site}")',
    "img/dot.png": "dot of {site}",
    "img/s.svg": SVG,
    "frame/f.html": '<p>frame</p><a href="only.html">only</a><iframe src="f.html"></iframe>',
    "frame/only.html": "<p>only</p>",
    "unused.txt": "nothing refers to this",
}
# A page of the derived sites, with {q} for its number, {text} for its text and {links} for its links to other pages.
PAGE = (
    '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Page {q}</title><link rel="stylesheet" href="../css/a.css" integrity="x"><script src="../js/app.js"></script>'
    '<style>p { background: url(../img/dot.png#y) }</style><meta http-equiv="refresh" content="30;url=0.html"></head><body style="background:url(../img/dot.png)"><p>{text}</p>{links}'
    '<a href="../files/{q}.zip">f</a><a href="#x" target="_self">x</a><img src="../img/dot.png" srcset="../img/dot.png 1x, gone.png 2x"><iframe src="../frame/f.html"></iframe><svg><use href="../img/s.svg#dot"/></svg></body></html>'
)


def derived_files(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Files (site, rel, content) of the derived sites and their entries."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), F.col("doc_id") % SITES).alias("site"), F.expr(f"doc_id div {SITES}").alias("q"), F.coalesce("text", F.lit("")).alias("text"))
    links = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: bind(F.col("q") * 4 + k, lambda c: F.concat(F.lit('<a href="'), c, F.lit('.html">l</a>')))), "")
    page = F.lit(PAGE)
    for name, value in (("{q}", F.col("q").cast("string")), ("{links}", links), ("{text}", rewrite.escape_attribute(F.col("text")))):
        page = F.replace(page, F.lit(name), value)
    own = F.array(F.struct(F.concat(F.lit("p/"), "q", F.lit(".html")).alias("rel"), page.alias("text")), F.struct(F.concat(F.lit("files/"), "q", F.lit(".zip")).alias("rel"), F.col("text").alias("text")))
    sites = docs.select("site").distinct()
    shared = sites.select("site", F.explode(F.array(*(F.struct(F.lit(rel).alias("rel"), F.replace(F.lit(text), F.lit("{site}"), F.col("site")).alias("text")) for rel, text in SHARED.items()))).alias("f"))
    files = docs.select("site", F.explode(own).alias("f")).unionByName(shared).select("site", "f.rel", F.encode("f.text", "utf-8").alias("content"))
    return files, sites.select("site", F.lit("p/0.html").alias("entry"))


def built(spark, sf_dir) -> Build:
    return build(*derived_files(spark, sf_dir))


def _key(mime: str, flag: str, data: str) -> str:
    return f"sha256(encode('{mime}') || '\\x00'::BLOB || encode('{flag}') || encode({data}))[1:16]"


TOKEN = "'" + store.PREFIX + "' || "
HIDDEN = SVG.replace("<svg", '<svg aria-hidden="true" style="position:absolute;width:0;height:0;overflow:hidden"')
FRAMED = '<meta charset="utf-8"><base target="_top"><p>frame</p><a data-sitepack-route="route" href="#/frame/only.html">only</a><iframe src="f.html"></iframe>'
ESCAPED = FRAMED.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")
SITE_SQL = f"""docs AS (SELECT 's' || doc_id % {SITES} AS site, doc_id // {SITES} AS q, coalesce(text, '') AS text FROM documents),
    reach AS (SELECT site, q FROM docs WHERE q = 0 UNION SELECT docs.site, docs.q FROM reach JOIN docs ON docs.site = reach.site AND (docs.q - 1) // 4 = reach.q AND docs.q > 0),
    s0 AS (SELECT DISTINCT site, {_key('image/png', 'b', "'dot of ' || site")} AS dot, {_key('text/javascript', 't', "'console.log(" + '"' + "' || site || '" + '")' + "'")} AS js FROM reach),
    s1 AS (SELECT *, '@import "a.css";' || chr(10) || 'p {{ src: url("' || {TOKEN} dot || '#x") }}' AS b_text FROM s0),
    s2 AS (SELECT *, {_key('text/css', 't', 'b_text')} AS b FROM s1),
    s3 AS (SELECT *, '@import "' || {TOKEN} b || '";' || chr(10) || 'body {{ background: url("' || {TOKEN} dot || '") }}' AS a_text FROM s2),
    s AS (SELECT *, {_key('text/css', 't', 'a_text')} AS a FROM s3),
    z AS (SELECT docs.site, docs.q, docs.text, {_key('application/zip', 'b', 'docs.text')} AS zip, list_transform(range(1, 5), lambda k: 4 * q + k) AS kids FROM reach JOIN docs USING (site, q)),
    l AS (SELECT z.site, z.q, string_agg('<a ' || CASE WHEN d.q IS NULL THEN 'href="' ELSE 'data-sitepack-route="route" href="#/p/' END || k.kid || '.html">l</a>', '' ORDER BY k.kid) AS links, count(*) FILTER (d.q IS NULL) AS lost
        FROM z, unnest(z.kids) k(kid) LEFT JOIN docs d ON d.site = z.site AND d.q = k.kid GROUP BY z.site, z.q),
    pages_out AS (SELECT site, 'p/' || q || '.html' AS page, 'Page ' || q AS title, '<!doctype html><html data-sitepack-page="p/' || q || '.html" lang="en"><head><meta charset="utf-8"><base target="_top"><title>Page ' || q || '</title><link rel="stylesheet" href="' || {TOKEN} a
        || '" ><script src="' || {TOKEN} js || '"></script><style>p {{ background: url("' || {TOKEN} dot || '#y") }}</style><script>setTimeout(function(){{top.location.hash="#/p/0.html"}},30000);</script></head><body style="background:url(&quot;' || {TOKEN} dot
        || '&quot;)">{HIDDEN}<p>' || replace(replace(replace(replace(text, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') || '</p>' || links || '<a download="' || q || '.zip" href="' || {TOKEN} zip
        || '">f</a><a data-sitepack-route="route" href="#/p/' || q || '.html#x" >x</a><img src="' || {TOKEN} dot || '" srcset="' || {TOKEN} dot || ' 1x, gone.png 2x"><iframe srcdoc="{ESCAPED}" ></iframe><svg><use href="#dot"/></svg></body></html>' AS html
        FROM z JOIN l USING (site, q) JOIN s USING (site) UNION ALL SELECT site, 'frame/only.html', '', '<meta charset="utf-8"><base target="_top"><p>only</p>' FROM s),
    stored AS (SELECT site, dot AS key, 'image/png' AS mime, false AS is_text, 'data:image/png;base64,' || base64(encode('dot of ' || site)) AS value, strlen('dot of ' || site) AS size FROM s
        UNION ALL SELECT site, js, 'text/javascript', true, 'console.log("' || site || '")', strlen('console.log("' || site || '")') FROM s UNION ALL SELECT site, a, 'text/css', true, a_text, strlen(a_text) FROM s UNION ALL SELECT site, b, 'text/css', true, b_text, strlen(b_text) FROM s
        UNION ALL SELECT DISTINCT site, zip, 'application/zip', false, 'data:application/zip;base64,' || base64(encode(text)), strlen(text) FROM z),
    read AS (SELECT site, 'p/' || q || '.html' AS rel FROM z UNION ALL SELECT site, 'files/' || q || '.zip' FROM z UNION ALL SELECT site, unnest(['css/a.css', 'css/b.css', 'js/app.js', 'img/dot.png', 'img/s.svg', 'frame/f.html', 'frame/only.html']) FROM s)"""


def _text_url(mime: str, text: str) -> str:
    for code, sign in (("%2A", "*"), ("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")")):
        text = f"replace({text if code != '%2A' else 'url_encode(' + text + ')'}, '{code}', '{sign}')"
    return f"'data:{mime};charset=utf-8,' || {text}"


EXPANDED_SQL = f"""e0 AS (SELECT *, 'data:image/png;base64,' || base64(encode('dot of ' || site)) AS dot_url FROM s),
    e1 AS (SELECT *, {_text_url('text/css', f'replace(b_text, {TOKEN} dot, dot_url)')} AS b_url FROM e0), e2 AS (SELECT *, {_text_url('text/css', f'replace(replace(a_text, {TOKEN} b, b_url), {TOKEN} dot, dot_url)')} AS a_url FROM e1),
    expanded AS (SELECT site, key, value FROM stored WHERE NOT is_text UNION ALL SELECT site, b, b_url FROM e2 UNION ALL SELECT site, a, a_url FROM e2 UNION ALL SELECT site, key, {_text_url('text/javascript', 'value')} FROM stored WHERE mime = 'text/javascript')"""


@query("build_read_back", f"WITH RECURSIVE {SITE_SQL} SELECT site, page AS name, 'page' AS kind, md5(title || html) AS md5 FROM pages_out UNION ALL SELECT site, key, mime, md5(value) FROM stored")
def build_read_back(spark, sf_dir):
    """Pages and resources as read back from the bundles' HTML."""
    pages, stored = parts.read_parts(built(spark, sf_dir).bundles)
    digest = lambda c: F.md5(F.encode(c, "utf-8")).alias("md5")
    return pages.select("site", F.col("page").alias("name"), F.lit("page").alias("kind"), digest(F.concat("title", "html"))).unionByName(stored.select("site", F.col("key").alias("name"), F.col("mime").alias("kind"), digest(F.col("value"))))


@query("build_expanded", f"WITH RECURSIVE {SITE_SQL}, {EXPANDED_SQL} SELECT site, key, md5(value) AS value_md5 FROM expanded")
def build_expanded(spark, sf_dir):
    """Every stored resource as a data URL with placeholders expanded."""
    stored = built(spark, sf_dir).resources
    data = F.when(F.col("is_text"), F.encode("value", "utf-8")).otherwise(F.unbase64(F.regexp_extract("value", r"(?s),(.*)$", 1)))
    return expansion.expand(stored.select("site", "key", "mime", "is_text", data.alias("data"))).select("site", "key", F.md5(F.encode("value", "utf-8")).alias("value_md5"))


@query("build_diagnostics", f"""WITH RECURSIVE {SITE_SQL}, k AS (SELECT z.site, 'p/' || z.q || '.html' AS page, k.kid || '.html' AS ref, 'missing' AS code FROM z, unnest(z.kids) k(kid) LEFT JOIN docs d ON d.site = z.site AND d.q = k.kid WHERE d.q IS NULL)
    SELECT site, page, ref, 'warning' AS level, code FROM k UNION ALL SELECT site, 'p/' || q || '.html', v.ref, v.level, v.code FROM z, (VALUES ('gone.png', 'warning', 'missing'), ('frame/f.html', 'warning', 'circular'), ('0.html', 'info', 'refresh')) v(ref, level, code)
    UNION ALL SELECT site, 'css/b.css', 'css/a.css', 'warning', 'circular' FROM s""")
def build_diagnostics(spark, sf_dir):
    """Every diagnostic of the build with its page and reference."""
    return built(spark, sf_dir).diagnostics.select("site", "page", "ref", "level", "code")


# Entries in turn, with what becomes of them: a code, or the path of the page.
ENTRIES = (("p/0.html", "p/0.html"), ("./p/../p/0.html?x#y", "p/0.html"), ("p", "entry_missing"), ("../x.html", "entry_outside"), ("https://e.org/", "entry_external"), ("100%.html", "entry_invalid"), ("", "entry_missing"), ("#top", "entry_fragment"), ("css/a.css", "entry_excluded"), (" frame/f.html ", "frame/f.html"))
BAD_PATTERN = "[x"


def many_sites(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ten documents a site: its files, an entry by turns of ``ENTRIES``, and patterns: css for all, and every seventh has one that is malformed."""
    docs = table(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("k"), (F.col("doc_id") % 10).alias("q"), F.coalesce("text", F.lit("")).alias("text"))
    site = F.concat(F.lit("m"), F.col("k")).alias("site")
    numbers = docs.select("k").distinct()
    shared = numbers.select(site, F.explode(F.array(*(F.struct(F.lit(rel).alias("rel"), F.encode(F.lit(text), "utf-8").alias("content")) for rel, text in SHARED.items()))).alias("f")).select("site", "f.*")
    files = docs.select(site, F.concat(F.lit("p/"), "q", F.lit(".html")).alias("rel"), F.encode("text", "utf-8").alias("content")).unionByName(shared)
    sites = numbers.select(site, F.element_at(F.array(*(F.lit(e) for e, _ in ENTRIES)), (F.col("k") % len(ENTRIES) + 1).cast("int")).alias("entry"))
    patterns = numbers.select(site, F.lit("css").alias("pattern")).unionByName(numbers.filter("k % 7 = 0").select(site, F.lit(BAD_PATTERN).alias("pattern")))
    return files, sites, patterns


ENTRY_SQL = f"""n AS (SELECT DISTINCT doc_id // 10 AS k FROM documents), d0 AS (SELECT DISTINCT doc_id // 10 AS k FROM documents WHERE doc_id % 10 = 0),
    e AS (SELECT k, 'm' || k AS site, CASE WHEN trim(v.entry) = '' THEN 'index.html' ELSE trim(v.entry) END AS ref, CASE WHEN v.found = 'p/0.html' AND d0.k IS NULL THEN 'entry_missing' ELSE v.found END AS found
        FROM n LEFT JOIN d0 USING (k) JOIN (VALUES {", ".join(f"({i}, '{e}', '{x}')" for i, (e, x) in enumerate(ENTRIES))}) v(i, entry, found) ON v.i = k % {len(ENTRIES)})"""


@query("build_errors", f"WITH {ENTRY_SQL} SELECT site, ref, found AS code FROM e WHERE starts_with(found, 'entry_') UNION ALL SELECT 'm' || k, '{BAD_PATTERN}', 'exclude_malformed' FROM n WHERE k % 7 = 0")
def build_errors(spark, sf_dir):
    """Sites that are not built, with the entry or pattern to blame."""
    return checked_sites(*many_sites(spark, sf_dir))[1]


@query("build_entries", f"WITH {ENTRY_SQL} SELECT site, found AS entry FROM e WHERE NOT starts_with(found, 'entry_') AND k % 7 <> 0")
def build_entries(spark, sf_dir):
    """Sites that are built, with the paths that their entries are resolved to."""
    return checked_sites(*many_sites(spark, sf_dir))[0].select("site", "entry")


@query("build_manifest", f"WITH RECURSIVE {SITE_SQL} SELECT site, rel FROM read")
def build_manifest(spark, sf_dir):
    return built(spark, sf_dir).manifest


@query("build_summary", f"""WITH RECURSIVE {SITE_SQL} SELECT s.site, 'p/0.html' AS entry, 'Page 0' AS title, (SELECT count(*) FROM pages_out p WHERE p.site = s.site) AS pages, (SELECT count(*) FROM stored t WHERE t.site = s.site) AS resources,
    (SELECT sum(size)::BIGINT FROM stored t WHERE t.site = s.site) AS resource_bytes, (SELECT count(*) FROM read r WHERE r.site = s.site) AS files FROM s""")
def build_summary(spark, sf_dir):
    return built(spark, sf_dir).summary.drop("bytes")
