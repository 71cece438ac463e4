"""Registered queries: each applies operators to whole given tables; most have a twin in DuckDB SQL.

``pages`` are captured sites.  The tables hold few links that lead anywhere, so graph jobs run on a graph that Spark derives
from part and lineitem (a site for each brand, an edge where two parts follow in an order), and reference forms are
crossed with every page from a short list of fixed texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import charset, css, paths
from ..operators import circles, extract, graph, parts, payload, report, resolve, rewrite, sheets, store
from ..sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Reference texts that every page is taken to hold besides its own links, with a name for each.
FORMS = (("", "a"), ("#top", "b"), ("https://example.com/a.html", "c"), ("//cdn.example.com/x.js", "d"), ("mailto:a@example.com", "e"), ("100%.html", "f"), ("../../../../etc/passwd", "g"), ("./", "h"), ("/", "i"), ("?page=2", "j"), ("x/../y//./z.html?q=1#s", "k"), ("  about.html ", "l"), ("a b%20c.png", "m"))
PATTERNS = ("fr", "*.html", "de/*", "[a-c]*", "en/?[0-9]*")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.captured_pages(table(spark, sf_dir, "pages"))


PAGES_SQL = r"""p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS site,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)', 1) AS raw, html FROM pages),
    cp AS (SELECT page_id, site, CASE WHEN raw = '' OR raw LIKE '%/' THEN raw || 'index.html' ELSE raw END AS page, html AS text FROM p WHERE site <> '')"""
CLEAN = r"list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split({0}, '/'), lambda s: [s])), lambda a, s: CASE WHEN s[1] IN ('', '.') THEN a WHEN s[1] = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[:len(a) - 1] ELSE list_concat(a, s) END)"
LINKS_SQL = PAGES_SQL + r""",
    body AS (SELECT *, regexp_replace(regexp_replace(text, '<!--.*?-->', '', 'gs'), '<(script|style|title)[^>]*>.*?</(script|style|title)>', '', 'gs') AS t FROM cp),
    links AS (SELECT page_id, site, page, replace(replace(replace(replace(replace(unnest(regexp_extract_all(t, '<a href="([^"]*)"', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS raw FROM body)"""
REFS_SQL = LINKS_SQL + r""",
    r0 AS (SELECT site, page, 'link' AS role, raw FROM links WHERE raw <> '' UNION ALL SELECT site, page, 'form_' || v.name, v.raw FROM cp, (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in FORMS) + r""") v(raw, name)),
    r1 AS (SELECT *, trim(raw) AS s FROM r0),
    r2 AS (SELECT *, regexp_extract(s, '^[^?#]*') AS path, CASE WHEN s = '' THEN 'empty' WHEN s LIKE '#%' THEN 'fragment' WHEN regexp_matches(s, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|$)') THEN 'invalid' WHEN s LIKE '//%' OR regexp_matches(s, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'external' END AS early FROM r1),
    r3 AS (SELECT *, CASE WHEN early IS NULL THEN CASE WHEN path = '' THEN page WHEN path LIKE '/%' THEN url_decode(replace(path, '+', '%2B'))[2:] ELSE regexp_replace(page, '/?[^/]*$', '') || '/' || url_decode(replace(path, '+', '%2B')) END END AS joined FROM r2),
    r4 AS (SELECT *, CASE WHEN joined IS NOT NULL THEN array_to_string(""" + CLEAN.format("joined") + r""", '/') END AS rel FROM r3),
    dirs AS (SELECT DISTINCT site, unnest(list_transform(range(0, len(string_split(page, '/'))), lambda n: array_to_string(string_split(page, '/')[1:n], '/'))) AS rel FROM cp),
    inv AS (SELECT DISTINCT site, page AS rel FROM cp),
    r5 AS (SELECT r4.*, CASE WHEN d.rel IS NULL THEN r4.rel WHEN r4.rel = '' THEN 'index.html' ELSE r4.rel || '/index.html' END AS target FROM r4 LEFT JOIN dirs d ON r4.site = d.site AND r4.rel = d.rel),
    refs AS (SELECT r5.site, r5.page, role, raw, CASE WHEN early IS NOT NULL THEN early WHEN r5.rel = '..' OR r5.rel LIKE '../%' THEN 'outside' WHEN inv.rel IS NOT NULL THEN 'file' ELSE 'missing' END AS kind, target FROM r5 LEFT JOIN inv ON r5.site = inv.site AND r5.target = inv.rel)"""


def page_tags(pages: DataFrame) -> DataFrame:
    return extract.tags(pages.select("site", "page", "text"))


def resolved(spark: SparkSession, sf_dir: str, forms: bool = True) -> DataFrame:
    """References of all pages (and the fixed forms), resolved and looked up in their site's files."""
    pages = captured(spark, sf_dir)
    refs = extract.references(page_tags(pages))
    links = refs.filter("role = 'link'").select("site", "page", "seq", "part", "role", "raw")
    if forms:
        fixed = F.explode(F.array(*(F.struct(F.lit(raw).alias("raw"), F.lit(f"form_{name}").alias("role")) for raw, name in FORMS))).alias("f")
        links = links.unionByName(pages.select("site", "page", F.lit(-1).alias("seq"), F.lit(0).alias("part"), fixed).select("site", "page", "seq", "part", "f.role", "f.raw"))
    files = pages.select("site", F.col("page").alias("rel"))
    return resolve.look_up(graph.saved(resolve.resolve(links.withColumn("base", F.col("page")))), files)


@query("page_urls", f"WITH {PAGES_SQL} SELECT page_id, site, page, regexp_matches(lower(page), '\\.html?$') AS is_html FROM cp")
def page_urls(spark, sf_dir):
    return captured(spark, sf_dir).select("page_id", "site", "page", paths.is_html(F.col("page")).alias("is_html"))


@query("page_titles", f"""WITH {PAGES_SQL} SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(text, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS title,
    nullif(regexp_extract(text, '<html lang="([^"]*)"', 1), '') AS lang FROM cp""")
def page_titles(spark, sf_dir):
    pages = captured(spark, sf_dir).select("page_id", "text")
    return extract.page_heads(extract.tags(pages), ["page_id"]).select("page_id", "title", "lang")


@query("page_charset", f"""WITH {PAGES_SQL} SELECT page_id, nullif(regexp_extract(text[1:1024], '<meta charset="([^"]*)"', 1), '') AS label, CASE WHEN regexp_extract(text[1:1024], '<meta charset="([^"]*)"', 1) IN ('utf-8', '') THEN 'utf-8' END AS charset, length(text) AS chars FROM cp""")
def page_charset(spark, sf_dir):
    files = captured(spark, sf_dir).select("page_id", F.encode("text", "utf-8").alias("content"))
    label = charset.sniff_html(F.col("content"))
    rows = charset.decode(files.withColumn("label", label), [F.col("label")])
    return rows.select("page_id", "label", "charset", F.length("text").cast("long").alias("chars"))


@query("page_links", f"WITH {LINKS_SQL} SELECT page_id, raw, count(*) AS n FROM links WHERE raw <> '' GROUP BY page_id, raw")
def page_links(spark, sf_dir):
    tags = extract.tags(captured(spark, sf_dir).select("page_id", "text"))
    return extract.references(tags).filter("role = 'link'").groupBy("page_id", "raw").agg(F.count("*").alias("n"))


@query("link_kinds", f"WITH {REFS_SQL} SELECT site, role, kind, count(*) AS n FROM refs GROUP BY site, role, kind")
def link_kinds(spark, sf_dir):
    return resolve.kind_counts(resolved(spark, sf_dir))


@query("broken_links", f"WITH {REFS_SQL} SELECT site, target AS rel, count(DISTINCT page) AS pages, count(*) AS refs FROM refs WHERE kind = 'missing' GROUP BY site, target")
def broken_links(spark, sf_dir):
    return report.broken_links(resolved(spark, sf_dir))


@query("top_missing", f"WITH {REFS_SQL} SELECT site, target AS rel, count(DISTINCT page) AS pages, count(*) AS refs FROM refs WHERE kind = 'missing' GROUP BY site, target ORDER BY refs DESC, site, rel LIMIT 20")
def top_missing(spark, sf_dir):
    return report.broken_links(resolved(spark, sf_dir)).orderBy(F.desc("refs"), "site", "rel").limit(20)


@query("excluded_paths", f"""WITH {PAGES_SQL} SELECT page_id, page,
    regexp_matches(page, '^fr$') OR len(list_filter(string_split(page, '/'), lambda s: s = 'fr' OR regexp_matches(s, '^[^/]*\\.html$') OR regexp_matches(s, '^[a-c][^/]*$'))) > 0 OR regexp_matches(page, '^de/[^/]*(/|$)') OR regexp_matches(page, '^en/[^/][0-9][^/]*(/|$)') AS excluded FROM cp""")
def excluded_paths(spark, sf_dir):
    return captured(spark, sf_dir).select("page_id", "page", paths.excluded(F.col("page"), list(PATTERNS)).alias("excluded"))


@query("site_directories", f"WITH {REFS_SQL} SELECT d.site, d.rel AS dir, count(i.rel) AS files FROM dirs d LEFT JOIN inv i ON i.site = d.site AND (d.rel = '' OR starts_with(i.rel, d.rel || '/')) GROUP BY d.site, d.rel")
def site_directories(spark, sf_dir):
    files = captured(spark, sf_dir).select("site", F.col("page").alias("rel"))
    inside = resolve.inventory(files).select("site", F.explode(F.concat(F.array(F.lit("")), paths.prefixes(F.col("rel")))).alias("dir")).groupBy("site", "dir").agg(F.count("*").alias("files"))
    return resolve.directories(files).join(inside, ["site", "dir"]).select("site", "dir", "files")


GRAPH_SQL = """l AS (SELECT l_orderkey, l_partkey, p_brand, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem JOIN part ON l_partkey = p_partkey),
    e AS (SELECT DISTINCT a.p_brand AS site, a.l_partkey AS src, b.l_partkey AS dst FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.p_brand = b.p_brand AND a.n < b.n AND a.l_partkey <> b.l_partkey),
    entry AS (SELECT p_brand AS site, min(p_partkey) AS page FROM part GROUP BY p_brand)"""
REACH_SQL = GRAPH_SQL + """, walk AS (SELECT site, page, 0 AS depth FROM entry UNION SELECT e.site, e.dst, walk.depth + 1 FROM walk JOIN e ON e.site = walk.site AND e.src = walk.page WHERE walk.depth < 40),
    reach AS (SELECT site, page, min(depth) AS depth FROM walk GROUP BY site, page)"""


def part_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, edges and entries of the derived graph; pages are part numbers padded to sort as text."""
    name = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("site"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").join(part, F.col("l_partkey") == F.col("p_partkey"))
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    n = lines.withColumn("n", F.row_number().over(at)).select("l_orderkey", "site", "l_partkey", "n")
    a, b = n.select("l_orderkey", "site", F.col("l_partkey").alias("s"), F.col("n").alias("i")), n.select("l_orderkey", "site", F.col("l_partkey").alias("d"), F.col("n").alias("j"))
    edges = a.join(b, ["l_orderkey", "site"]).filter("i < j and s <> d").groupBy("site", "s", "d").agg(F.min("l_orderkey").alias("seq"))
    entries = part.groupBy("site").agg(F.min("p_partkey").alias("p")).select("site", name("p").alias("entry"))
    return part.select("site", name("p_partkey").alias("page")), edges.select("site", name("s").alias("src"), name("d").alias("dst"), "seq"), entries


@query("crawl_depth", f"WITH RECURSIVE {REACH_SQL} SELECT site, page, depth FROM reach")
def crawl_depth(spark, sf_dir):
    _, edges, entries = part_graph(spark, sf_dir)
    return graph.levels(edges, entries).select("site", F.col("page").cast("long").alias("page"), "depth")


@query("crawl_unreachable", f"WITH RECURSIVE {REACH_SQL} SELECT p_brand AS site, p_partkey AS page FROM part WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.site = p_brand AND reach.page = p_partkey)")
def crawl_unreachable(spark, sf_dir):
    pages, edges, entries = part_graph(spark, sf_dir)
    return graph.unreachable(pages, graph.levels(edges, entries)).select("site", F.col("page").cast("long").alias("page"))


@query("crawl_levels", f"WITH RECURSIVE {REACH_SQL} SELECT site, depth, count(*) AS pages FROM reach GROUP BY site, depth")
def crawl_levels(spark, sf_dir):
    _, edges, entries = part_graph(spark, sf_dir)
    return graph.depth_counts(graph.levels(edges, entries))


@query("crawl_order", f"""WITH RECURSIVE {GRAPH_SQL}, o AS (SELECT a.p_brand AS site, a.l_partkey AS src, b.l_partkey AS dst, min(a.l_orderkey) AS seq FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.p_brand = b.p_brand AND a.n < b.n AND a.l_partkey <> b.l_partkey GROUP BY ALL),
    walk AS (SELECT site, page, 0 AS depth, []::BIGINT[] AS way FROM entry UNION ALL SELECT o.site, o.dst, walk.depth + 1, min(list_concat(walk.way, [o.seq, o.dst])) FROM walk JOIN o ON o.site = walk.site AND o.src = walk.page WHERE walk.depth < 40 GROUP BY o.site, o.dst, walk.depth),
    f AS (SELECT site, page, min(depth) AS depth, arg_min(way, depth) AS way FROM walk GROUP BY site, page)
    SELECT site, page, depth, row_number() OVER (PARTITION BY site ORDER BY depth, way) - 1 AS ord, CASE WHEN depth = 1 THEN (SELECT entry.page FROM entry WHERE entry.site = f.site) WHEN depth > 1 THEN way[2 * depth - 2] END AS parent FROM f""")
def crawl_order(spark, sf_dir):
    """Exact order of a single queue."""
    _, edges, entries = part_graph(spark, sf_dir)
    return graph.crawl(edges, entries).select("site", F.col("page").cast("long").alias("page"), "depth", "ord", F.col("parent").cast("long").alias("parent"))


@query("circle_components", f"""WITH RECURSIVE {GRAPH_SQL}, r AS (SELECT site, src AS a, dst AS b FROM e UNION SELECT r.site, r.a, e.dst FROM r JOIN e ON e.site = r.site AND e.src = r.b)
    SELECT p_brand AS site, p_partkey AS page, least(p_partkey, coalesce(min(y.a), p_partkey)) AS component FROM part LEFT JOIN r x ON x.site = p_brand AND x.a = p_partkey LEFT JOIN r y ON y.site = p_brand AND y.a = x.b AND y.b = p_partkey GROUP BY p_brand, p_partkey""")
def circle_components(spark, sf_dir):
    """Strongly connected components of every site's graph, named by their least page."""
    pages, edges, _ = part_graph(spark, sf_dir)
    found = circles.strong_components(pages.select("site", F.col("page").alias("node")), edges)
    return found.select("site", F.col("node").cast("long").alias("page"), F.col("component").cast("long").alias("component"))


FRAME_SQL = """f AS (SELECT p_brand AS site, p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey >= 3 UNION ALL SELECT p_brand, 1, p_partkey FROM part WHERE p_partkey % 997 = 5),
    g AS (SELECT 'all' AS site, src, dst FROM f), w AS (SELECT p_partkey AS root, p_partkey AS page, [p_partkey] AS path, 0 AS depth, NULL::VARCHAR AS code FROM part
    UNION ALL SELECT root, dst, CASE WHEN list_contains(path, dst) OR depth >= 8 THEN path ELSE list_append(path, dst) END, depth + 1, CASE WHEN list_contains(path, dst) THEN 'circular' WHEN depth >= 8 THEN 'too_deep' END FROM w JOIN g ON g.src = w.page WHERE code IS NULL)"""


def frame_graph(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    down = part.filter("k >= 3").select(F.col("k").alias("src"), F.expr("k div 3").alias("dst"))
    edges = down.union(part.filter("k % 997 = 5").select(F.lit(1).cast("long"), "k"))
    text = lambda c: F.col(c).cast("string").alias(c)
    return edges.select(F.lit("all").alias("site"), text("src"), text("dst"), F.col("dst").alias("seq")), part.select(F.lit("all").alias("site"), F.col("k").cast("string").alias("page"))


@query("frame_closure", f"WITH RECURSIVE {FRAME_SQL} SELECT root, page, depth, array_to_string(path, '/') AS path FROM w WHERE code IS NULL")
def frame_closure(spark, sf_dir):
    embedded, _ = graph.closure(*frame_graph(spark, sf_dir))
    return embedded.select(F.col("root").cast("long").alias("root"), F.col("page").cast("long").alias("page"), "depth", F.array_join("path", "/").alias("path"))


_LEVELS = "".join(f""", v{k} AS (SELECT own.page, 1 + coalesce(sum(v.copies), 0) AS copies, any_value(own.n) + coalesce(sum(v.n + v.x + 10), 0) AS n, any_value(own.x) + coalesce(sum(4 * v.s + 10), 0) AS x, any_value(own.s) + coalesce(sum(v.s + 2), 0) AS s
    FROM own LEFT JOIN f ON f.src = own.page LEFT JOIN v{k - 1} v ON v.page = f.dst GROUP BY own.page)""" for k in range(1, graph.FRAME_DEPTH + 1))


@query("frame_sizes", f"""WITH f AS (SELECT p_partkey AS src, p_partkey // 3 + k AS dst FROM part, range(0, 10) t(k) WHERE p_partkey >= 45), t AS (SELECT p_partkey AS page, '<p title="' || p_name || '">a & b' AS text FROM part),
    own AS (SELECT page, strlen(text) AS n, strlen(replace(replace(replace(replace(text, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;')) - strlen(text) AS x, 5 AS s FROM t), v0 AS (SELECT page, 1 AS copies, n, x, s FROM own){_LEVELS}
    SELECT page, copies::BIGINT AS copies, n::BIGINT AS bytes FROM v{graph.FRAME_DEPTH}""")
def frame_sizes(spark, sf_dir):
    """Pages of ten frames each, some levels deep: how large they would become."""
    part = table(spark, sf_dir, "part")
    text = F.concat(F.lit('<p title="'), "p_name", F.lit('">a & b'))
    own = part.select(F.lit("all").alias("site"), F.col("p_partkey").alias("page"), F.octet_length(text).alias("bytes"), (F.octet_length(rewrite.escape_attribute(text)) - F.octet_length(text)).alias("escaped"), F.regexp_count(text, F.lit('[&"<>]')).alias("signs"))
    edges = part.filter("p_partkey >= 45").select(F.lit("all").alias("site"), F.col("p_partkey").alias("src"), F.explode(F.sequence(F.expr("p_partkey div 3"), F.expr("p_partkey div 3 + 9"))).alias("dst"))
    return graph.frame_sizes(edges, own).select("page", "copies", "bytes")


@query("frame_refusals", f"WITH RECURSIVE {FRAME_SQL} SELECT code, count(*) AS n FROM w WHERE code IS NOT NULL GROUP BY code")
def frame_refusals(spark, sf_dir):
    _, refused = graph.closure(*frame_graph(spark, sf_dir))
    return refused.groupBy("code").agg(F.count("*").alias("n"))


@query("import_heights", """WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey >= 2), h AS (SELECT p_partkey AS node, 0 AS d, p_partkey AS top FROM part UNION ALL SELECT e.dst, d + 1, top FROM h JOIN e ON e.src = h.node)
    SELECT top AS node, max(d) AS height FROM h GROUP BY top""")
def import_heights(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.lit("all").alias("site"))
    edges = part.filter("node >= 2").select("site", F.col("node").alias("src"), F.expr("node div 2").alias("dst"))
    return graph.heights(part, edges).select("node", "height")


RESOURCES_SQL = """f AS (SELECT lang AS site, doc_id AS ord, 'doc-' || doc_id AS rel, CASE length(text) % 3 WHEN 0 THEN 'text/css' WHEN 1 THEN 'text/javascript' ELSE 'image/svg+xml' END AS mime, length(text) % 2 = 0 AS is_text, encode(text) AS data FROM documents),
    h AS (SELECT *, sha256(encode(mime) || '\\x00'::BLOB || encode(CASE WHEN is_text THEN 't' ELSE 'b' END) || data) AS hash, octet_length(data) AS size FROM f),
    d AS (SELECT site, hash, min(ord) AS ord, arg_min(rel, ord) AS first_rel, arg_min(mime, ord) AS mime, arg_min(is_text, ord) AS is_text, arg_min(size, ord) AS size, count(*) AS refs FROM h GROUP BY site, hash)"""


def resources(spark, sf_dir) -> DataFrame:
    k = F.length("text") % 3
    docs = table(spark, sf_dir, "documents")
    return store.add_hashes(docs.select(F.col("lang").alias("site"), F.col("doc_id").alias("ord"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("rel"), F.when(k == 0, "text/css").when(k == 1, "text/javascript").otherwise("image/svg+xml").alias("mime"), (F.length("text") % 2 == 0).alias("is_text"), F.encode("text", "utf-8").alias("data")))


@query("resource_dedup", f"WITH {RESOURCES_SQL} SELECT site, hash, ord, first_rel, mime, is_text, size, refs FROM d")
def resource_dedup(spark, sf_dir):
    return store.deduplicate(resources(spark, sf_dir))


@query("resource_totals", f"WITH {RESOURCES_SQL} SELECT site, count(*) AS resources, sum(size)::BIGINT AS resource_bytes FROM d GROUP BY site")
def resource_totals(spark, sf_dir):
    return store.totals(store.deduplicate(resources(spark, sf_dir)))


@query("shared_resources", f"WITH {RESOURCES_SQL} SELECT hash, count(*) AS refs, count(DISTINCT site) AS sites, max(size) AS size, (count(*) - 1) * max(size) AS saved_bytes FROM h GROUP BY hash ORDER BY saved_bytes DESC, hash LIMIT 25")
def shared_resources(spark, sf_dir):
    return store.shared_resources(resources(spark, sf_dir), 25)


@query("resource_keys", f"""WITH {RESOURCES_SQL}, a AS (SELECT site, hash, ord, row_number() OVER (PARTITION BY site, hash[1:1] ORDER BY ord, hash) AS n FROM d),
    b AS (SELECT site, hash, ord, row_number() OVER (PARTITION BY site, hash[1:2] ORDER BY ord, hash) AS n FROM a WHERE n > 1), c AS (SELECT site, hash, ord, row_number() OVER (PARTITION BY site, hash[1:3] ORDER BY ord, hash) AS n FROM b WHERE n > 1)
    SELECT site, hash, hash[1:1] AS key FROM a WHERE n = 1 UNION ALL SELECT site, hash, hash[1:2] FROM b WHERE n = 1 UNION ALL SELECT site, hash, hash[1:3] FROM c WHERE n = 1 UNION ALL SELECT site, hash, hash[1:4] FROM c WHERE n > 1""")
def resource_keys(spark, sf_dir):
    return store.assign_keys(store.deduplicate(resources(spark, sf_dir)), 1, 1, 4).select("site", "hash", "key")


@query("size_limit", f"WITH {RESOURCES_SQL} SELECT site, count(*) FILTER (size > 4000) AS over, count(*) FILTER (size <= 4000) AS fits FROM h GROUP BY site")
def size_limit(spark, sf_dir):
    rows = resources(spark, sf_dir).drop("data")
    limits = rows.select("site").distinct().withColumn("max_resource_size", F.lit(4000))
    fits, over = store.within_limit(rows, limits)
    both = fits.select("site", F.lit(0).alias("o")).unionByName(over.select("site", F.lit(1).alias("o")))
    return both.groupBy("site").agg(F.sum("o").alias("over"), F.sum(1 - F.col("o")).alias("fits"))


@query("mime_types", """WITH f AS (SELECT doc_id, 'files/' || doc_id || (CASE doc_id % 5 WHEN 0 THEN '.css' WHEN 1 THEN '.PNG' WHEN 2 THEN '.woff2' WHEN 3 THEN '.unknown' ELSE '' END) AS rel, text FROM documents)
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'text/css' WHEN 1 THEN 'image/png' WHEN 2 THEN 'font/woff2' ELSE 'text/plain' END AS mime FROM f""")
def mime_types(spark, sf_dir):
    k = F.col("doc_id") % 5
    ending = F.when(k == 0, ".css").when(k == 1, ".PNG").when(k == 2, ".woff2").when(k == 3, ".unknown").otherwise("")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", resolve.mime_type(F.concat(F.lit("files/"), F.col("doc_id"), ending), F.encode("text", "utf-8")).alias("mime"))


@query("data_urls", "SELECT doc_id, md5('data:text/plain;base64,' || base64(encode(text))) AS url_md5 FROM documents")
def data_urls(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(F.encode(store.base64_url(F.lit("text/plain"), F.encode("text", "utf-8")), "utf-8")).alias("url_md5"))


@query("percent_encoded", "SELECT doc_id, md5(replace(replace(replace(replace(replace(url_encode(text), '%2A', '*'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')')) AS encoded_md5 FROM documents")
def percent_encoded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(F.encode(paths.encode_component(F.col("text")), "utf-8")).alias("encoded_md5"))


@query("routes", f"WITH {PAGES_SQL} SELECT page_id, '#/' || array_to_string(list_transform(string_split(page, '/'), lambda s: url_encode(s)), '/') || '?id=' || page_id || '#top' AS route FROM cp")
def routes(spark, sf_dir):
    return captured(spark, sf_dir).select("page_id", paths.route(F.col("page"), F.concat(F.lit("id="), F.col("page_id")), F.lit("top")).alias("route"))


@query("route_lookup", f"WITH {PAGES_SQL}, i AS (SELECT DISTINCT site, page FROM cp) SELECT c.page_id, coalesce(a.page, b.page) AS page FROM cp c LEFT JOIN i a ON a.site = c.site AND a.page = regexp_replace(c.page, 'index.html$', '') LEFT JOIN i b ON b.site = c.site AND b.page = CASE WHEN rtrim(regexp_replace(c.page, 'index.html$', ''), '/') = '' THEN 'index.html' ELSE rtrim(regexp_replace(c.page, 'index.html$', ''), '/') || '/index.html' END")
def route_lookup(spark, sf_dir):
    pages = captured(spark, sf_dir)
    links = pages.select("page_id", "site", paths.route(F.regexp_replace("page", "index.html$", ""), F.lit("q=1"), F.lit("")).alias("address"))
    return rewrite.look_up_links(links, pages.select("site", "page").distinct()).select("page_id", "page")


@query("srcset_candidates", "SELECT doc_id, 'img/' || doc_id || '-' || k || '.png' AS url, k || 'x' AS descr FROM documents, (VALUES (1), (2), (3)) v(k)")
def srcset_candidates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.concat(F.lit("img/"), F.col("doc_id"), F.lit("-"), k, F.lit(".png "), k, F.lit("x"))), " , ").alias("s"))
    return docs.select("doc_id", F.explode(extract.srcset(F.col("s"))).alias("c")).select("doc_id", "c.url", F.col("c.desc").alias("descr"))


def derived_sheets(spark, sf_dir) -> DataFrame:
    """A sheet for each document: an import, two urls, one of them in a comment, and a string."""
    k = F.col("doc_id").cast("string")
    text = F.concat(F.lit('@import "base-'), k, F.lit('.css";\n/* url(no.png) */ a { background: url(img/'), k, F.lit(".png) } b::after { content: 'url(x)' } c { src: url(\"f "), k, F.lit('.woff") }'))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("site"), k.alias("page"), text.alias("text"))


@query("css_refs", "SELECT source AS site, doc_id::VARCHAR AS page, kind, replace(raw, '?', doc_id::VARCHAR) AS raw FROM documents, (VALUES ('import', 'base-?.css'), ('url', 'img/?.png'), ('url', 'f ?.woff')) v(kind, raw)")
def css_refs(spark, sf_dir):
    return sheets.sheet_references(derived_sheets(spark, sf_dir)).select("site", "page", "kind", "raw")


@query("css_rewritten", """SELECT doc_id::VARCHAR AS page, '@import "base-' || doc_id || '.css";' || chr(10) || '/* url(no.png) */ a { background: url("new/' || doc_id || '") } b::after { content: ''url(x)'' } c { src: url("f ' || doc_id || '.woff") }' AS text FROM documents""")
def css_rewritten(spark, sf_dir):
    rows = derived_sheets(spark, sf_dir)
    new = rows.select("site", "page", F.concat(F.lit("img/"), "page", F.lit(".png")).alias("raw"), F.concat(F.lit("new/"), "page").alias("new"))
    return sheets.splice(rows, new).select("page", "text")


def rewritten(spark, sf_dir) -> DataFrame:
    """Every page of the tables rewritten: links, removals, head, mark."""
    pages = captured(spark, sf_dir).select("page_id", "site", "page", "text")
    pages = pages.withColumn("_n", F.row_number().over(Window.partitionBy("site", "page").orderBy("page_id"))).filter("_n = 1").drop("_n")
    tags = graph.saved(page_tags(pages))
    refs = resolve.look_up(graph.saved(resolve.resolve(extract.references(tags).withColumn("base", F.col("page")))), pages.select("site", F.col("page").alias("rel")))
    none = pages.select("site", F.lit("").alias("rel"), F.lit("").alias("key"), F.lit(False).alias("is_text")).limit(0)
    heads = extract.page_heads(tags, ["site", "page"])
    changes = rewrite.link_changes(refs, tags, none).unionByName(rewrite.removal_changes(tags)).unionByName(rewrite.head_changes(tags, heads))
    return rewrite.apply_changes(pages, changes)


REWRITE_SQL = PAGES_SQL + """, one AS (SELECT * FROM cp QUALIFY row_number() OVER (PARTITION BY site, page ORDER BY page_id) = 1),
    rw AS (SELECT page_id, site, page, text AS captured, replace(regexp_replace(regexp_replace(text, '<meta charset="utf-8">', ''), '<html', '<html data-sitepack-page="' || page || '"'), '<head>', '<head><meta charset="utf-8"><base target="_top">') AS text FROM one)"""


@query("pages_rewritten", f"WITH {REWRITE_SQL} SELECT page_id, site, page, md5(text) AS text_md5 FROM rw")
def pages_rewritten(spark, sf_dir):
    return rewritten(spark, sf_dir).select("page_id", "site", "page", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


def packed(spark, sf_dir):
    """Entries, rewritten pages, no resources, and heads of every site."""
    pages = graph.saved(rewritten(spark, sf_dir))
    none = pages.select("site", F.lit("").alias("key"), F.lit("").alias("mime"), F.lit(False).alias("is_text"), F.lit("").alias("value")).limit(0)
    heads = extract.page_heads(page_tags(pages), ["site", "page"]).select("site", "page", "title", "lang")
    full = pages.join(heads, ["site", "page"], "left").select("site", "page", "title", F.col("text").alias("html"))
    sites = pages.groupBy("site").agg(F.min("page").alias("entry"))
    return sites, full, none, heads


@query("oversize_sites", f"WITH {REWRITE_SQL} SELECT site, sum(strlen(text))::BIGINT AS bytes FROM rw GROUP BY site HAVING sum(strlen(text)) > 100000")
def oversize_sites(spark, sf_dir):
    """Sites whose rewritten pages exceed 100,000 bytes (a bound that the given tables reach)."""
    pages = rewritten(spark, sf_dir).select("site", F.col("text").alias("html"))
    return payload.oversize(pages, pages.select("site", F.col("html").alias("value")).limit(0), 100_000)


@query("charset_names", """WITH l AS (SELECT page_id, [' UTF-8', 'Latin1', 'windows-' || (1250 + page_id % 9), 'iso_8859-' || (2 + page_id % 4), 'none-' || page_id][1 + page_id % 5] AS label FROM pages)
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'windows-1252' WHEN 2 THEN label WHEN 3 THEN 'iso-8859-' || (2 + page_id % 4) END AS name FROM l""")
def charset_names(spark, sf_dir):
    """The encodings that labels name, a label of one of five kinds for each page."""
    k, n = F.col("page_id"), lambda m: (F.col("page_id") % m).cast("int")
    label = F.when(n(5) == 0, " UTF-8").when(n(5) == 1, "Latin1").when(n(5) == 2, F.concat(F.lit("windows-"), 1250 + n(9))).when(n(5) == 3, F.concat(F.lit("iso_8859-"), 2 + n(4))).otherwise(F.concat(F.lit("none-"), k))
    return table(spark, sf_dir, "pages").select("page_id", charset.charset_name(label).alias("name"))


@query("files_by_media_type", f"WITH {PAGES_SQL} SELECT 'text/html' AS mime, count(*) AS files FROM cp")
def files_by_media_type(spark, sf_dir):
    """Captured pages by media type: by extension, else by their first bytes."""
    rows = captured(spark, sf_dir).select(resolve.mime_type(F.col("page"), F.encode("text", "utf-8")).alias("mime"))
    return rows.groupBy("mime").agg(F.count("*").alias("files"))


SMALL_PART = 20_000
PAYLOAD_SQL = f"""{REWRITE_SQL}, t AS (SELECT site, page, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(captured, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS title, text FROM rw),
    s AS (SELECT site, min(page) AS entry, count(*) AS n_pages, string_agg(to_json(page)::VARCHAR || ':{{"title":' || to_json(title)::VARCHAR || ',"html":' || to_json(text)::VARCHAR || '}}', ',' ORDER BY encode(page)) AS body FROM t GROUP BY site)"""
PAYLOAD = """replace(replace(replace('{"v":1,"generator":"sitepack","entry":' || to_json(entry)::VARCHAR || ',"pages":{' || body || '},"resources":{}}', '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"""


@query("site_payload", f"WITH {PAYLOAD_SQL} SELECT site, n_pages, md5({PAYLOAD}) AS payload_md5 FROM s")
def site_payload(spark, sf_dir):
    """Pages and the digest of every site's payload, taken over its parts in order."""
    sites, pages, none, _ = packed(spark, sf_dir)
    counts = pages.groupBy("site").agg(F.count("*").alias("n_pages"))
    return parts.digests(parts.parts(sites, pages, none)).join(counts, "site").select("site", "n_pages", F.col("md5").alias("payload_md5"))


@query("payload_parts", f"""WITH {PAYLOAD_SQL}, whole AS (SELECT site, {PAYLOAD} AS payload FROM s)
    SELECT site, part, md5(substr(payload, (part * {SMALL_PART} + 1)::BIGINT, {SMALL_PART})) AS text_md5 FROM (SELECT site, payload, unnest(range(0, (length(payload) + {SMALL_PART} - 1) // {SMALL_PART})) AS part FROM whole)""")
def payload_parts(spark, sf_dir):
    """Every payload in parts of 20,000 characters, of which the sites of the given tables have several."""
    sites, pages, none, _ = packed(spark, sf_dir)
    return parts.parts(sites, pages, none, part=SMALL_PART).select("site", "part", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


@query("bundle_files", f"WITH {REWRITE_SQL} SELECT site, page, md5(text) AS html_md5 FROM rw")
def bundle_files(spark, sf_dir):
    """Write every site's document in small parts to files, read the files, and return the pages found in them."""
    sites, pages, none, heads = packed(spark, sf_dir)
    folder = graph.scratch(spark)
    io.write_bundles(parts.parts(sites, pages, none, payload.titles(sites, heads), part=SMALL_PART), folder)
    back, _ = io.read_bundles(spark, folder)
    return back.select("site", "page", F.md5(F.encode("html", "utf-8")).alias("html_md5"))


@query("bundle_round_trip", f"WITH {REWRITE_SQL} SELECT site, page, md5(text) AS html_md5 FROM rw")
def bundle_round_trip(spark, sf_dir):
    """Assemble every site's document, read the documents back, and return the pages found in them."""
    sites, pages, none, heads = packed(spark, sf_dir)
    back, _ = parts.read_parts(parts.parts(sites, pages, none, payload.titles(sites, heads)))
    return back.select("site", "page", F.md5(F.encode("html", "utf-8")).alias("html_md5"))


@query("bundle_integrity", f"WITH {REWRITE_SQL} SELECT site, page, '' AS kind, '' AS name FROM rw WHERE false")
def bundle_integrity(spark, sf_dir):
    _, pages, none, _ = packed(spark, sf_dir)
    return payload.integrity(pages, none)


DIAG_SQL = REFS_SQL + ", diag AS (SELECT site, page, CASE WHEN kind = 'excluded' THEN 'info' ELSE 'warning' END AS level, kind AS code FROM refs WHERE kind IN ('missing', 'outside', 'invalid', 'excluded'))"


@query("diag_counts", f"WITH {DIAG_SQL} SELECT site, level, code, count(*) AS n FROM diag GROUP BY site, level, code")
def diag_counts(spark, sf_dir):
    return report.diagnostics(resolved(spark, sf_dir)).groupBy("site", "level", "code").agg(F.count("*").alias("n"))


@query("strict_sites", f"WITH {DIAG_SQL} SELECT site, count(*) AS warnings FROM diag WHERE level = 'warning' GROUP BY site")
def strict_sites(spark, sf_dir):
    return report.strict_failures(report.diagnostics(resolved(spark, sf_dir)))


@query("site_summary", f"""WITH {REWRITE_SQL}, t AS (SELECT site, page, captured, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(captured, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM rw),
    s AS (SELECT site, min(page) AS entry, count(*) AS pages, arg_min(title, page) AS title, sum(strlen(captured))::BIGINT AS resource_bytes FROM t GROUP BY site)
    SELECT site, entry, CASE WHEN title = '' THEN site ELSE title END AS title, pages, pages AS files, pages AS resources, resource_bytes, CASE WHEN resource_bytes >= 1048576 THEN format('{{:.1f}} MiB', resource_bytes / 1048576.0) WHEN resource_bytes >= 1024 THEN format('{{:.1f}} KiB', resource_bytes / 1024.0) ELSE resource_bytes::VARCHAR || ' B' END AS human FROM s""")
def site_summary(spark, sf_dir):
    """The summary of every site, its captured pages taken for the stored files."""
    pages = captured(spark, sf_dir)
    one = pages.groupBy("site", "page").agg(F.min_by("text", "page_id").alias("text"))
    sites = one.groupBy("site").agg(F.min("page").alias("entry"))
    heads = extract.page_heads(page_tags(one), ["site", "page"])
    totals = store.totals(one.select("site", F.octet_length("text").cast("long").alias("size")))
    rows = report.summary(sites, one.select("site", "page"), payload.titles(sites, heads), totals, files=one.select("site", "page"))
    return rows.withColumn("human", report.human_size(F.col("resource_bytes")))
