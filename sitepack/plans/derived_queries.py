"""Queries of single operators over rows that Spark derives from every document or page, each with its twin in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import charset
from ..operators import expansion, extract, graph, parts, payload, report, resolve, sheets, store
from ..operators.payload import CLOSE, OPEN, SHELL
from .queries import DIAG_SQL, PAYLOAD, PAYLOAD_SQL, REFS_SQL, RESOURCES_SQL, packed, query, resolved, resources, table


def _documents(spark, sf_dir, *columns) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), *columns)


def _turn(values, by=None):
    """One of ``values`` in turn, by document."""
    return F.element_at(F.array(*map(F.lit, values)), ((F.col("k") if by is None else by) % len(values) + 1).cast("int"))


def _pages(rows: DataFrame, html, page: str = "a/b.html") -> DataFrame:
    """A site of its own for each document, with one page."""
    return rows.select(F.col("k").cast("string").alias("site"), F.lit(page).alias("page"), html.alias("text"))


# Base elements in turn, and what becomes of a link to c.html in a/b.html: its kind, path, and the problem reported.
BASES = (("sub/", "file", "a/sub/c.html", None), ("/", "file", "c.html", None), ("../../x/", "missing", "a/c.html", "base_outside"), ("https://e.org/", "external", "", "base_external"), ("100%", "missing", "a/c.html", "base_invalid"), ("#f", "missing", "a/c.html", None))


@query("page_bases", f"SELECT doc_id::VARCHAR AS site, v.kind, v.rel, v.problem FROM documents JOIN (VALUES {', '.join('(' + str(i) + ', ' + ', '.join('NULL' if x is None else repr(x) for x in row) + ')' for i, row in enumerate(BASES))}) v(i, base, kind, rel, problem) ON v.i = doc_id % {len(BASES)}")
def page_bases(spark, sf_dir):
    """A link under each kind of base element, and the problems of these."""
    rows = _documents(spark, sf_dir)
    pages = _pages(rows, F.concat(F.lit('<base href="'), _turn([b for b, *_ in BASES]), F.lit('"><a href="c.html">c</a>')))
    tags = extract.tags(pages)
    heads = extract.page_heads(tags, ["site", "page"])
    refs = extract.with_base(extract.references(tags).filter("role = 'link'"), heads, ["site", "page"], "page")
    files = rows.select(F.col("k").cast("string").alias("site"), F.explode(F.array(F.lit("c.html"), F.lit("a/sub/c.html"))).alias("rel"))
    found = resolve.look_up(resolve.resolve(refs, base_external="base_external"), files)
    problems = extract.base_problems(heads, ["site", "page"], "page").select("site", F.col("code").alias("problem"))
    return found.join(problems, "site", "left").select("site", "kind", "rel", "problem")


@query("page_forms", "SELECT doc_id::VARCHAR AS site, v.tag, v.attr, replace(v.raw, '?', doc_id::VARCHAR) AS raw FROM documents, (VALUES ('form', 'action', 'send/?'), ('input', 'formaction', 'other/?'), ('button', 'formaction', '?.html')) v(tag, attr, raw)")
def page_forms(spark, sf_dir):
    k = F.col("k").cast("string")
    html = F.concat(F.lit("<form ACTION='send/"), k, F.lit('\'><input type=submit formaction="other/'), k, F.lit('"><button formaction='), k, F.lit('.html>x</button><button formaction=""></form><form>'))
    return extract.references(extract.tags(_pages(_documents(spark, sf_dir), html))).filter("role = 'form'").select("site", "tag", "attr", "raw")


@query("page_modules", "SELECT doc_id::VARCHAR AS site, CASE doc_id % 4 WHEN 3 THEN 'm.js' ELSE '' END AS ref FROM documents WHERE doc_id % 4 IN (0, 1, 3)")
def page_modules(spark, sf_dir):
    """Modules that import others: by a statement, by an expression, not at all, or in a file."""
    rows = _documents(spark, sf_dir)
    bodies = ['<script type="module">import x from "./x.js"</script>', "<script type=module>let a = import('./y.js')</script>", '<script type=module>let important = 1</script><script>import "z"</script>', '<script type=module src="m.js"></script>']
    tags = extract.tags(_pages(rows, _turn(bodies), "b.html"))
    files = rows.select(F.col("k").cast("string").alias("site"), F.lit("m.js").alias("rel"))
    refs = resolve.look_up(resolve.resolve(extract.references(tags).withColumn("base", F.col("page"))), files)
    scripts = files.withColumn("text", F.lit("export * from './other.js'"))
    return extract.module_imports(tags, refs, scripts).select("site", "ref")


@query("sheet_charsets", """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, ['windows-1252', 'utf-8', 'utf-16le', 'utf-16be', 'utf-8'][doc_id % 5 + 1] AS charset, md5('a{' || CASE WHEN doc_id % 5 = 0 THEN regexp_replace(text, '[^\\x01-\\x7F]', '', 'g') || chr(233) ELSE text END || '}') AS text_md5 FROM d""")
def sheet_charsets(spark, sf_dir):
    """Sheets in five encodings: by their own rule, by byte-order marks, and without any."""
    text = F.coalesce("text", F.lit(""))
    rows = _documents(spark, sf_dir, text.alias("t"))
    body = F.concat(F.lit("a{"), F.col("t"), F.lit("}"))
    latin = F.concat(F.lit('@charset "windows-1252";a{'), F.regexp_replace("t", r"[^\x01-\x7F]", ""), F.lit("é}"))
    rule = F.concat(F.lit(' @charset  "utf-8" ; '), body)
    n = F.col("k") % 5
    content = (F.when(n == 0, F.encode(latin, "ISO-8859-1")).when(n == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(body, "utf-8"))).when(n == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(body, "UTF-16LE")))
               .when(n == 3, F.concat(F.unhex(F.lit("FEFF")), F.encode(body, "UTF-16BE"))).otherwise(F.encode(rule, "utf-8")))
    read = charset.decode(rows.select("k", content.alias("content")), [charset.sniff_css(F.col("content"))])
    return read.select(F.col("k").alias("doc_id"), "charset", F.md5(F.encode(charset.strip_css_charset(F.col("text")), "utf-8")).alias("text_md5"))


@query("css_values", "SELECT doc_id::VARCHAR AS page, kind, replace(raw, '?', doc_id::VARCHAR) AS raw FROM documents, (VALUES ('url', 'xAy?'), ('url', 'a b?'), ('url', 'q?z'), ('url', 'n?' || chr(65533)), ('import', 's\"?.css'), ('url', 'i?.png')) v(kind, raw)")
def css_values(spark, sf_dir):
    """Escapes in strings and addresses: code points, signs, line ends, what is no code point; and image-set."""
    k = F.col("k").cast("string")
    text = F.concat(F.lit('@import "s\\"'), k, F.lit('.css"; a{b:url("x\\41 y'), k, F.lit('")} c{d:url(a\\ b'), k, F.lit(")} e{f:url('q"), k, F.lit("\\\nz')} g{h:url(\"n"), k, F.lit('\\0")} i{j:image-set("i'), k, F.lit('.png" 1x)}'))
    rows = _documents(spark, sf_dir).select(F.lit("s").alias("site"), k.alias("page"), text.alias("text"))
    return sheets.sheet_references(rows).select("page", "kind", "raw")


_FRONT, _BACK = SHELL[0] + OPEN, CLOSE + SHELL[1]


def _document_sql() -> str:
    text = "'" + _FRONT.replace("'", "''").replace("{generator}", "sitepack") + "'"
    title = "replace(replace(replace(replace(title, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;')"
    return text.replace("{lang}", "' || lang || '").replace("{title}", f"' || {title} || '") + f" || {PAYLOAD} || '" + _BACK.replace("'", "''") + "'"


@query("site_documents", f"""WITH {PAYLOAD_SQL}, x AS (SELECT s.site, s.entry, s.body, CASE WHEN t.title <> '' THEN t.title ELSE s.site END AS title, CASE WHEN regexp_extract(rw.captured, '<html lang="([^"]*)"', 1) <> '' THEN ' lang="' || regexp_extract(rw.captured, '<html lang="([^"]*)"', 1) || '"' ELSE '' END AS lang
        FROM s JOIN t ON t.site = s.site AND t.page = s.entry JOIN rw ON rw.site = s.site AND rw.page = s.entry) SELECT site, md5({_document_sql()}) AS html_md5 FROM x""")
def site_documents(spark, sf_dir):
    """Digests of the whole documents: shell, title, language and payload."""
    sites, pages, none, heads = packed(spark, sf_dir)
    return parts.digests(parts.parts(sites, pages, none, payload.titles(sites, heads))).select("site", F.col("md5").alias("html_md5"))


@query("diag_lines", f"""WITH {REFS_SQL}, n AS (SELECT page, raw, kind, CASE WHEN kind = 'excluded' THEN 'info' ELSE 'warning' END AS level, CASE kind {' '.join(f"WHEN '{c}' THEN '{report.CODES[c][1]}'" for c in ('missing', 'outside', 'invalid', 'excluded'))} END AS message FROM refs WHERE kind IN ('missing', 'outside', 'invalid', 'excluded'))
    SELECT level || ': ' || page || ': ' || CASE WHEN raw = '' THEN '' ELSE '"' || replace(replace(raw, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '": ' END || message AS line, count(*) AS n FROM n GROUP BY ALL""")
def diag_lines(spark, sf_dir):
    """Diagnostics of all references as lines of text."""
    rows = report.diagnostics(resolved(spark, sf_dir))
    return rows.groupBy(report.format_line(*(F.col(c) for c in ("level", "page", "ref", "message"))).alias("line")).agg(F.count("*").alias("n"))


@query("integrity_faults", """WITH d AS (SELECT doc_id AS k, md5(doc_id::VARCHAR)[1:16] AS key FROM documents)
    SELECT 's' || d.k % 5 AS site, 'p' || d.k || '.html' AS page, 'resource' AS kind, d.key AS name FROM d WHERE d.k % 3 = 0
    UNION ALL SELECT 's' || d.k % 5, 'p' || d.k || '.html', 'page', 'p' || (d.k + 35) || '.html' FROM d LEFT JOIN d e ON e.k = d.k + 35 WHERE e.k IS NULL""")
def integrity_faults(spark, sf_dir):
    """Pages of five sites whose third resource is lost each time, and whose links lead past the last page."""
    k, key = F.col("k").cast("string"), F.substring(F.md5(F.col("k").cast("string").cast("binary")), 1, 16)
    rows = _documents(spark, sf_dir).withColumn("site", F.concat(F.lit("s"), F.col("k") % 5))
    html = F.concat(F.lit('<img src="'), store.placeholder(key), F.lit('"><a href="#/p'), (F.col("k") + 35).cast("string"), F.lit('.html?a=b#c">x</a>'))
    pages = rows.select("site", F.concat(F.lit("p"), k, F.lit(".html")).alias("page"), html.alias("html"))
    kept = rows.filter("k % 3 != 0").select("site", key.alias("key"), F.lit(False).alias("is_text"), F.lit("").alias("value"))
    return payload.integrity(pages, kept)


_KINDS = [*((m, t) for m, t in resolve.MAGIC), ("3C21444F43545950452068746D6C3E", "text/html"), ("3C3F786D6C20", "text/xml"), ("68656C6C6F0A", "text/plain"), ("6100026263", "application/octet-stream"), ("524946460000000057454250", "image/webp")]


@query("sniffed_types", f"SELECT doc_id, v.mime FROM documents JOIN (VALUES {', '.join(f'({i}, {m!r})' for i, (_, m) in enumerate(_KINDS))}) v(i, mime) ON v.i = doc_id % {len(_KINDS)}")
def sniffed_types(spark, sf_dir):
    """Files without an extension that begin with the leading bytes of each known format, with a document's text behind them."""
    content = F.concat(F.unhex(_turn([m for m, _ in _KINDS])), F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    rows = _documents(spark, sf_dir, "text")
    return rows.select(F.col("k").alias("doc_id"), resolve.mime_type(F.concat(F.lit("files/"), F.col("k").cast("string")), content).alias("mime"))


def _keys_sql(rounds: int, most: int) -> str:
    """Key rounds as nested levels: round 0 are the resources, the texts of each later one hold the keys of the one before."""
    out, taken = [RESOURCES_SQL], "SELECT NULL AS site, NULL AS hash, NULL AS key WHERE false"
    for r in range(rounds):
        if r:
            text = "sha256(encode('text/css') || '\\x00'::BLOB || encode('t') || encode('use ' || key))"
            out.append(f"n{r} AS (SELECT DISTINCT site, {text} AS hash, 0 AS ord FROM k{r - 1}), t{r} AS (SELECT * FROM n{r} ANTI JOIN a{r - 1} USING (site, hash))")
        left, done = f"t{r}" if r else "d", []
        for n in range(1, most + 1):
            where = "WHERE NOT fine" if n > 1 else ""
            out.append(f"l{r}_{n} AS (SELECT x.site, x.hash, x.ord, row_number() OVER (PARTITION BY x.site, x.hash[1:{n}] ORDER BY x.ord, x.hash) = 1 AND p.key IS NULL OR {n} = {most} AS fine FROM (SELECT site, hash, ord FROM {left} {where}) x LEFT JOIN ({taken}) p ON p.site = x.site AND p.key = x.hash[1:{n}])")
            left = f"l{r}_{n}"
            done.append(f"SELECT site, hash, hash[1:{n}] AS key FROM {left} WHERE fine")
        out.append(f"k{r} AS ({' UNION ALL '.join(done)}), a{r} AS (SELECT * FROM k{r}{f' UNION ALL SELECT * FROM a{r - 1}' if r else ''})")
        taken = f"SELECT * FROM a{r}"
    return f"WITH {', '.join(out)} SELECT site, hash, key FROM a{rounds - 1}"


@query("keys_in_rounds", _keys_sql(3, 6))
def keys_in_rounds(spark, sf_dir):
    """Keys of a store that grows by rounds, from one digit on: each document's resource, then a sheet that names each new key, twice."""
    distinct = store.deduplicate(resources(spark, sf_dir))
    known = graph.saved(store.assign_keys(distinct, 1, 1, 6).select("site", "hash", "key"))
    last = known
    for _ in range(2):
        seen = known
        _, known = store.key_texts(last.select("site", F.concat(F.lit("use "), "key").alias("text")), "text/css", seen, 1, 1, 6)
        last = known.join(seen.select("site", "hash"), ["site", "hash"], "left_anti")
    return known


# What the names of a document's resources are, and the texts on its circle; {x} stands for a placeholder of x.
LADDER, CIRCLE, BUDGET = 4, {"x": "x.{y}.{z}.{l1}", "y": "y.{x}.{z}", "z": "z.{x}.{y}.{y}"}, 20_000
# The walks on that circle on which no name repeats, with their depths and how often each stands.
WALKS = [("x", "x", 0, 1), ("x", "y", 1, 1), ("x", "z", 1, 1), ("x", "z", 2, 1), ("x", "y", 2, 2), ("y", "y", 0, 1), ("y", "x", 1, 1), ("y", "z", 1, 1), ("y", "z", 2, 1), ("y", "x", 2, 1), ("z", "z", 0, 1), ("z", "x", 1, 1), ("z", "y", 1, 2), ("z", "y", 2, 1), ("z", "x", 2, 2)]


def _ladder_sql() -> str:
    """Sizes by hand: 23 bytes of a sheet's head stay when escaped again and 5 do not; a placeholder has 29."""
    counts = lambda text, name: f"strlen(regexp_replace({text}, '[^A-Za-z0-9_.!~*''()-]', '', 'g')) AS {name}k, strlen({text}) - {name}k AS {name}s"
    url = "'data:image/png;base64,' || base64(encode(text))"
    out = [f"d AS (SELECT doc_id AS k, doc_id % 3 + 1 AS m, {counts('text', 't')}, {counts(url, 'b')} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))",
           "r0 AS (SELECT k, m, 23 + (tk + 1 + bk) + 2 * (ts + bs) AS vk, 5 + ts + bs AS vs, vk + vs AS bytes, bytes > %d AS refused FROM d)" % BUDGET]
    for n in range(1, LADDER + 1):
        kept, signs = "(CASE WHEN refused THEN 29 * m ELSE m * vk END + m - 1)", "CASE WHEN refused THEN 0 ELSE m * vs END"
        out.append(f"r{n} AS (SELECT k, m, nk AS vk, ns AS vs, nk + ns AS bytes, NOT was AND nk + ns > {BUDGET} AS refused FROM (SELECT k, m, refused AS was, 23 + {kept} + 2 * {signs} AS nk, 5 + {signs} AS ns FROM r{n - 1}))")
    walks = ", ".join(map(repr, WALKS))
    out.append("own AS (SELECT k, 'x' AS node, 62 + CASE WHEN refused THEN 29 ELSE vk END AS kept, CASE WHEN refused THEN 0 ELSE vs END AS signs FROM r1 UNION ALL SELECT k, 'y', 61, 0 FROM d UNION ALL SELECT k, 'z', 91, 0 FROM d)")
    out.append(f"grown AS (SELECT k, w.root, w.depth, sum(w.times * (28 + o.kept + 3 * o.signs + 2 * w.depth * (5 + o.signs) - CASE WHEN w.depth > 0 THEN 29 ELSE 0 END)) AS more FROM own o JOIN (VALUES {walks}) w(root, node, depth, times) USING (node) GROUP BY ALL)")
    out.append("so_far AS (SELECT k, root, depth, sum(more) OVER (PARTITION BY k, root ORDER BY depth) AS bytes FROM grown)")
    beyond = f"so_far.bytes > {BUDGET} AND (depth > 0 OR root = 'x' AND NOT r1.refused)"
    out.append(f"c AS (SELECT k, root AS name, coalesce(min(so_far.bytes) FILTER (WHERE {beyond}), max(so_far.bytes)) AS bytes, bool_or({beyond}) AS refused FROM so_far JOIN r1 USING (k) GROUP BY k, root)")
    rows = ["SELECT k, 'b' AS name, bk + bs AS bytes, false AS refused FROM d", *(f"SELECT k, 'l{n}', bytes, refused FROM r{n}" for n in range(LADDER + 1)), "SELECT * FROM c"]
    return f"WITH {', '.join(out)} SELECT k::VARCHAR AS site, md5(k || name)[1:16] AS key, bytes::BIGINT AS bytes, refused FROM ({' UNION ALL '.join(rows)})"


@query("expansion_sizes", _ladder_sql())
def expansion_sizes(spark, sf_dir):
    """What the expansion of every resource of a document's site would hold: its text as a file and a sheet, a ladder of sheets above, and a circle."""
    k = F.col("k").cast("string")
    key = lambda name: F.substring(F.md5(F.concat(k, F.lit(name)).cast("binary")), 1, 16)
    token = lambda name: store.placeholder(key(name))
    rows = _documents(spark, sf_dir, F.coalesce("text", F.lit("")).alias("text"))
    sheets_of = {"l0": F.concat("text", F.lit("."), token("b"))}
    for n in range(1, LADDER + 1):
        sheets_of[f"l{n}"] = F.array_join(F.array_repeat(token(f"l{n - 1}"), (F.col("k") % 3 + 1).cast("int")), ".")
    for name, text in CIRCLE.items():
        sheets_of[name] = F.array_join(F.array(*(token(x[1:-1]) if x[0] == "{" else F.lit(x) for x in text.split("."))), ".")
    one = lambda name, mime, text: F.struct(key(name).alias("key"), F.lit(mime).alias("mime"), F.lit(mime == "text/css").alias("is_text"), F.encode(text, "utf-8").alias("data"))
    made = rows.select(k.alias("site"), F.explode(F.array(one("b", "image/png", F.col("text")), *(one(n, "text/css", t) for n, t in sheets_of.items()))).alias("r"))
    return expansion.expansion_sizes(made.select("site", "r.*"), BUDGET)
