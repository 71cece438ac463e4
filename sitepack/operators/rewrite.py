"""Rewriting documents: changes are rows (site, page, seq, attr, op, value), applied to a page's segment array in place.

Only the changed pieces differ from the captured text; nothing is parsed into a tree or written out again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import bind, decode_percent, parse_route, route
from .extract import _ATTRS, format_srcset, refresh, segments, srcset
from .graph import by_shuffle, saved
from .spread import dealt_join
from .store import placeholder

#: Attributes that mark rewritten links and pages; a caller may choose others.
ROUTED, PAGE = "data-sitepack-route", "data-sitepack-page"
OPS = ("set", "drop", "remove", "whole", "body", "after", "before")


def escape_attribute(text: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")), text)


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), escape_attribute(value), F.lit('"'))


#: Pieces of what stands between a start tag's name and its end: an attribute with the space before it, or any other sign.
_PIECE = r"""\s*+[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']++))?+|[\s\S]"""


def change_segment(segment: Column, op: Column, attr: Column, value: Column) -> Column:
    """One change of one piece.  A start tag's attributes are cut by one fixed pattern without backtracking, however long they are."""
    start = F.regexp_extract(segment, r"(?i)^(<[a-z][^\s/>]*+)", 1)
    inner = F.regexp_extract(segment, rf"(?i)^<[a-z][^\s/>]*+({_ATTRS})>", 1)
    rest = F.substring(segment, F.length(start) + F.length(inner) + 1, F.lit(1 << 30))

    def with_attribute(pieces: Column) -> Column:
        at = F.array_position(F.transform(pieces, lambda p: F.lower(F.regexp_extract(p, r"""^\s*+([^\s"'<>/=]++)""", 1))), F.lower(attr))
        put = F.concat(attr, F.lit("="), _quoted(value))
        space = lambda p: F.regexp_extract(p, r"^(\s*+)", 1)
        new = F.array_join(F.transform(pieces, lambda p, i: F.when(i + 1 != at, p).when(op == "drop", space(p)).otherwise(F.concat(space(p), put))), "")
        return F.when((at == 0) & (op == "set"), F.concat(F.lit(" "), put, inner)).otherwise(new)

    head = F.regexp_extract(segment, rf"(?i)^(<[a-z]{_ATTRS}>)", 1)
    tail = F.regexp_extract(segment, r"(?i)(</[a-z]+\s*>)$", 1)
    changed = F.concat(start, bind(F.regexp_extract_all(inner, F.lit(_PIECE), 0), with_attribute), rest)
    return (F.when(op.isin("set", "drop"), changed).when(op == "remove", F.lit("")).when(op == "whole", value)
            .when(op == "body", F.concat(head, value, tail)).when(op == "after", F.concat(segment, value)).when(op == "before", F.concat(value, segment)).otherwise(segment))


def apply_changes(pages: DataFrame, changes: DataFrame, text: str = "text") -> DataFrame:
    """``pages(site, page, text, …)`` with all ``changes(site, page, seq, attr, op, value)`` applied; sets come before inserts and removals.

    A page's changes are grouped into one map, so its text moves once.  Pages without changes stay as they are.
    """
    rank = reduce(lambda c, o: c.when(F.col("op") == o, OPS.index(o)), OPS[1:], F.when(F.col("op") == OPS[0], 0))
    each = changes.groupBy("site", "page", "seq").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.coalesce("attr", F.lit("")).alias("attr"), "op", F.coalesce("value", F.lit("")).alias("value")))).alias("list"))
    maps = each.groupBy("site", "page").agg(F.map_from_entries(F.collect_list(F.struct(F.col("seq").cast("int").alias("seq"), "list"))).alias("_changes"))
    rows = pages.join(by_shuffle(maps), ["site", "page"], "left")
    of = lambda i: F.try_element_at(F.col("_changes"), i)
    changed = F.transform(segments(F.col(text)), lambda s, i: F.aggregate(F.coalesce(of(i), F.array().cast("array<struct<rank:int,attr:string,op:string,value:string>>")), s, lambda acc, c: change_segment(acc, c["op"], c["attr"], c["value"])))
    return rows.withColumn(text, F.when(F.col("_changes").isNull(), F.col(text)).otherwise(F.array_join(changed, ""))).drop("_changes")


def _change(rows: DataFrame, op: str, attr: Column | str, value: Column | str | None = None) -> DataFrame:
    attr = F.lit(attr) if isinstance(attr, str) else attr
    value = F.lit(value).cast("string") if value is None or isinstance(value, str) else value
    return rows.select("site", "page", "seq", attr.alias("attr"), F.lit(op).alias("op"), value.alias("value"))


def link_changes(refs: DataFrame, tag_rows: DataFrame, resources: DataFrame, single_page: DataFrame | None = None) -> DataFrame:
    """Changes of links: routes for fragments and pages, placeholders and a download name for files; target=_self goes."""
    links = refs.filter(F.col("role").isin("link", "page"))
    own = _change(links.filter("kind = 'fragment' and role = 'link'"), "set", F.col("attr"), route(F.col("page"), F.lit(""), F.col("fragment")))
    to_page = links.filter("kind = 'file' and is_html")
    if single_page is not None:
        to_page = dealt_join(to_page, single_page.select("site"), ["site"], "left_anti")
    pages = _change(to_page, "set", F.col("attr"), route(F.col("rel"), F.col("query"), F.col("fragment")))
    marks = _change(to_page.filter("role = 'link'").select("site", "page", "seq").union(links.filter("kind = 'fragment' and role = 'link'").select("site", "page", "seq")), "set", ROUTED, "route")
    files = links.filter("kind = 'file' and not is_html and role = 'link'").join(by_shuffle(resources.filter("not is_text").select("site", "rel", "key")), ["site", "rel"])
    tokens = _change(files, "set", F.col("attr"), placeholder(F.col("key"), F.col("fragment")))
    a = tag_rows.select("site", "page", "seq", F.coalesce(F.col("attrs")["download"], F.lit("")).alias("download"), F.lower(F.trim(F.col("attrs")["target"])).alias("target"))
    named = _change(files.join(by_shuffle(a.filter("download = ''")), ["site", "page", "seq"]), "set", "download", F.regexp_extract("rel", r"([^/]*)$", 1))
    top = links.filter(((F.col("kind") == "external") | (F.col("kind") == "fragment") | (F.col("is_html") & (F.col("kind") == "file"))) & (F.col("role") == "link"))
    targets = _change(top.join(by_shuffle(a.filter("target = '_self'")), ["site", "page", "seq"], "left_semi"), "drop", "target")
    return reduce(DataFrame.unionByName, (own, pages, marks, tokens, named, targets))


def resource_changes(refs: DataFrame, resources: DataFrame, tag_rows: DataFrame) -> DataFrame:
    """Changes of resource attributes: placeholders for embedded files, whole srcsets regrouped, integrity and crossorigin dropped.

    ``resources(site, rel, is_text, key)`` maps embedded files to keys: style and script roles use text ones, others binary ones.
    """
    wanted = refs.filter((F.col("kind") == "file") & F.col("role").isin("resource", "style", "script") | ((F.col("role") == "frame") & (F.col("kind") == "file") & ~F.col("is_html")))
    keyed = wanted.withColumn("is_text", F.col("role").isin("style", "script")).join(by_shuffle(resources.select("site", "rel", "is_text", "key")), ["site", "rel", "is_text"])
    token = placeholder(F.col("key"), F.col("fragment"))
    single = keyed.filter(~F.col("attr").isin("srcset", "imagesrcset"))
    plain = _change(single, "set", F.col("attr"), token)
    loose = single.filter((F.col("tag").isin("link", "script")) & F.col("attr").isin("href", "src") & (F.col("role") != "resource") | ((F.col("tag") == "link") & (F.col("role") == "resource")))
    many = keyed.filter(F.col("attr").isin("srcset", "imagesrcset")).groupBy("site", "page", "seq", "attr").agg(F.map_from_entries(F.collect_set(F.struct("raw", token.alias("token")))).alias("tokens"))
    values = tag_rows.select("site", "page", "seq", "attrs").join(by_shuffle(many), ["site", "page", "seq"])
    new = F.transform(srcset(F.try_element_at("attrs", "attr")), lambda c: F.struct(F.coalesce(F.try_element_at(F.col("tokens"), c["url"]), c["url"]).alias("url"), c["desc"].alias("desc")))
    return reduce(DataFrame.unionByName, (plain, _change(values, "set", F.col("attr"), format_srcset(new)), _change(loose, "drop", "integrity"), _change(loose, "drop", "crossorigin")))


def removal_changes(tag_rows: DataFrame) -> DataFrame:
    """Removal of charset, content-type and CSP metas, base elements, prefetch and manifest links, and a manifest attribute."""
    a, tag = F.col("attrs"), F.col("tag")
    equiv = F.lower(F.trim(a["http-equiv"]))
    rels = F.split(F.lower(F.coalesce(a["rel"], F.lit(""))), r"\s+")
    from .extract import link_role

    gone = (tag == "base") | ((tag == "meta") & (a["charset"].isNotNull() | F.coalesce(equiv.isin("content-type", "content-security-policy"), F.lit(False)))) | ((tag == "link") & (link_role(a) == "remove") & (F.size(rels) > 0) & (a["href"] != ""))
    return _change(tag_rows.filter(gone), "remove", "").unionByName(_change(tag_rows.filter((tag == "html") & a["manifest"].isNotNull()), "drop", "manifest"))


def head_changes(tag_rows: DataFrame, heads: DataFrame, shim: str = "") -> DataFrame:
    """Insert charset, base target and an optional script after the head start tag (or html's, or at the start), and mark the page."""
    rank = F.when(F.col("tag") == "head", 0).when(F.col("tag") == "html", 1)
    place = tag_rows.groupBy("site", "page").agg(F.min(F.struct(F.coalesce(rank, F.lit(2)).alias("rank"), "seq")).alias("at"))
    target = F.when(F.coalesce(F.lower(F.trim("base_target")), F.lit("")).isin("", "_self"), "_top").otherwise(F.col("base_target"))
    rows = place.join(by_shuffle(heads.select("site", "page", "base_target")), ["site", "page"], "left")
    value = F.concat(F.lit('<meta charset="utf-8"><base target='), _quoted(target), F.lit(">"), F.lit(f"<script>{shim}</script>" if shim else ""))
    op = F.when(F.col("at.rank") < 2, "after").otherwise("before")
    insert = rows.select("site", "page", F.col("at.seq").alias("seq"), F.lit("").alias("attr"), op.alias("op"), value.alias("value"))
    return insert.unionByName(_change(tag_rows.filter("tag = 'html'"), "set", PAGE, F.col("page")))


def refreshed(refs: DataFrame, single_page: DataFrame | None = None) -> DataFrame:
    """The refreshes that become scripts: those to a page, unless the site is a single page, or to an external address."""
    rows = refs.filter((F.col("role") == "refresh") & ((F.col("kind") == "external") | ((F.col("kind") == "file") & F.col("is_html"))))
    if single_page is not None:
        rows = dealt_join(rows, single_page.select("site", F.lit(True).alias("_one")), ["site"], "left").filter((F.col("kind") == "external") | F.col("_one").isNull()).drop("_one")
    return rows


def refresh_changes(refs: DataFrame, tag_rows: DataFrame, single_page: DataFrame | None = None) -> DataFrame:
    """A meta refresh to a page or an external address becomes a script that waits as long (whole milliseconds)."""
    rows = refreshed(refs, single_page)
    rows = rows.join(by_shuffle(tag_rows.select("site", "page", "seq", "attrs")), ["site", "page", "seq"])
    inner = F.when(F.col("kind") == "external", F.concat(F.lit("top.location.href="), js_string(F.trim("raw")))).otherwise(F.concat(F.lit("top.location.hash="), js_string(route(F.col("rel"), F.col("query"), F.col("fragment")))))
    wait = (refresh(F.col("attrs")["content"])["seconds"] * 1000).cast("long").cast("string")
    return _change(rows, "whole", "", F.concat(F.lit("<script>setTimeout(function(){"), inner, F.lit("},"), wait, F.lit(");</script>")))


def js_string(text: Column) -> Column:
    """A JavaScript string literal that is safe within a script element."""
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    for sign, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
        quoted = F.replace(quoted, F.lit(sign), F.lit(code))
    return quoted


def embed_frames(pages: DataFrame, embedded: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Root pages (site, page, text) with frames' src replaced by a srcdoc of the rewritten page that they embed, deepest first.

    ``embedded`` is the closure of frame edges from the roots; ``pages`` have captured texts, as places of frames count their pieces, and
    ``changes`` are applied to each embedded page together with what its own frames become.
    """
    key = F.concat_ws("/", F.col("root"), F.array_join(F.transform("seqs", lambda x: x.cast("string")), ","))
    rows = saved(embedded.select("site", "root", F.col("page").alias("_page"), "seqs", "depth", key.alias("page")).join(by_shuffle(pages.select("site", F.col("page").alias("_page"), "text")), ["site", "_page"]))
    top, done = rows.agg(F.max("depth")).head()[0], None
    for depth in range(top or 0, -1, -1):
        level, all_changes = rows.filter(F.col("depth") == depth), []
        if changes is not None:
            all_changes.append(changes.withColumnRenamed("page", "_page").join(by_shuffle(level.select("site", "_page", "page")), ["site", "_page"]).select(*changes.columns))
        if done is not None:
            child = done.select("site", "root", F.slice("seqs", 1, F.size("seqs") - 1).alias("seqs"), F.element_at("seqs", -1).cast("int").alias("seq"), F.col("text").alias("html")).withColumn("page", key)
            all_changes += [_change(child, "set", "srcdoc", F.col("html")), _change(child, "drop", "src", "")]
        done = saved(apply_changes(level, reduce(DataFrame.unionByName, all_changes)) if all_changes else level)
    return done.select("site", F.col("_page").alias("page"), "text")


def sprite_changes(refs: DataFrame, sprites: DataFrame, tag_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inline each SVG sprite once a page, hidden, at the start of its body, and point use elements at the local copy.

    ``sprites(site, rel, text)`` are the sprites' (already rewritten) texts.  Returns the changes and the refused references with a code.
    """
    uses = refs.filter("role = 'sprite' and kind = 'file'")
    svg = F.regexp_extract("text", r"(?is)(<svg(?=[\s/>]).*</svg\s*>)", 1)
    hidden = F.regexp_replace(F.regexp_replace(svg, r"(?is)^<svg", '<svg aria-hidden="true" style="position:absolute;width:0;height:0;overflow:hidden"'), r"$^", "")
    found = uses.join(by_shuffle(sprites.select("site", "rel", svg.alias("svg"), hidden.alias("hidden"))), ["site", "rel"], "left")
    code = F.when(F.col("fragment") == "", "sprite_without_fragment").when(F.coalesce("svg", F.lit("")) == "", "sprite_not_svg")
    fine, bad = found.filter(code.isNull()), found.filter(code.isNotNull()).withColumn("code", code)
    point = _change(fine, "set", F.col("attr"), F.concat(F.lit("#"), F.col("fragment")))
    body = tag_rows.filter("tag = 'body'").groupBy("site", "page").agg(F.min("seq").alias("body_seq"))
    once = fine.groupBy("site", "page", "rel").agg(F.min("seq").alias("seq"), F.min("hidden").alias("hidden"))
    each = once.groupBy("site", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "rel", "hidden"))), lambda x: x["hidden"]), "").alias("value"))
    put = each.join(by_shuffle(body), ["site", "page"], "left").select("site", "page", F.coalesce("body_seq", F.lit(0)).alias("seq"), F.lit("").alias("attr"), F.when(F.col("body_seq").isNull(), "before").otherwise("after").alias("op"), "value")
    return point.unionByName(put), bad


def look_up_links(links: DataFrame, pages: DataFrame, address: str = "address") -> DataFrame:
    """Resolve a table of routes against packed pages: their page, or the index of a directory of that name; null if neither."""
    rows = links.withColumn("_r", parse_route(F.col(address)))
    path = F.coalesce(F.col("_r")["path"], decode_percent(F.col(address)))
    index = F.when(F.regexp_replace(path, "/+$", "") == "", "index.html").otherwise(F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/index.html")))
    rows = rows.withColumn("_path", path).withColumn("_index", index)
    one = pages.select("site", F.col("page").alias("_path"), F.col("page").alias("_exact"))
    two = pages.select("site", F.col("page").alias("_index"), F.col("page").alias("_dir"))
    return rows.join(by_shuffle(one), ["site", "_path"], "left").join(by_shuffle(two), ["site", "_index"], "left").select(*links.columns, F.coalesce("_exact", "_dir").alias("page"))
