"""References of HTML documents: a lossless segment array for each page, exploded to tags, attributes and references.

``segments`` cuts a document into consecutive pieces (comments, raw-text elements, tags, text), so that the
index of a piece orders references and rewriting is a ``transform`` over the array.  All of it is Column expressions;
no element's pattern backtracks over its attributes.
"""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import by_shuffle

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_RAW = "script|style|title|textarea|xmp|iframe|noembed|noframes"
SEGMENT = rf"""(?is)<!--.*?(?:-->|\z)|<({_RAW})(?=[\s/>]){_ATTRS}>.*?(?:</\1\s*+>|\z)|</?[a-z]{_ATTRS}>|<[!?/][^>]*+>|[^<]++|<"""
_ATTR = r"""(?s)([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?"""

# Which attributes of which elements name a resource to embed.
RESOURCES = {"img": ("src", "srcset"), "source": ("src", "srcset"), "video": ("src", "poster"), "audio": ("src",), "track": ("src",), "embed": ("src",), "object": ("data",), "body": ("background",), "table": ("background",), "thead": ("background",), "tbody": ("background",), "tfoot": ("background",), "tr": ("background",), "td": ("background",), "th": ("background",), "image": ("href", "xlink:href"), "feimage": ("href", "xlink:href")}
# Link relations of icons and of pages.
ICONS = ("icon", "shortcut", "apple-touch-icon", "apple-touch-icon-precomposed", "mask-icon")
PAGE_LINKS = ("next", "prev", "alternate", "canonical", "help", "license", "author", "search")
# Script types that are JavaScript, besides an absent type and "module".
JAVASCRIPT = ("application/ecmascript", "application/javascript", "application/x-ecmascript", "application/x-javascript", "text/ecmascript", "text/javascript", "text/javascript1.0", "text/javascript1.1", "text/javascript1.2", "text/javascript1.3", "text/javascript1.4", "text/javascript1.5", "text/jscript", "text/livescript", "text/x-ecmascript", "text/x-javascript")


def segments(text: Column) -> Column:
    """Consecutive pieces of a document; joined they are the document again.  A null document has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(SEGMENT), 0), F.array().cast("array<string>"))


@F.pandas_udf(T.StringType())
def _unescape_all(text: pd.Series) -> pd.Series:
    return text.map(lambda x: html.unescape(x) if x is not None else None)


def unescape(text: Column, full: bool = False) -> Column:
    """Resolve character references: those of the five XML signs in the JVM, or with ``full`` all of HTML's by an Arrow helper."""
    if full:
        return _unescape_all(text)
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#34;", '"'), ("&#38;", "&"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def attributes(tag: Column) -> Column:
    """Attributes of a start tag as a map of lower-case names; the first of a name counts, and valueless ones are empty."""
    inner = F.regexp_replace(F.regexp_extract(tag, rf"(?is)^<[a-z][^\s/>]*({_ATTRS})>", 1), r"/\s*$", "")
    names = F.transform(F.regexp_extract_all(inner, F.lit(_ATTR), 1), lambda n: F.lower(n))
    values = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), (F.regexp_extract_all(inner, F.lit(_ATTR), k) for k in (2, 3, 4)))
    pairs = F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), v.alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p, k: F.array_position(names, p["name"]) == k + 1))


def tags(pages: DataFrame, text: str = "text", full_entities: bool = False) -> DataFrame:
    """One row for each start tag, in document order: ``pages``' other columns, seq, tag, attrs and body (of raw-text elements).

    Comments and the content of raw-text elements give no tags; template and noscript content does.
    """
    keys = [c for c in pages.columns if c != text]
    rows = pages.select(*keys, F.posexplode(segments(F.col(text))).alias("seq", "segment")).filter(F.col("segment").rlike("^<[A-Za-z]"))
    name = F.lower(F.regexp_extract("segment", r"^<([A-Za-z][^\s/>]*)", 1))
    body = F.when(name.isin(*_RAW.split("|")), F.regexp_extract("segment", rf"(?is)^<[a-z]{_ATTRS}>(.*?)(?:</[a-z]+\s*>)?$", 1))
    rows = rows.select(*keys, "seq", name.alias("tag"), attributes(F.col("segment")).alias("attrs"), body.alias("body"))
    return rows.withColumn("attrs", F.transform_values("attrs", lambda _, v: F.when(v.contains("&"), unescape(v)).otherwise(v)) if not full_entities else F.col("attrs"))


def srcset(text: Column) -> Column:
    """Candidates of a srcset as array<struct<url, desc>>; commas part candidates only at the end of a URL or after a descriptor."""
    item = r"[\s,]*([^\s,]\S*[^\s,]|[^\s,])(?:(?<!,),*(?=\s|$))?(?:(?<=,)|\s+((?:\([^)]*\)|[^,(])*))?,?"
    whole = F.regexp_extract_all(text, F.lit(r"(?s)" + item), 0)
    one = lambda x, k: F.regexp_extract(x, r"(?s)^[\s,]*(\S*?)(,*)(?:\s+((?:\([^)]*\)|[^,(])*?)\s*)?,?$", k)
    return F.filter(F.transform(whole, lambda x: F.struct(one(x, 1).alias("url"), F.trim(one(x, 3)).alias("desc"))), lambda c: c["url"] != "")


def format_srcset(candidates: Column) -> Column:
    return F.array_join(F.transform(candidates, lambda c: F.concat(c["url"], F.when(c["desc"] != "", F.concat(F.lit(" "), c["desc"])).otherwise(""))), ", ")


def refresh(content: Column) -> Column:
    """A meta refresh's struct(seconds, url); null where it has no target."""
    seconds = F.regexp_extract(content, r"^\s*([0-9]+(?:\.[0-9]+)?)[\s;,]", 1)
    rest = F.regexp_replace(content, r"^[\s0-9.]+[\s;,]+", "")
    url = F.regexp_extract(F.regexp_replace(rest, r"(?i)^url\s*=\s*", ""), r"""^["']?\s*([^"'\s]*)""", 1)
    return F.when((seconds != "") & (url != ""), F.struct(seconds.cast("double").alias("seconds"), url.alias("url")))


def is_javascript(kind: Column) -> Column:
    essence = F.trim(F.lower(F.element_at(F.split(F.coalesce(kind, F.lit("")), ";"), 1)))
    return (essence == "") | (essence == "module") | essence.isin(*JAVASCRIPT)


def has_module_imports(source: Column) -> Column:
    """A heuristic for import and export-from statements and dynamic imports in module source."""
    return F.coalesce(source.rlike(r"""(?m)(?:^\s*|[;{}]\s*)(?:import\b\s*+[\w$"'{*]|export\s[^;]*?\sfrom\s*["'])|\bimport\s*\("""), F.lit(False))


def link_role(attrs: Column) -> Column:
    """What a link element is, by its rel, as and type: style, icon, script, preload, remove, page, or null for others."""
    rels = F.split(F.trim(F.lower(F.coalesce(attrs["rel"], F.lit("")))), r"\s+")
    has = lambda *names: reduce(lambda a, b: a | b, (F.array_contains(rels, n) for n in names))
    kind = F.lower(F.trim(F.coalesce(attrs["as"], F.lit(""))))
    css = F.trim(F.lower(F.coalesce(attrs["type"], F.lit("")))).isin("", "text/css")
    return (F.when(has("stylesheet") | (has("preload") & (kind == "style")), F.when(css, "style").otherwise("other_style")).when(has(*ICONS), "icon")
            .when(has("modulepreload") | (has("preload") & (kind == "script")), "script").when(has("preload"), "preload")
            .when(has("prefetch", "prerender", "manifest"), "remove").when(has(*PAGE_LINKS), "page"))


def references(tag_rows: DataFrame) -> DataFrame:
    """Every reference of ``tags`` rows: their keys, seq, part, tag, attr, role and raw.

    Roles: link, page (rel links), resource, style, script, frame, form, refresh, sprite (svg use), style_text and style_attr (CSS to
    scan), other_style, other_script and remove (left or dropped with a note).  ``part`` orders those of one tag.  Empty values give none.
    """
    keys = [c for c in tag_rows.columns if c not in ("seq", "tag", "attrs", "body")]
    a, tag = F.col("attrs"), F.col("tag")

    def ref(when: Column, attr: str | Column, role: str | Column, raw: Column | None = None) -> Column:
        attr = F.lit(attr) if isinstance(attr, str) else attr
        role = F.lit(role) if isinstance(role, str) else role
        raw = a[attr] if raw is None else raw
        return F.when(when & (raw != "") & role.isNotNull(), F.struct(attr.alias("attr"), role.alias("role"), raw.alias("raw")))

    href = F.when(a["href"].isNotNull(), F.lit("href")).otherwise(F.lit("xlink:href"))
    found = [ref(a["style"] != "", "style", "style_attr"), ref(tag.isin("a", "area"), href, "link")]
    rel = link_role(a)
    found.append(ref(tag == "link", "href", F.when(rel.isin("icon", "preload"), "resource").otherwise(rel)))
    found.append(ref((tag == "script") & (a["src"] != ""), "src", F.when(is_javascript(a["type"]), "script").otherwise("other_script")))
    by_attr: dict[str, list[str]] = {}
    for element, names in RESOURCES.items():
        for name in names:
            by_attr.setdefault(name, []).append(element)
    for name, elements in by_attr.items():
        if name == "srcset":
            continue
        only = a["href"].isNull() if name == "xlink:href" else F.lit(True)
        found.append(ref(tag.isin(*elements) & only, name, "resource"))
    found.append(ref((tag == "input") & (F.lower(a["type"]) == "image"), "src", "resource"))
    found += [ref(tag == "form", "action", "form"), ref(tag.isin("input", "button"), "formaction", "form")]
    found.append(ref(tag.isin("iframe", "frame") & a["srcdoc"].isNull(), "src", "frame"))
    found.append(ref((tag == "meta") & (F.lower(F.trim(a["http-equiv"])) == "refresh"), "content", "refresh", refresh(a["content"])["url"]))
    found.append(ref(tag == "use", href, "sprite"))
    found.append(ref(tag == "style", "", "style_text", F.col("body")))
    several = F.when(tag.isin("img", "source"), a["srcset"]).when((tag == "link") & F.lower(a["rel"]).contains("preload") & (F.lower(F.trim(a["as"])) == "image"), a["imagesrcset"])
    set_name = F.when(tag == "link", "imagesrcset").otherwise("srcset")
    more = F.transform(F.coalesce(srcset(several), F.array().cast("array<struct<url:string,desc:string>>")), lambda c: F.struct(set_name.alias("attr"), F.lit("resource").alias("role"), c["url"].alias("raw")))
    every = F.concat(F.array_compact(F.array(*found)), more)
    return tag_rows.select(*keys, "seq", "tag", F.posexplode(every).alias("part", "ref")).select(*keys, "seq", "part", "tag", "ref.attr", "ref.role", "ref.raw")


def page_heads(tag_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each page: title, lang, and the first base href and target (null where there is none)."""
    first = lambda when, value: F.min_by(F.when(when, value), F.when(when & value.isNotNull(), F.col("seq")))
    a, tag = F.col("attrs"), F.col("tag")
    title = F.trim(F.regexp_replace(unescape(F.col("body")), r"\s+", " "))
    return tag_rows.filter(tag.isin("title", "html", "base")).groupBy(*keys).agg(
        F.coalesce(first(tag == "title", title), F.lit("")).alias("title"), first(tag == "html", a["lang"]).alias("lang"), first(tag == "base", a["href"]).alias("base_href"), first(tag == "base", a["target"]).alias("base_target"))


def with_base(refs: DataFrame, heads: DataFrame, keys: list[str], page: str) -> DataFrame:
    """``refs`` with the effective ``base`` of their page and whether it is external."""
    from ..functions.paths import base_of

    found = heads.filter("base_href is not null").select(*keys, base_of(F.col(page), F.col("base_href")).alias("_b"))
    return refs.join(by_shuffle(found), keys, "left").withColumn("base", F.coalesce(F.col("_b")["base"], F.col(page))).withColumn("base_external", F.coalesce(F.col("_b")["kind"] == "external", F.lit(False))).drop("_b")


def base_problems(heads: DataFrame, keys: list[str], page: str) -> DataFrame:
    """Base elements that are external, lead out of the site or cannot be parsed: the keys, ref and code."""
    from ..functions.paths import base_of

    kinds = heads.filter("base_href is not null").select(*keys, F.col("base_href").alias("ref"), base_of(F.col(page), F.col("base_href"))["kind"].alias("_k"))
    return kinds.filter(F.col("_k") != "file").select(*keys, "ref", F.concat(F.lit("base_"), "_k").alias("code"))


def first_referrers(refs: DataFrame, target: list[str], order: list[str]) -> DataFrame:
    """The first reference to each target in the given order (it decides a script's or sheet's fallback charset)."""
    at = Window.partitionBy(*target).orderBy(*order)
    return refs.withColumn("_n", F.row_number().over(at)).filter("_n = 1").drop("_n")


def module_imports(tag_rows: DataFrame, refs: DataFrame, scripts: DataFrame) -> DataFrame:
    """Module scripts that import others, as (site, page, seq, ref, code): inline ones by their body, others by ``scripts(site, rel, text)``."""
    modules = tag_rows.filter((F.col("tag") == "script") & (F.lower(F.trim(F.col("attrs")["type"])) == "module"))
    inline = modules.filter((F.coalesce(F.col("attrs")["src"], F.lit("")) == "") & has_module_imports(F.col("body"))).select("site", "page", "seq", F.lit("").alias("ref"))
    outer = refs.filter("role = 'script' and kind = 'file'").join(by_shuffle(modules.select("site", "page", "seq")), ["site", "page", "seq"], "left_semi")
    found = outer.join(by_shuffle(scripts.filter(has_module_imports(F.col("text"))).select("site", "rel")), ["site", "rel"], "left_semi").select("site", "page", "seq", F.col("raw").alias("ref"))
    return inline.unionByName(found).withColumn("code", F.lit("module_import"))
