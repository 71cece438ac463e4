"""One payload and one HTML document for each site, from its rewritten pages and resources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import by_shuffle
from .rewrite import escape_attribute
from .store import KEY, token_pattern

#: A site whose pages and resources exceed so many bytes is not assembled into one row, but reported.
MOST_BYTES = 512 << 20
SHELL = ('<!doctype html>\n<html{lang}>\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n<meta name="generator" content="{generator}">\n<title>{title}</title>\n</head>\n<body>\n', "\n</body>\n</html>\n")
OPEN, CLOSE = '<script type="application/json" id="sitepack-payload">', "</script>"


def script_safe(text: Column) -> Column:
    """JSON text that can stand in a script element: signs that could end it are written as escapes."""
    for sign, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def json_string(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def page_entry() -> Column:
    """A page's key and value, from columns page, title and html."""
    return script_safe(F.concat(json_string(F.col("page")), F.lit(':{"title":'), json_string(F.coalesce("title", F.lit(""))), F.lit(',"html":'), json_string(F.col("html")), F.lit("}")))


def resource_entry() -> Column:
    """A resource's key and value, from columns key, mime, is_text and value: a string (data URL), or for texts an object {mime, text}."""
    text = F.concat(F.lit('{"mime":'), json_string(F.col("mime")), F.lit(',"text":'), json_string(F.col("value")), F.lit("}"))
    return script_safe(F.concat(json_string(F.col("key")), F.lit(":"), F.when(F.col("is_text"), text).otherwise(json_string(F.col("value")))))


def _entries(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    entry = F.concat(json_string(F.col(key)), F.lit(":"), value)
    each = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), entry.alias("e"))))
    return rows.groupBy("site").agg(F.concat(F.lit("{"), F.array_join(F.transform(each, lambda x: x["e"]), ","), F.lit("}")).alias(name), F.count("*").cast("long").alias(f"n_{name}"))


def payloads(sites: DataFrame, pages: DataFrame, resources: DataFrame, version: int = 1, generator: str = "sitepack") -> DataFrame:
    """``sites(site, entry)``, ``pages(site, page, title, html)`` and ``resources(site, key, mime, is_text, value)`` as (site, payload, n_pages, n_resources).

    Keys are sorted, so equal input gives equal bytes.  Binary resources are strings (data URLs), text ones objects {mime, text}.
    """
    page = F.concat(F.lit('{"title":'), json_string(F.coalesce("title", F.lit(""))), F.lit(',"html":'), json_string(F.col("html")), F.lit("}"))
    resource = F.when(F.col("is_text"), F.concat(F.lit('{"mime":'), json_string(F.col("mime")), F.lit(',"text":'), json_string(F.col("value")), F.lit("}"))).otherwise(json_string(F.col("value")))
    rows = sites.select("site", "entry").join(by_shuffle(_entries(pages, "page", page, "pages")), "site", "left").join(by_shuffle(_entries(resources, "key", resource, "resources")), "site", "left")
    body = F.concat(F.lit(f'{{"v":{version},"generator":'), json_string(F.lit(generator)), F.lit(',"entry":'), json_string(F.col("entry")), F.lit(',"pages":'), F.coalesce("pages", F.lit("{}")), F.lit(',"resources":'), F.coalesce("resources", F.lit("{}")), F.lit("}"))
    return rows.select("site", script_safe(body).alias("payload"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_resources", F.lit(0)).alias("n_resources"))


def oversize(pages: DataFrame, resources: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Sites too large to assemble, (site, bytes), found from lengths alone before any text is moved."""
    both = pages.select("site", F.octet_length("html").cast("long").alias("n")).union(resources.select("site", F.octet_length("value").cast("long").alias("n")))
    return both.groupBy("site").agg(F.sum("n").alias("bytes")).filter(F.col("bytes") > most)


def titles(sites: DataFrame, heads: DataFrame) -> DataFrame:
    """(site, title, lang): the entry page's title, else the site's name, else the entry's base name; the entry page's lang."""
    rows = sites.select("site", "entry").join(by_shuffle(heads.select("site", F.col("page").alias("entry"), F.col("title").alias("_t"), "lang")), ["site", "entry"], "left")
    some = lambda c: F.when(F.trim(c) != "", c)
    return rows.select("site", F.coalesce(some(F.col("_t")), some(F.col("site")), F.regexp_extract("entry", r"([^/]*)$", 1)).alias("title"), F.coalesce("lang", F.lit("")).alias("lang"))


def documents(payload: DataFrame, named: DataFrame, generator: str = "sitepack") -> DataFrame:
    """(site, html): the bundle document of each payload, with escaped title, lang (left out if empty) and generator."""
    rows = payload.join(by_shuffle(named), "site", "left")
    lang = F.when(F.col("lang") != "", F.concat(F.lit(' lang="'), escape_attribute(F.col("lang")), F.lit('"'))).otherwise("")
    before, after = SHELL
    a, rest = before.split("{lang}")
    b, rest = rest.split("{generator}")
    c, d = rest.split("{title}")
    return rows.select("site", F.concat(F.lit(a), lang, F.lit(b), escape_attribute(F.lit(generator)), F.lit(c), escape_attribute(F.coalesce("title", F.lit(""))), F.lit(d + OPEN), F.col("payload"), F.lit(CLOSE + after)).alias("html"))


def read_back(bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages (site, page, title, html) and resources (site, key, mime, is_text, value) of bundle documents ``(site, html)``."""
    text = F.regexp_extract("html", rf"(?s){OPEN}(.*?){CLOSE}", 1)
    rows = bundles.select("site", F.from_json(text, "pages map<string,struct<title:string,html:string>>, resources map<string,string>").alias("p"))
    pages = rows.select("site", F.explode("p.pages").alias("page", "v")).select("site", "page", "v.title", "v.html")
    each = rows.select("site", F.explode("p.resources").alias("key", "raw")).withColumn("o", F.when(F.col("raw").startswith("{"), F.from_json("raw", "mime string, text string")))
    mime = F.coalesce("o.mime", F.regexp_extract("raw", r"^data:([^;,]*)", 1))
    return pages, each.select("site", "key", mime.alias("mime"), F.col("o").isNotNull().alias("is_text"), F.coalesce("o.text", "raw").alias("value"))


def integrity(pages: DataFrame, resources: DataFrame, key: int = KEY) -> DataFrame:
    """What is dangling: (site, page, kind, name) of placeholders without a resource and routes without a page."""
    tokens = pages.select("site", "page", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(token_pattern(least=key)), 1))).alias("name"))
    inner = resources.filter("is_text").select("site", F.col("key").alias("page"), F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(token_pattern(least=key)), 1))).alias("name"))
    lost = tokens.unionByName(inner).join(by_shuffle(resources.select("site", F.col("key").alias("name"))), ["site", "name"], "left_anti").select("site", "page", F.lit("resource").alias("kind"), "name")
    from ..functions.paths import parse_route

    routes = pages.select("site", "page", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="(#/[^"]*)"'), 1))).alias("r"))
    named = routes.select("site", "page", parse_route(F.replace("r", F.lit("&amp;"), F.lit("&")))["path"].alias("name"))
    astray = named.join(by_shuffle(pages.select("site", F.col("page").alias("name"))), ["site", "name"], "left_anti").select("site", "page", F.lit("page").alias("kind"), "name")
    return reduce(DataFrame.unionByName, (lost, astray))
