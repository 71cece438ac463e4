"""URL references and site-relative paths as Column expressions: splitting, joining, routes, globs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HOST = r"(?:[A-Za-z0-9\-._~!$&'()*+,;=:<>\"]|[^\x00-\x7f]|%[89A-Fa-f][0-9A-Fa-f])*"
_AUTHORITY = rf"^(?:[A-Za-z0-9\-._~!$&'()*+,;=:%@]*@)?(?:\[[^\]]*\]|{_HOST}?)(?::[0-9]*)?$"
_BAD_PORT = r":[^:\]@]*[^0-9:\]@][^:\]@]*$"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"


def strip_url(raw: Column) -> Column:
    """Drop control characters and spaces at both ends, and tabs and line ends anywhere."""
    return F.regexp_replace(F.regexp_replace(raw, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def split_reference(raw: Column) -> Column:
    """A reference as struct(kind, path, query, fragment).

    kind is empty, fragment, invalid or external where the text alone decides, else null; then path is
    percent-decoded (query and fragment are not).  A null reference is empty.
    """

    def pieces(s: Column) -> Column:
        scheme = F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
        after = F.regexp_replace(F.regexp_extract(s, r"(?s)^([^#]*)", 1), r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
        return F.struct(s.alias("s"), scheme.alias("scheme"), F.regexp_extract(after, r"(?s)^([^?]*)", 1).alias("bare"), F.regexp_extract(after, r"(?s)^[^?]*\?(.*)$", 1).alias("query"), F.regexp_extract(s, r"(?s)^[^#]*#(.*)$", 1).alias("fragment"))

    def judge(p: Column) -> Column:
        bare, no_scheme = p["bare"], p["scheme"] == ""
        has_authority = bare.startswith("//") & (~no_scheme | ~bare.startswith("///"))
        authority = F.regexp_extract(bare, r"(?s)^//([^/]*)", 1)
        local = F.when(has_authority, F.regexp_extract(bare, r"(?s)^//[^/]*(.*)$", 1)).otherwise(bare)
        rooted = bare.startswith("/")
        invalid = p["s"].rlike(r"[\x00-\x1f\x7f]") | p["fragment"].rlike(_BAD_ESCAPE) | (no_scheme & ~rooted & bare.rlike("^[^/]*:")) | ((no_scheme | rooted) & local.rlike(_BAD_ESCAPE)) | (has_authority & (~authority.rlike(_AUTHORITY) | authority.rlike(_BAD_PORT)))
        kind = F.when(p["s"] == "", "empty").when(p["s"].startswith("#"), "fragment").when(invalid, "invalid").when(~no_scheme | p["s"].startswith("//"), "external")
        return F.struct(kind.alias("kind"), bare.alias("bare"), p["query"].alias("query"), p["fragment"].alias("fragment"))

    def result(j: Column) -> Column:
        plain = j["kind"].isNull()
        return F.struct(j["kind"].alias("kind"), F.when(plain, decode_percent(j["bare"])).alias("path"), F.when(plain, j["query"]).otherwise("").alias("query"), F.when(plain | (j["kind"] == "fragment"), j["fragment"]).otherwise("").alias("fragment"))

    return bind(bind(bind(strip_url(F.coalesce(raw, F.lit(""))), pieces), judge), result)


def decode_percent(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def clean(path: Column) -> Column:
    """Resolve "." and ".." segments of a relative path; what climbs above its start keeps leading ".." segments."""
    empty = F.array().cast("array<string>")
    step = lambda acc, s: F.when(s.isin("", "."), acc).when((s == "..") & (F.size(acc) > 0), F.when(F.try_element_at(acc, F.lit(-1)) != "..", F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def directory(path: Column) -> Column:
    """The directory part of a path: of "docs/" it is "docs", of "a.html" it is empty."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def join_path(base: Column, path: Column) -> Column:
    """``path`` seen from the document ``base``, cleaned; an empty path is the base itself, a leading slash the site's root."""
    joined = lambda p: F.when(p == "", base).when(p.startswith("/"), F.substring(p, 2, 1 << 30)).otherwise(F.concat(directory(base), F.lit("/"), p))
    return clean(bind(F.translate(path, "\\", "/"), joined))


def climbs_out(rel: Column) -> Column:
    return (rel == "..") | rel.startswith("../")


def base_of(page: Column, href: Column) -> Column:
    """Effective base of a page with a base element: struct(base, kind), kind being file, external, outside or invalid."""

    def settle(ref: Column) -> Column:
        path = ref["path"]
        own = F.coalesce(ref["kind"].isin("empty", "fragment"), F.lit(False)) | (F.coalesce(path, F.lit("x")) == "")
        return bind(F.struct(path.alias("path"), ref["kind"].alias("kind"), own.alias("own"), F.coalesce(join_path(page, path), F.lit("")).alias("rel")), finish)

    def finish(r: Column) -> Column:
        kind = F.when(r["own"], "file").when(r["kind"].isNotNull(), r["kind"]).when(climbs_out(r["rel"]), "outside").otherwise("file")
        folder = r["path"].rlike(r"(?:^|/)\.{0,2}$")
        base = F.when(r["own"] | (kind != "file"), page).when((r["rel"] != "") & folder, F.concat(r["rel"], F.lit("/"))).otherwise(r["rel"])
        return F.struct(base.alias("base"), kind.alias("kind"))

    return bind(split_reference(href), settle)


def is_html(rel: Column) -> Column:
    return F.lower(rel).rlike(r"\.html?$")


def prefixes(rel: Column) -> Column:
    """The leading directories of a path, without the path itself."""
    parts = F.split(rel, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def escape_segment(text: Column) -> Column:
    """Percent-encode one path segment; letters, digits and -_.~$&+=:@ stay."""
    out = F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for code, sign in (("%7E", "~"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3D", "="), ("%3A", ":"), ("%40", "@")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def encode_component(text: Column) -> Column:
    """Percent-encode as for a URL component; letters, digits and -_.!~*'() stay."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, sign in (("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def route(rel: Column, query: Column, fragment: Column) -> Column:
    """The in-bundle address of a page: #/path?query#fragment."""
    path = F.array_join(F.transform(F.split(rel, "/"), escape_segment), "/")
    return F.concat(F.lit("#/"), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))


def parse_route(address: Column) -> Column:
    """The inverse of ``route``: struct(path, query, fragment), null where the address is no route."""
    part = lambda k: F.regexp_extract(address, r"(?s)^#/([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", k)
    path = F.array_join(F.transform(F.split(part(1), "/"), decode_percent), "/")
    return F.when(address.startswith("#/"), F.struct(path.alias("path"), part(2).alias("query"), part(3).alias("fragment")))


def glob_pattern(glob: str) -> str:
    """A glob (*, ?, classes, backslash escapes; none crosses a slash) as an anchored regular expression; ValueError if malformed."""
    out, at = "", 0
    while at < len(glob):
        c = glob[at]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            m = re.match(r"\[(\^?)((?:\\.|[^\\\]\-])(?:-(?:\\.|[^\\\]\-]))?(?:(?:\\.|[^\\\]\-])(?:-(?:\\.|[^\\\]\-]))?)*)\]", glob[at:], re.S)
            if not m:
                raise ValueError(f"malformed pattern {glob!r}")
            inner = re.sub(r"\\(.)|([\[&^])", lambda x: "\\" + (x[1] or x[2]), m[2])
            out += f"[{m[1]}{inner}]" if not m[1] else f"(?!/)[^{inner}]"
            at += len(m[0]) - 1
        elif c == "\\":
            at += 1
            if at == len(glob):
                raise ValueError(f"malformed pattern {glob!r}")
            out += re.escape(glob[at])
        else:
            out += re.escape(c)
        at += 1
    return f"^{out}$"


@F.pandas_udf(T.StringType())
def glob_regex(globs: pd.Series) -> pd.Series:
    """``glob_pattern`` of each glob, null where it is malformed."""

    def one(glob):
        try:
            return None if glob is None else glob_pattern(glob)
        except ValueError:
            return None

    return globs.map(one)


def site_patterns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(site, pattern)`` as (site, patterns), the list that ``excluded_by`` takes, and the malformed ones (site, pattern)."""
    glob = F.regexp_replace(F.regexp_replace("pattern", r"^\./", ""), "^/", "")
    each = rows.select("site", "pattern", glob.alias("glob")).filter("glob != ''").distinct().withColumn("regex", glob_regex("glob"))
    good = each.filter("regex is not null").groupBy("site").agg(F.sort_array(F.collect_list(F.struct("regex", F.col("glob").contains("/").alias("deep")))).alias("patterns"))
    return good, each.filter("regex is null").select("site", "pattern")


def excluded_by(rel: Column, patterns: Column) -> Column:
    """``excluded`` by a list of (regex, deep) in a column; a null list excludes nothing."""
    leads, names = prefixes(rel), F.split(rel, "/")
    hit = lambda p: F.regexp_like(rel, p["regex"]) | F.exists(F.when(p["deep"], leads).otherwise(names), lambda part: F.regexp_like(part, p["regex"]))
    return F.coalesce(F.exists(patterns, hit), F.lit(False))


def _matches(regex: str):
    return lambda part: part.rlike(regex)


def excluded(rel: Column, patterns: list[str]) -> Column:
    """Whether a path matches an exclude pattern: the whole path, a leading directory, or (slash-less patterns) any segment."""
    found = F.lit(False)
    for glob in patterns:
        glob = glob.removeprefix("./").removeprefix("/")
        if not glob:
            continue
        regex = glob_pattern(glob)
        inner = F.exists(prefixes(rel) if "/" in glob else F.split(rel, "/"), _matches(regex))
        found = found | rel.rlike(regex) | inner
    return F.coalesce(found, F.lit(False))
