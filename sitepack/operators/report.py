"""Diagnostics, broken links, site summaries, and sizes for people."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import by_shuffle

# Levels and wording by code; a code is stable, its wording is for people.
CODES = {
    "missing": ("warning", "the file does not exist in the site"),
    "outside": ("warning", "the reference leaves the site"),
    "invalid": ("warning", "the reference cannot be parsed"),
    "excluded": ("info", "the file is excluded by a pattern"),
    "too_large": ("warning", "the file is larger than the site's limit and was not embedded"),
    "form": ("warning", "forms that post to the site do not work in a bundle"),
    "csp": ("warning", "a content security policy was removed"),
    "base_external": ("warning", "the base address is external; relative references stay"),
    "base_outside": ("warning", "the base address leaves the site and is ignored"),
    "base_invalid": ("warning", "the base address cannot be parsed and is ignored"),
    "circular": ("warning", "the frame or import embeds itself"),
    "too_deep": ("warning", "frames are nested too deeply"),
    "frames_too_large": ("warning", "the page with its frames exceeds the budget; its frames stay references"),
    "module_import": ("warning", "a module script imports other modules"),
    "sprite_without_fragment": ("warning", "a use element names no symbol"),
    "sprite_not_svg": ("warning", "the sprite is not an SVG document"),
    "other_style": ("info", "a style sheet of another type stays"),
    "other_script": ("info", "a script of another type stays"),
    "removed": ("info", "the element was removed"),
    "refresh": ("info", "a refresh became a script"),
    "decoded": ("info", "the document was decoded from another charset"),
    "unreadable": ("warning", "the page cannot be read"),
    "entry_unreadable": ("warning", "the entry page cannot be read"),
}
# References of these roles are crawled, but say nothing when their target is not there.
QUIET = ("page",)


def diagnostics(refs: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows (site, page, seq, ref, level, code, message), one for each occurrence.

    From resolved references come missing, outside, invalid, excluded, form and the kept-type notes; ``more`` are further
    tables of (site, page, seq, ref, code).
    """
    known = refs.filter(~F.col("role").isin(*QUIET))
    code = (F.when((F.col("role") == "form"), F.when(F.col("kind").isin("file", "missing"), "form")).when(F.col("role").isin("other_style", "other_script"), F.col("role"))
            .when(F.col("role") == "remove", "removed").when(F.col("kind").isin("missing", "outside", "invalid", "excluded"), F.col("kind")))
    rows = known.select("site", "page", F.col("seq").cast("long").alias("seq"), F.col("raw").alias("ref"), code.alias("code")).filter("code is not null")
    rows = reduce(DataFrame.unionByName, (m.select("site", "page", F.col("seq").cast("long").alias("seq"), "ref", "code") for m in more), rows)
    pick = lambda k: F.create_map(*(F.lit(x) for c, v in CODES.items() for x in (c, v[k])))[F.col("code")]
    return rows.select("site", "page", "seq", "ref", pick(0).alias("level"), "code", pick(1).alias("message"))


def format_line(level: Column, page: Column, ref: Column, message: Column) -> Column:
    """level: page: "ref": message, without its empty parts."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.concat_ws(": ", level, some(page), F.when(F.coalesce(ref, F.lit("")) != "", F.concat(F.lit('"'), F.replace(F.replace(ref, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))), message)


def level_counts(diags: DataFrame) -> DataFrame:
    return diags.groupBy("site", "level").agg(F.count("*").alias("n"))


def visible(diags: DataFrame, verbose: bool = False) -> DataFrame:
    return diags if verbose else diags.filter("level != 'info'")


def strict_failures(diags: DataFrame) -> DataFrame:
    """Sites with at least one warning, and how many: under a strict gate they count as failed."""
    return diags.filter("level = 'warning'").groupBy("site").agg(F.count("*").alias("warnings"))


def broken_links(refs: DataFrame) -> DataFrame:
    """Missing targets: (site, rel, pages, refs)."""
    return refs.filter("kind = 'missing'").groupBy("site", "rel").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("refs"))


def summary(sites: DataFrame, crawl: DataFrame, titles: DataFrame, totals: DataFrame, bundles: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """One row for each site: entry, title, pages, resources, resource_bytes, and bytes and files where given; ``bundles(site, part, text)``."""
    rows = sites.select("site", "entry").join(by_shuffle(titles.select("site", "title")), "site", "left")
    rows = rows.join(by_shuffle(crawl.groupBy("site").agg(F.count("*").alias("pages"))), "site", "left").join(by_shuffle(totals), "site", "left")
    if bundles is not None:
        rows = rows.join(by_shuffle(bundles.groupBy("site").agg(F.sum(F.octet_length("text")).alias("bytes"))), "site", "left")
    if files is not None:
        rows = rows.join(by_shuffle(files.groupBy("site").agg(F.count("*").alias("files"))), "site", "left")
    return rows.fillna(0, [c for c in ("pages", "resources", "resource_bytes", "bytes", "files") if c in rows.columns])


def human_size(n: Column) -> Column:
    """Bytes as B, KiB, MiB or GiB with one decimal."""
    steps = ((1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB"))
    out = F.when(n >= steps[0][0], F.format_string(f"%.1f {steps[0][1]}", n / steps[0][0]))
    for size, name in steps[1:]:
        out = out.when(n >= size, F.format_string(f"%.1f {name}", n / size))
    return out.otherwise(F.format_string("%d B", n.cast("long")))


def parse_size(text: Column) -> Column:
    """Bytes of a size such as 10, 5B, 64K, 1.5MB or 2GiB; null where it is none."""
    part = lambda k: F.regexp_extract(F.upper(F.trim(text)), r"^([0-9]+(?:\.[0-9]+)?)\s*([KMG]?)(?:I?B)?$", k)
    times = F.when(part(2) == "K", 1 << 10).when(part(2) == "M", 1 << 20).when(part(2) == "G", 1 << 30).otherwise(1)
    return F.when(part(1) != "", F.floor(part(1).cast("double") * times).cast("long"))


def parse_size_option(text: str) -> int:
    """``parse_size`` for a single option."""
    m = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)\s*([KMG]?)(?:I?B)?", text.strip().upper())
    if not m:
        raise ValueError(f"{text!r} is not a size")
    return int(float(m[1]) * {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30}[m[2]])
