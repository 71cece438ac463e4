"""Resolution of references against the inventory of a site's files, as joins on (site, rel).

References are resolved in their row, looked up once for each distinct target, and joined back; the inventory is
never collected, and popular targets are single rows on its side of the join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .graph import by_shuffle
from .spread import dealt_join

KINDS = ("empty", "fragment", "external", "invalid", "outside", "missing", "excluded", "file")

# Media types of common web file extensions.
MIME = {
    "html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml", "xml": "application/xml", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "vtt": "text/vtt", "pdf": "application/pdf", "json": "application/json", "map": "application/json", "webmanifest": "application/manifest+json",
    "css": "text/css", "js": "text/javascript", "mjs": "text/javascript", "cjs": "text/javascript", "wasm": "application/wasm",
    "svg": "image/svg+xml", "png": "image/png", "apng": "image/apng", "jpg": "image/jpeg", "jpeg": "image/jpeg", "jfif": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "avif": "image/avif", "jxl": "image/jxl", "bmp": "image/bmp", "ico": "image/vnd.microsoft.icon", "cur": "image/vnd.microsoft.icon", "tif": "image/tiff", "tiff": "image/tiff",
    "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf", "otf": "font/otf", "ttc": "font/collection", "eot": "application/vnd.ms-fontobject",
    "mp3": "audio/mpeg", "m4a": "audio/mp4", "aac": "audio/aac", "wav": "audio/wav", "flac": "audio/flac", "ogg": "audio/ogg", "oga": "audio/ogg", "opus": "audio/ogg", "weba": "audio/webm", "mid": "audio/midi", "midi": "audio/midi",
    "mp4": "video/mp4", "m4v": "video/mp4", "webm": "video/webm", "ogv": "video/ogg", "mov": "video/quicktime", "avi": "video/x-msvideo", "mkv": "video/x-matroska",
    "zip": "application/zip", "gz": "application/gzip", "tar": "application/x-tar", "7z": "application/x-7z-compressed", "rar": "application/vnd.rar",
    "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "ppt": "application/vnd.ms-powerpoint", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "odt": "application/vnd.oasis.opendocument.text", "ods": "application/vnd.oasis.opendocument.spreadsheet", "odp": "application/vnd.oasis.opendocument.presentation", "epub": "application/epub+zip", "ics": "text/calendar", "vcf": "text/vcard",
}
# Leading bytes of formats that are recognised without an extension.
MAGIC = (("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("255044462D", "application/pdf"), ("504B0304", "application/zip"), ("1F8B08", "application/x-gzip"), ("774F4646", "font/woff"), ("774F4632", "font/woff2"), ("00010000", "font/ttf"), ("4F54544F", "font/otf"), ("4F67675300", "application/ogg"), ("494433", "audio/mpeg"), ("1A45DFA3", "video/webm"), ("00000100", "image/x-icon"), ("424D", "image/bmp"), ("0061736D", "application/wasm"))


def mime_type(rel: Column, content: Column) -> Column:
    """Media type by extension, else by leading bytes, else text/plain or application/octet-stream by control bytes."""
    extension = F.lower(F.regexp_extract(rel, r"\.([^./]*)$", 1))
    known = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    start = F.hex(F.substring(content, 1, 512))
    found = F.try_element_at(known, extension)
    head = F.ltrim(F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    sniffed = F.when(head.rlike(r"^(?:<!doctype html|<html|<head|<script|<iframe|<h1|<div|<font|<table|<a|<style|<title|<b|<body|<br|<p|<!--)[\s>]") | head.startswith("<!--"), "text/html").when(head.startswith("<?xml"), "text/xml")
    for magic, kind in MAGIC:
        sniffed = sniffed.when(start.startswith(magic), kind)
    sniffed = sniffed.when(start.rlike("^52494646.{8}57454250"), "image/webp").when(start.rlike("^.{8}66747970"), "video/mp4")
    binary = start.rlike(r"^(?:..)*?(?:0[0-8B]|0[EF]|1[0-9CDEF]|1A)")
    return F.coalesce(found, sniffed, F.when(binary, "application/octet-stream").otherwise("text/plain"))


def inventory(files: DataFrame) -> DataFrame:
    """Distinct (site, rel) of regular files."""
    return files.select("site", "rel").distinct()


def directories(files: DataFrame) -> DataFrame:
    """Distinct (site, dir) of every directory that holds a file, the root (empty) included."""
    return files.select("site", F.explode(F.concat(F.array(F.lit("")), paths.prefixes(F.col("rel")))).alias("dir")).distinct()


def resolve(refs: DataFrame, raw: str = "raw", base: str = "base", base_external: str | None = None) -> DataFrame:
    """Add kind, rel, query, fragment and is_html to references, as far as their texts decide; kind is null where files must be looked up."""

    def settle(r: Column) -> Column:
        early = r["kind"]
        if base_external:
            early = F.when(F.col(base_external) & ~F.coalesce(early, F.lit("")).isin("empty", "fragment"), "external").otherwise(early)
        rel = F.when(early.isNull(), paths.join_path(F.col(base), r["path"]))
        return F.struct(early.alias("early"), rel.alias("rel"), r["query"].alias("query"), r["fragment"].alias("fragment"))

    def finish(r: Column) -> Column:
        kind = F.coalesce(r["early"], F.when(paths.climbs_out(r["rel"]), "outside"))
        return F.struct(kind.alias("kind"), F.coalesce(r["rel"], F.lit("")).alias("rel"), r["query"].alias("query"), r["fragment"].alias("fragment"))

    keep = [c for c in refs.columns if c not in ("kind", "rel", "query", "fragment", "is_html")]
    rows = refs.select(*keep, paths.bind(paths.bind(paths.split_reference(F.col(raw)), settle), finish).alias("_r"))
    return rows.select(*keep, "_r.kind", "_r.rel", "_r.query", "_r.fragment", F.lit(False).alias("is_html"))


def look_up(resolved: DataFrame, files: DataFrame, excludes: Iterable[str] | DataFrame = (), dirs: DataFrame | None = None) -> DataFrame:
    """Settle the kinds that ``resolve`` left open: file, excluded (which beats missing) or missing; directories become their index.html.

    Each distinct (site, rel) is looked up once.  ``excludes`` are patterns for all sites, or a saved table (site, patterns) of ``paths.site_patterns``.
    """
    own = isinstance(excludes, DataFrame)
    patterns = [] if own else list(excludes)
    for glob in patterns:
        paths.glob_pattern(glob.removeprefix("./").removeprefix("/"))
    dirs = directories(files) if dirs is None else dirs
    asked = resolved.filter("kind is null").select("site", "rel").distinct()
    asked = asked.join(by_shuffle(dirs.select("site", F.col("dir").alias("rel"), F.lit(True).alias("_dir"))), ["site", "rel"], "left")
    target = F.when(F.col("_dir"), F.when(F.col("rel") == "", "index.html").otherwise(F.concat("rel", F.lit("/index.html")))).otherwise(F.col("rel"))
    asked = asked.select("site", "rel", target.alias("_target"))
    there = inventory(files).select("site", F.col("rel").alias("_target"), F.lit(True).alias("_there"))
    asked = asked.join(by_shuffle(there), ["site", "_target"], "left")
    if own:
        asked = dealt_join(asked, excludes, ["site"], "left")
    gone = paths.excluded_by(F.col("_target"), F.col("patterns")) if own else paths.excluded(F.col("_target"), patterns)
    kind = F.when(gone, "excluded").when(F.col("_there"), "file").otherwise("missing")
    found = asked.select("site", "rel", "_target", kind.alias("_kind"))
    joined = resolved.join(by_shuffle(found), ["site", "rel"], "left")
    open_ = F.col("kind").isNull()
    return joined.select(*(c for c in resolved.columns if c not in ("kind", "rel", "is_html")), F.coalesce("kind", "_kind").alias("kind"), F.when(open_, F.col("_target")).otherwise(F.col("rel")).alias("rel"), F.when(open_, paths.is_html(F.col("_target"))).otherwise(False).alias("is_html"))


def kind_counts(refs: DataFrame) -> DataFrame:
    """How many references of each role and kind every site has."""
    return refs.groupBy("site", "role", "kind").agg(F.count("*").alias("n"))
