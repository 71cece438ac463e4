"""Style sheets: references, import closure with circles cut, and bottom-up rewriting with content keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import css
from .graph import by_shuffle, cut_back_edges, heights, saved
from .store import KEY, key_texts, placeholder


def sheet_references(sheets: DataFrame, text: str = "text", imports: bool = True) -> DataFrame:
    """References (site, page, seq, kind, raw) of sheets ``(site, page, text)``: url() and image-set strings, and @import targets.

    Only sheets that may hold any go through the scan.
    """
    some = sheets.filter(css.may_refer(F.col(text))).select("site", "page", css.pieces(F.col(text), F.lit(imports)).alias("p"))
    rows = some.select("site", "page", F.posexplode("p").alias("seq", "piece")).filter("piece.kind != ''")
    return rows.select("site", "page", "seq", F.col("piece.kind").alias("kind"), F.col("piece.raw").alias("raw"))


def splice(sheets: DataFrame, replacements: DataFrame, text: str = "text", imports: bool = True) -> DataFrame:
    """``sheets`` with references replaced by ``replacements(site, page, raw, new)``; all else stays byte for byte."""
    maps = replacements.groupBy("site", "page").agg(F.map_from_entries(F.collect_set(F.struct("raw", "new"))).alias("_map"))
    rows = sheets.join(by_shuffle(maps), ["site", "page"], "left")
    plain = rows.filter(F.col("_map").isNull()).drop("_map")
    some = rows.filter(F.col("_map").isNotNull()).withColumn("_p", css.pieces(F.col(text), F.lit(imports)))
    new = lambda p: F.try_element_at(F.col("_map"), p["raw"])
    put = lambda p: F.when((p["kind"] == "") | new(p).isNull(), p["text"]).when(p["kind"] == "url", F.concat(F.lit('url("'), new(p), F.lit('")'))).otherwise(F.concat(F.lit('"'), new(p), F.lit('"')))
    done = some.withColumn(text, F.array_join(F.transform("_p", put), "")).drop("_map", "_p")
    return plain.unionByName(done.select(*plain.columns))


def import_closure(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Import edges (site, src, dst, seq) without those that close a circle on a path from ``roots(site, page)``, and those that do."""
    return cut_back_edges(edges, roots)


def rewrite_bottom_up(sheets: DataFrame, refs: DataFrame, imports: DataFrame, binaries: DataFrame, known: DataFrame | None = None, key: int = KEY) -> DataFrame:
    """Rewrite sheets ``(site, page, text)`` leaves first; a sheet's key begins the hash of its rewritten text: (site, page, text, key).

    Keys of each height are settled before those above are rewritten: they collide with those of ``known(site, hash, key)`` and of lower heights.

    ``refs(site, page, raw, kind, rel, fragment)`` are their resolved references, ``imports(site, src, dst)`` the sound import edges, and
    ``binaries(site, rel, key)`` the keys of embedded files.  References to anything else keep their original token.
    """
    levels = saved(heights(sheets.select("site", F.col("page").alias("node")), imports).withColumnRenamed("node", "page"))
    urls = refs.filter("kind = 'url'").join(by_shuffle(binaries), ["site", "rel"]).select("site", "page", "raw", placeholder(F.col("key"), F.col("fragment")).alias("new"))
    sound = refs.filter("kind = 'import'").join(by_shuffle(imports.select("site", F.col("src").alias("page"), F.col("dst").alias("rel"))), ["site", "page", "rel"], "left_semi")
    known = sheets.select("site", F.lit("").alias("hash"), F.lit("").alias("key")).limit(0) if known is None else known
    done, top = None, levels.agg(F.max("height")).head()[0]
    for height in range(0 if top is None else top + 1):
        now = sheets.join(by_shuffle(levels.filter(F.col("height") == height).select("site", "page")), ["site", "page"], "left_semi")
        new = urls
        if done is not None:
            new = urls.unionByName(sound.join(by_shuffle(done.select("site", F.col("page").alias("rel"), "key")), ["site", "rel"]).select("site", "page", "raw", placeholder(F.col("key"), F.col("fragment")).alias("new")))
        out, known = key_texts(splice(now.select("site", "page", "text"), new), "text/css", known, key)
        done = saved(out if done is None else done.unionByName(out))
    return done if done is not None else sheets.select("site", "page", "text").withColumn("key", F.lit("")).limit(0)


def first_visit_order(edges: DataFrame) -> DataFrame:
    """The first importer of each sheet, by seq: it decides the sheet's fallback charset."""
    at = Window.partitionBy("site", "dst").orderBy("seq", "src")
    return edges.withColumn("_n", F.row_number().over(at)).filter("_n = 1").drop("_n")
