"""The resource store: each distinct resource of a site once, by content hash, with short keys, data URLs and placeholders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import encode_component
from .graph import by_shuffle, saved
from .spread import dealt_join

KEY, STEP, MOST = 16, 8, 64
#: Begins a placeholder; followed by the key.
PREFIX = "sitepack-res-"


def content_hash(mime: Column, is_text: Column, data: Column) -> Column:
    """SHA-256 over media type, a zero byte, a text flag and the bytes."""
    flag = F.when(is_text, F.lit("t")).otherwise(F.lit("b"))
    return F.sha2(F.concat(F.encode(mime, "utf-8"), F.unhex(F.lit("00")), F.encode(flag, "utf-8"), data), 256)


def add_hashes(resources: DataFrame) -> DataFrame:
    """``resources(site, ord, rel, mime, is_text, data)`` with ``hash`` and ``size``; computed before any shuffle, so that bytes need not move."""
    return resources.withColumn("hash", content_hash(F.col("mime"), F.col("is_text"), F.col("data"))).withColumn("size", F.length("data").cast("long"))


def deduplicate(hashed: DataFrame) -> DataFrame:
    """One row for each (site, hash): first_rel (of the least ord), ord, mime, is_text, size and refs (how many files it stands for)."""
    first = F.min(F.struct("ord", "rel", "mime", "is_text", "size"))
    return hashed.groupBy("site", "hash").agg(first.alias("f"), F.count("*").alias("refs")).select("site", "hash", F.col("f.rel").alias("first_rel"), F.col("f.ord").alias("ord"), F.col("f.mime").alias("mime"), F.col("f.is_text").alias("is_text"), F.col("f.size").alias("size"), "refs")


def assign_keys(distinct: DataFrame, key: int = KEY, step: int = STEP, most: int = MOST, known: DataFrame | None = None) -> DataFrame:
    """Add ``key``: the first ``key`` hex digits of the hash; on a collision later resources (by ord) take ``step`` digits more.

    Keys of ``known(site, key)`` have been given before and collide as well.
    """
    left, done, length = distinct, [], key
    while True:
        short = F.substring("hash", 1, length)
        rank = F.row_number().over(Window.partitionBy("site", short).orderBy("ord", "hash"))
        ranked = left.withColumn("key", short).withColumn("_n", rank)
        before = [*done, *([] if known is None else [known])]
        taken = reduce(DataFrame.unionByName, [b.select("site", "key") for b in before]).withColumn("_taken", F.lit(True)) if before else None
        ranked = ranked.join(by_shuffle(taken), ["site", "key"], "left") if taken is not None else ranked.withColumn("_taken", F.lit(None).cast("boolean"))
        ranked = saved(ranked.withColumn("_ok", (F.col("_n") == 1) & F.col("_taken").isNull() | F.lit(length >= most)))
        done.append(ranked.filter("_ok").drop("_n", "_ok", "_taken"))
        left = ranked.filter("not _ok").select(*distinct.columns)
        if length >= most or left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        length = min(most, length + step)


def key_texts(texts: DataFrame, mime: str, known: DataFrame, key: int = KEY, step: int = STEP, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """``texts(site, …, text)`` with ``key``, and ``known(site, hash, key)`` with what is new among them: one round of a store that still grows.

    Content that is known keeps its key, and new content collides with all keys given in earlier rounds.  Texts are moved only by keys that
    did collide (a broadcast if few, else salted), as the others follow from the hash.
    """
    rows = saved(texts.withColumn("_hash", content_hash(F.lit(mime), F.lit(True), F.encode("text", "utf-8"))))
    fresh = rows.select("site", F.col("_hash").alias("hash")).distinct().join(by_shuffle(known), ["site", "hash"], "left_anti").withColumn("ord", F.lit(0))
    known = saved(known.select("site", "hash", "key").unionByName(assign_keys(fresh, key, step, most, known).select("site", "hash", "key")))
    longer = saved(known.filter(F.length("key") > key).select("site", F.col("hash").alias("_hash"), F.col("key").alias("_key")))
    rows = dealt_join(rows, longer, ["site", "_hash"], "left").withColumn("key", F.coalesce("_key", F.substring("_hash", 1, key)))
    return rows.drop("_hash", "_key"), known


def totals(distinct: DataFrame) -> DataFrame:
    """Resources and bytes of each site."""
    return distinct.groupBy("site").agg(F.count("*").alias("resources"), F.sum("size").alias("resource_bytes"))


def within_limit(resources: DataFrame, limits: DataFrame, size: str = "size") -> tuple[DataFrame, DataFrame]:
    """Resources at most as large as their site's ``max_resource_size`` (0 or null: no limit), and those larger."""
    rows = dealt_join(resources, limits.select("site", "max_resource_size"), ["site"], "left")
    over = (F.coalesce("max_resource_size", F.lit(0)) > 0) & (F.col(size) > F.col("max_resource_size"))
    return rows.filter(~over).drop("max_resource_size"), rows.filter(over)


def base64_url(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(data), r"[\r\n]", ""))


def text_url(mime: Column, text: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";charset=utf-8,"), encode_component(text))


def placeholder(key: Column, fragment: Column | None = None, prefix: str = PREFIX) -> Column:
    """The token that stands for a resource in rewritten text, with the reference's #fragment."""
    token = F.concat(F.lit(prefix), key)
    return token if fragment is None else F.concat(token, F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))


def shared_resources(hashed: DataFrame, k: int) -> DataFrame:
    """The ``k`` contents that most sites or files share, with the bytes saved by storing them once."""
    each = hashed.groupBy("hash").agg(F.count("*").alias("refs"), F.countDistinct("site").alias("sites"), F.max("size").alias("size"))
    return each.withColumn("saved_bytes", (F.col("refs") - 1) * F.col("size")).orderBy(F.desc("saved_bytes"), "hash").limit(k)


def token_pattern(prefix: str = PREFIX, least: int = KEY) -> str:
    return f"{prefix}([0-9a-f]{{{least},{MOST}}})"


def splice_tokens(texts: DataFrame, values: DataFrame, keys: list[str], text: str = "text", prefix: str = PREFIX, by: list[str] | None = None) -> DataFrame:
    """``texts`` with every placeholder whose (site, key), or columns ``by`` and key, is in ``values`` replaced by its value; others stay."""
    by = by or ["site"]
    parts = F.regexp_extract_all(F.col(text), F.lit(rf"(?s){token_pattern(prefix)}|.+?(?={prefix}[0-9a-f]{{{KEY}}}|\z)"), 0)
    rows = texts.select(*keys, F.posexplode_outer(parts).alias("_i", "_part"))
    rows = rows.withColumn("key", F.regexp_extract("_part", rf"^{token_pattern(prefix)}$", 1)).join(by_shuffle(values.select(*by, "key", "value")), [*by, "key"], "left")
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("value", "_part").alias("v")))), lambda x: x["v"]), "").alias(text))
