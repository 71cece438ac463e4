"""Readers of site trees, captured pages and bundles; writers of bundles, result tables and manifests."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import saved
from ..operators.parts import read_parts

#: Files of this size on do not fit into a binary column.
LARGEST = 2**31 - 1024


def _look(root: str):
    """Entries of folders below ``root``: a row (path, length) for each file, and one without length for each folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [e for e in system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))) if e.type != fs.FileType.NotFound]
                names = [f"{folder}/{e.base_name}".lstrip("/") for e in found]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([e.size if e.is_file else None for e in found], pa.int64())], ["path", "length"])

    return run


def list_trees(spark: SparkSession, root: str) -> DataFrame:
    """Names of all files under ``root``/site/…, empty and hidden ones too: site, rel, length.

    A round lists the folders that the one before found, each in the task it is dealt to; there are as many rounds as folders lie in each other.
    Files that lie in no site's folder are left out; an empty ``root`` has none.
    """
    folders, files = spark.createDataFrame([("",)], "folder string"), []
    while True:
        tasks = min(folders.count(), 4 * spark.sparkContext.defaultParallelism)
        if not tasks:
            return reduce(DataFrame.unionByName, files)
        entries = saved(folders.repartition(tasks).mapInArrow(_look(root), "path string, length long"))
        inner = entries.filter("length is not null and instr(path, '/') > 0")
        files.append(inner.select(F.substring_index("path", "/", 1).alias("site"), F.expr("substring(path, instr(path, '/') + 1)").alias("rel"), "length"))
        folders = entries.filter("length is null").select(F.col("path").alias("folder"))


def _read(root: str, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            data, held, low = [], 0, 0
            for at, (site, rel, length) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                whole = None
                if length < LARGEST:
                    with system.open_input_file(f"{base}/{site}/{rel}") as file:
                        whole = file.read()
                data.append(whole)
                held += length if whole is not None else 0
                if held >= batch_bytes or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(low, len(data)).columns[:2], pa.array(data, pa.binary()), batch.column(2).slice(low, len(data))], ["site", "rel", "content", "length"])
                    data, held, low = [], 0, at + 1

    return run


def read_trees(spark: SparkSession, root: str, task_bytes: int = 64 << 20) -> DataFrame:
    """Files of many sites under ``root``/site/…: site, rel, content, length.  Nothing outside ``root`` is read.

    Files are dealt to tasks by name, whatever their site, about ``task_bytes`` or 4,096 of them to each.  Empty and hidden files are files like others; one
    that is too large for a column (``LARGEST``) has null content, as what cannot be read.
    """
    files = saved(list_trees(spark, root))
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).head()
    tasks = max(1, size // task_bytes, n // 4096)
    return files.repartition(int(tasks), "site", "rel").mapInArrow(_read(root, 16 << 20), "site string, rel string, content binary, length long")


def url_site(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def url_rel(url: Column) -> Column:
    """A URL's path in its site, without query and fragment; directories (and no path) are their index.html."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/?([^?#]*)", 1)
    return F.when((path == "") | path.endswith("/"), F.concat(path, F.lit("index.html"))).otherwise(path)


def captured_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` as page_id, site, page and text; rows whose url names no site are left out."""
    rows = pages.select("page_id", url_site(F.col("url")).alias("site"), url_rel(F.col("url")).alias("page"), F.col("html").alias("text"))
    return rows.filter(F.coalesce("site", F.lit("")) != "")


def read_bundles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pages and resources of bundles written by ``write_bundles``."""
    return read_parts(spark.read.parquet(path).select("site", "part", "text"))


def write_bundles(bundles: DataFrame, path: str, buckets: int = 64) -> None:
    """Write (site, part, text) as Parquet in buckets of sites, parts in order; a large site's parts are dealt to several tasks and files.

    Spark's committer makes it all or nothing.
    """
    rows = bundles.withColumn("bucket", F.pmod(F.xxhash64("site"), F.lit(buckets)).cast("int"))
    rows.repartitionByRange("bucket", "site", "part").sortWithinPartitions("bucket", "site", "part").write.partitionBy("bucket").parquet(path)


def write_tables(folder: str, **tables: DataFrame) -> None:
    """Write result tables under ``folder``, each dealt by site and sorted by site and, where there is one, ord or page."""
    for name, df in tables.items():
        order = ["site", *[c for c in ("ord", "page", "rel", "seq") if c in df.columns][:1]]
        df.repartition("site").sortWithinPartitions(*order).write.parquet(f"{folder}/{name}")


def manifest(*used: DataFrame) -> DataFrame:
    """Distinct (site, rel) of every input file that a build read: reached and framed pages, sprites, resources (also those over the limit)."""
    return reduce(DataFrame.union, (u.select("site", "rel") for u in used)).distinct().orderBy("site", "rel")
