"""Graph jobs by iterated joins: breadth-first crawl with exact order, closure with ancestors, heights.

Rounds keep only a frontier; the visited set, the frontier and the edges are saved tables, so lineage does not grow
and a lost executor costs no more than its round.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_ROUNDS = 10_000
#: A table of a few short columns is broadcast up to so many rows, as counted; beyond it joins shuffle.
BROADCAST_ROWS = 200_000
FRAME_DEPTH = 8


def scratch(spark) -> str:
    """A new path in the folder that the driver and all executors share (spark.checkpoint.dir, or the context's checkpoint folder)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not there.isDefined():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = there.get()
    return f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"


def saved(df: DataFrame, rows_a_file: int = 0) -> DataFrame:
    """Write to the shared folder and read back; tables of long texts in files of ``rows_a_file``, as a reader takes thousands of a file's rows at once."""
    path = scratch(df.sparkSession)
    (df.write.option("maxRecordsPerFile", rows_a_file) if rows_a_file else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles: Spark would broadcast a table by the size of its compressed files, in which repeated names take next to nothing."""
    return df.hint("merge")


def counted(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` (saved, a few short columns) for a join: broadcast if its ``rows`` are few, else by shuffle."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else by_shuffle(df)


def link_edges(refs: DataFrame, single_page: DataFrame | None = None) -> DataFrame:
    """Edges (site, src, dst, seq) of links to HTML files: each target once, at its first place, never the page itself.

    Sites in ``single_page(site)`` have none.
    """
    links = refs.filter(F.col("role").isin("link", "page", "refresh") & (F.col("kind") == "file") & F.col("is_html") & (F.col("page") != F.col("rel")))
    if single_page is not None:
        links = links.join(counted(single_page.select("site")), "site", "left_anti")
    place = F.col("seq").cast("long") * 1000 + F.col("part") if "part" in refs.columns else F.col("seq").cast("long")
    return links.groupBy("site", F.col("page").alias("src"), F.col("rel").alias("dst")).agg(F.min(place).alias("seq"))


def crawl(edges: DataFrame, entries: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """Breadth-first reachability from each site's entry, in exact crawl order: site, page, depth, ord (from 0), parent.

    Pages are queued when first seen, links in document order, as a single queue would have it.  A round joins the frontier
    with the edges, keeps each new page's first (parent's rank, seq), and ranks the new pages of its level; ranks become
    places in the whole order at the end, when the levels' sizes are known.
    """
    edges = saved(edges.select("site", "src", "dst", "seq"))
    front = saved(entries.select("site", F.col("entry").alias("page"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("rank"), F.lit(None).cast("string").alias("parent")).filter("page is not null").dropDuplicates(["site"]))
    done, n = [front], None
    for depth in range(1, most_rounds + 1):
        seen = reduce(DataFrame.unionByName, done).select("site", F.col("page").alias("dst"))
        new = edges.join(counted(front.select("site", F.col("page").alias("src"), "rank"), n), ["site", "src"])
        new = new.groupBy("site", "dst").agg(F.min(F.struct("rank", "seq", "src")).alias("by")).join(by_shuffle(seen), ["site", "dst"], "left_anti")
        order = Window.partitionBy("site").orderBy("by.rank", "by.seq", "dst")
        front = saved(new.select("site", F.col("dst").alias("page"), F.lit(depth).alias("depth"), (F.row_number().over(order) - 1).cast("long").alias("rank"), F.col("by.src").alias("parent")))
        n = front.count()
        if not n:
            break
        done.append(front)
        if len(done) > 16:
            done = [saved(reduce(DataFrame.unionByName, done))]
    found = reduce(DataFrame.unionByName, done)
    sizes = found.groupBy("site", "depth").agg(F.count("*").alias("_n"))
    before = sizes.select("site", "depth", (F.sum("_n").over(Window.partitionBy("site").orderBy("depth")) - F.col("_n")).alias("_before"))
    from .spread import dealt_join

    return dealt_join(found, saved(before), ["site", "depth"]).select("site", "page", "depth", (F.col("_before") + F.col("rank")).alias("ord"), "parent")


def levels(edges: DataFrame, entries: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(site, page, depth) of what can be reached from each site's entry: ``crawl`` for those who need no order, without windows."""
    edges = saved(edges.select("site", "src", "dst").distinct())
    front = saved(entries.select("site", F.col("entry").alias("page"), F.lit(0).alias("depth")).filter("page is not null").dropDuplicates(["site"]))
    done, n = [front], None
    for depth in range(1, most_rounds + 1):
        seen = reduce(DataFrame.unionByName, done).select("site", "page")
        new = edges.join(counted(front.select("site", F.col("page").alias("src")), n), ["site", "src"], "left_semi").select("site", F.col("dst").alias("page")).distinct()
        front = saved(new.join(by_shuffle(seen), ["site", "page"], "left_anti").withColumn("depth", F.lit(depth)))
        n = front.count()
        if not n:
            break
        done.append(front)
        if len(done) > 16:
            done = [saved(reduce(DataFrame.unionByName, done))]
    return reduce(DataFrame.unionByName, done)


def readable_edges(edges: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Edges without those out of ``unreadable(site, page)``: such pages are seen, but lead nowhere."""
    return edges.join(by_shuffle(unreadable.select("site", F.col("page").alias("src"))), ["site", "src"], "left_anti")


def readable_pages(reached: DataFrame, unreadable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The crawl without unreadable pages, and those it met: (site, page, seq, ref, code), entry_unreadable where the site's entry is one."""
    fine = reached.join(by_shuffle(unreadable.select("site", "page")), ["site", "page"], "left_anti")
    met = reached.join(by_shuffle(unreadable.select("site", "page")), ["site", "page"], "left_semi")
    code = F.when(F.col("depth") == 0, "entry_unreadable").otherwise("unreadable")
    return fine, met.select("site", "page", F.lit(0).cast("long").alias("seq"), F.lit("").alias("ref"), code.alias("code"))


def unreachable(pages: DataFrame, reached: DataFrame) -> DataFrame:
    """(site, page) of ``pages`` that the crawl did not reach."""
    return pages.select("site", "page").join(by_shuffle(reached.select("site", "page")), ["site", "page"], "left_anti")


def depth_counts(reached: DataFrame) -> DataFrame:
    return reached.groupBy("site", "depth").agg(F.count("*").alias("pages"))


def entry_errors(sites: DataFrame, resolved: DataFrame) -> DataFrame:
    """Sites whose entry is no file: (site, entry, code), code being entry_ and the kind found."""
    kinds = resolved.select("site", F.col("kind"))
    return sites.join(by_shuffle(kinds), "site", "left").filter(F.coalesce("kind", F.lit("missing")) != "file").select("site", "entry", F.concat(F.lit("entry_"), F.coalesce("kind", F.lit("missing"))).alias("code"))


def closure(edges: DataFrame, roots: DataFrame, most_depth: int | None = FRAME_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Expand (site, src, dst, seq) edges from ``roots(site, page)`` with ancestor paths, as frames embed pages.

    Returns the embedded rows (site, root, page, path, seqs, depth) and the refused edges (the same, page being the target, and code:
    circular where it is an ancestor or its own page, too_deep beyond ``most_depth`` ancestors).
    """
    edges = saved(edges.select("site", "src", "dst", "seq"))
    front = saved(roots.select("site", F.col("page").alias("root"), "page", F.array("page").alias("path"), F.array().cast("array<long>").alias("seqs"), F.lit(0).alias("depth")))
    done, refused, depth = [front], [], 0
    while True:
        depth += 1
        step = front.select("site", "root", F.col("page").alias("src"), "path", "seqs").join(by_shuffle(edges), ["site", "src"])
        circular = F.array_contains("path", F.col("dst"))
        code = F.when(circular, "circular").when(F.lit(most_depth is not None and depth > (most_depth or 0)), "too_deep")
        step = saved(step.select("site", "root", F.col("dst").alias("page"), F.when(code.isNull(), F.concat("path", F.array("dst"))).otherwise(F.col("path")).alias("path"), F.concat("seqs", F.array(F.col("seq").cast("long"))).alias("seqs"), F.lit(depth).alias("depth"), code.alias("code")))
        refused.append(step.filter("code is not null"))
        front = step.filter("code is null").drop("code")
        if front.isEmpty():
            break
        done.append(front)
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, refused)


def reaching_circles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of ``nodes(site, node)`` from which a circle of ``edges(site, src, dst)`` can be reached: what leaves-first rounds leave over."""
    return saved(nodes.select("site", "node").distinct().join(by_shuffle(heights(nodes, edges).select("site", "node")), ["site", "node"], "left_anti"))


def cut_back_edges(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (site, src, dst, seq) without those that a depth-first walk meets while their target is still open, and those (site, src, dst).

    The walk starts at ``roots(site, page)``, in the order of their ``ord`` where they have one, else by name, follows edges by seq, and enters
    each node once.
    """
    from .circles import closing_edges

    bad = closing_edges(edges, roots)
    return edges.join(by_shuffle(bad), ["site", "src", "dst"], "left_anti"), bad


#: Sizes stop growing here: whatever is larger is beyond any budget.
MOST_SIZE = 10**18


def frame_sizes(edges: DataFrame, own: DataFrame, most_depth: int = FRAME_DEPTH, wrap: int = 10) -> DataFrame:
    """(site, page, copies, bytes): how many pages stand in each page once frames are embedded, itself included, and their bytes, before any text is made.

    ``own(site, page, bytes, escaped, signs)``: the bytes of a page's text, what escaping it as an attribute would add, and the signs that would be
    escaped.  Each frame of ``edges(site, src, dst)`` adds its page, escaped once for every level, and ``wrap`` bytes of attribute, two of them quotes.
    A round for each level of depth adds up what the level below holds.  Frames that embed themselves are counted down to ``most_depth``, so that
    the size of pages with circles is a bound; other sizes are exact, up to ``MOST_SIZE``.
    """
    kind = "decimal(38,0)"
    names = ("copies", "bytes", "escaped", "signs")
    own = saved(own.select("site", "page", F.lit(1).cast(kind).alias("copies"), *(F.col(c).cast(kind).alias(c) for c in names[1:])))
    edges = saved(edges.select("site", F.col("src").alias("page"), F.col("dst").alias("_inner")))
    now = own
    for _ in range(most_depth):
        inner = now.select("site", F.col("page").alias("_inner"), "copies", (F.col("bytes") + F.col("escaped") + wrap).alias("bytes"), (4 * F.col("signs") + 10).alias("escaped"), (F.col("signs") + 2).alias("signs"))
        sums = edges.join(by_shuffle(inner), ["site", "_inner"]).groupBy("site", "page").agg(*(F.sum(c).alias(f"_{c}") for c in names))
        add = lambda c: F.least(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)), F.lit(MOST_SIZE)).cast(kind).alias(c)
        now = saved(own.join(by_shuffle(sums), ["site", "page"], "left").select("site", "page", *map(add, names)))
    return now.select("site", "page", F.col("copies").cast("long").alias("copies"), F.col("bytes").cast("long").alias("bytes"))


def heights(nodes: DataFrame, edges: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(site, node, height) of an acyclic graph: leaves are 0, others one more than their highest target.  Nodes on circles are left out."""
    edges = saved(edges.select("site", "src", "dst").distinct())
    left = saved(nodes.select("site", "node").distinct())
    done = None
    for height in range(most_rounds):
        waiting = edges if done is None else edges.join(by_shuffle(done.select("site", F.col("node").alias("dst"))), ["site", "dst"], "left_anti")
        ready = saved(left.join(by_shuffle(waiting.select("site", F.col("src").alias("node")).distinct()), ["site", "node"], "left_anti").withColumn("height", F.lit(height)))
        if ready.isEmpty():
            break
        done = ready if done is None else saved(done.unionByName(ready))
        left = saved(left.join(by_shuffle(ready.select("site", "node")), ["site", "node"], "left_anti"))
    return done if done is not None else left.withColumn("height", F.lit(0)).limit(0)


def links_through_frames(edges: DataFrame, embedded: DataFrame) -> DataFrame:
    """Page edges where links found inside embedded frames count as the embedder's, ordered by the frame's place, then their own."""
    inner = embedded.filter("depth > 0").select("site", F.col("root").alias("page"), F.col("page").alias("src"), "seqs")
    place = lambda seqs: F.concat(seqs, F.array(F.col("seq").cast("long")))
    both = edges.select("site", F.col("src").alias("page"), "dst", place(F.array().cast("array<long>")).alias("place")).unionByName(
        inner.join(by_shuffle(edges), ["site", "src"]).select("site", "page", "dst", place(F.col("seqs")).alias("place")))
    first = both.filter("page != dst").groupBy("site", "page", "dst").agg(F.min("place").alias("place"))
    order = Window.partitionBy("site", "page").orderBy("place", "dst")
    return first.select("site", F.col("page").alias("src"), "dst", F.row_number().over(order).cast("long").alias("seq"))
