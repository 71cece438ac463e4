"""Bundle documents in ordered parts of bounded size, and reading them back across the borders of parts.

A site's document is the texts of its parts, one after another; every part but the last has exactly ``PART`` characters.  Where an entry (a page or a
resource) begins follows from running sums of lengths over sorted keys, so that no task sees a whole site, however large it is.  A reader learns from
one row for each part whether the part begins within a string, and at which depth; then each part is cut into entries by itself, and only the
entries that cross a border are put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import by_shuffle, saved
from .payload import CLOSE, OPEN, SHELL, json_string, page_entry, resource_entry, script_safe
from .rewrite import escape_attribute
from .spread import dealt_join, running_sum

#: Characters of a part, so at most four times as many bytes.
PART = 4 << 20
#: Parts in a file of a saved table: a reader holds them all at once.
A_FILE = 8
HEAD, PAGES, BETWEEN, RESOURCES, TAIL = range(5)


def _shell(named: DataFrame, generator: str) -> DataFrame:
    """(site, front, back): what stands around the payload of each ``named(site, title, lang)``."""
    lang = F.when(F.coalesce("lang", F.lit("")) != "", F.concat(F.lit(' lang="'), escape_attribute(F.col("lang")), F.lit('"'))).otherwise("")
    a, rest = SHELL[0].split("{lang}")
    b, rest = rest.split("{generator}")
    c, d = rest.split("{title}")
    front = F.concat(F.lit(a), lang, F.lit(b), escape_attribute(F.lit(generator)), F.lit(c), escape_attribute(F.coalesce("title", F.lit(""))), F.lit(d + OPEN))
    return named.select("site", front.alias("front"), F.lit(CLOSE + SHELL[1]).alias("back"))


def parts(sites: DataFrame, pages: DataFrame, resources: DataFrame, named: DataFrame | None = None, part: int = PART, version: int = 1, generator: str = "sitepack") -> DataFrame:
    """(site, part, text), parts numbered from 0, of ``sites(site, entry)``, ``pages(site, page, title, html)`` and ``resources(site, key, mime, is_text, value)``.

    With ``named(site, title, lang)`` whole documents, else the payloads alone.  Sites are distinct, and so are the pages and the keys of each; pages and
    resources of other sites are left out.  Entries are sorted by key: equal input gives equal bytes.
    """
    entries = saved(pages.select("site", F.lit(PAGES).alias("section"), F.col("page").alias("name"), page_entry().alias("text"))
                    .unionByName(resources.select("site", F.lit(RESOURCES).alias("section"), F.col("key").alias("name"), resource_entry().alias("text"))))
    has = [F.coalesce(F.max(F.col("section") == section), F.lit(False)).alias(name) for section, name in ((PAGES, "has_pages"), (RESOURCES, "has_resources"))]
    frame = sites.select("site", "entry").join(by_shuffle(entries.groupBy("site").agg(*has)), "site", "left")
    frame = frame.withColumns({"front": F.lit(""), "back": F.lit("")}) if named is None else frame.join(by_shuffle(_shell(named, generator)), "site", "left").fillna("", ["front", "back"])
    # Each entry begins with a sign of its own, "{" the first and "," the others, so that its length does not depend on which one it is.
    closed = lambda has: F.when(F.col(has), "}").otherwise("{}")
    head = F.concat("front", script_safe(F.concat(F.lit(f'{{"v":{version},"generator":'), json_string(F.lit(generator)), F.lit(',"entry":'), json_string(F.col("entry")), F.lit(',"pages":'))))
    fixed = ((HEAD, head), (BETWEEN, F.concat(closed("has_pages"), F.lit(',"resources":'))), (TAIL, F.concat(closed("has_resources"), F.lit("}"), F.col("back"))))
    fixed_rows = frame.select("site", F.explode(F.array(*(F.struct(F.lit(k).alias("section"), F.lit("").alias("name"), text.alias("text")) for k, text in fixed))).alias("f")).select("site", "f.*")
    inner = F.col("section").isin(PAGES, RESOURCES)
    rows = dealt_join(entries, sites.select("site"), ["site"], "left_semi").unionByName(fixed_rows)
    size = (F.length("text") + inner.cast("int")).cast("long")
    placed = saved(running_sum(rows.select("site", "section", "name", size.alias("size")), ["site", "section", "name"], F.col("size")))
    first = lambda k: F.min(F.when(F.col("section") == k, F.col("before")))
    starts = saved(placed.groupBy("site").agg(F.min("before").alias("_start"), first(PAGES).alias("_pages"), first(RESOURCES).alias("_resources")))
    sign = F.when(inner, F.when((F.col("before") == F.col("_pages")) | (F.col("before") == F.col("_resources")), "{").otherwise(",")).otherwise("")
    placed = dealt_join(placed, starts, ["site"]).select("site", "section", "name", "size", (F.col("before") - F.col("_start")).alias("at"), sign.alias("sign"))
    cut = rows.join(by_shuffle(placed), ["site", "section", "name"]).withColumn("text", F.concat("sign", "text"))
    cut = cut.withColumn("part", F.explode(F.sequence(F.floor(F.col("at") / part), F.floor((F.col("at") + F.col("size") - 1) / part))))
    low = F.greatest(F.col("part") * part - F.col("at"), F.lit(0))
    high = F.least((F.col("part") + 1) * part - F.col("at"), F.col("size"))
    pieces = cut.select("site", "part", F.struct((F.col("at") + low).alias("at"), F.substring("text", (low + 1).cast("int"), (high - low).cast("int")).alias("text")).alias("p"))
    return pieces.groupBy("site", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "").alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """(site, md5, chars) of the texts of ``parts``, site by site: a digest is sequential, but a task holds one part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site, state, chars = None, None, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([site]), pa.array([state.hexdigest()]), pa.array([chars], pa.int64())], ["site", "md5", "chars"])
        for b in batches:
            for k in range(b.num_rows):
                if state is None or b["site"][k].as_py() != site:
                    if state is not None:
                        yield done()
                    site, state, chars = b["site"][k].as_py(), hashlib.md5(), 0
                text = b["text"][k].as_py()
                state.update(text.encode())
                chars += len(text)
        if state is not None:
            yield done()

    return rows.select("site", "part", "text").repartition("site").sortWithinPartitions("site", "part").mapInArrow(run, "site string, md5 string, chars long")


# A part's text is read in one of these states; which one depends on the parts before it.
OUT, IN, ESCAPED = range(3)


def _quotes(data: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Whether each byte stands outside of strings (their opening quotes count as outside), and the state after the last."""
    if not len(data):
        return np.zeros(0, bool), state
    slash = data == 92
    # How many backslashes stand before each byte without a break; one more at the start if the part before ended on one that counts.
    at = np.arange(len(data))
    last_other = np.maximum.accumulate(np.where(slash, -1, at))
    run = np.where(slash, at - last_other, 0)
    if state == ESCAPED:
        run[last_other < 0] += 1
    before = np.concatenate(([1 if state == ESCAPED else 0], run[:-1]))
    real = (data == 34) & (before % 2 == 0)
    inside = (np.cumsum(real) - real + (state != OUT)) % 2 == 1
    ends_in = (int(real.sum()) + (state != OUT)) % 2 == 1
    return ~inside, (ESCAPED if run[-1] % 2 else IN) if ends_in else OUT


def _depths(data: np.ndarray, outside: np.ndarray) -> np.ndarray:
    step = np.zeros(len(data), np.int64)
    step[outside & (data == 123)] = 1
    step[outside & (data == 125)] = -1
    return np.cumsum(step)


def _payload_spans(rows: DataFrame) -> DataFrame:
    """(site, part, low, high): the characters (from 1, up to and without ``high``) of each part that belong to the payload, found from the parts' edges.

    The payload begins after the first OPEN, which may lie across borders, and ends at the next "<", of which it holds none.
    """
    n = len(OPEN)
    size = F.length("text")
    edge = saved(rows.select("site", "part", size.alias("size"), F.left("text", F.lit(n - 1)).alias("head"), F.right("text", F.lit(n - 1)).alias("tail"), F.instr("text", OPEN).alias("found")))
    order = Window.partitionBy("site").orderBy("part")
    start = F.sum("size").over(order) - F.col("size")
    # Where parts are shorter than OPEN it may span several of them.
    ahead = F.array_join(F.collect_list("head").over(order.rowsBetween(1, n)), "")
    across = F.instr(F.concat(F.col("tail"), F.left(ahead, F.lit(n - 1))), OPEN)
    begin = F.when(F.col("found") > 0, F.col("found") - 1).when(across > 0, F.col("size") - F.length("tail") + across - 1)
    edge = edge.select("site", "part", "size", start.alias("start"), (start + begin + n).alias("begin"))
    begins = saved(edge.groupBy("site").agg(F.min("begin").alias("begin")))
    low = F.greatest(F.col("begin") - F.col("start"), F.lit(0))
    inside = dealt_join(saved(edge.select("site", "part", "size", "start")), begins, ["site"]).filter("begin is not null").select("site", "part", (low + 1).cast("int").alias("low"))
    ends = dealt_join(rows, saved(inside), ["site", "part"]).select("site", "part", "low", F.length("text").alias("size"), F.expr("locate('<', text, low)").alias("sign"))
    ends = saved(ends)
    last = saved(ends.filter("sign > 0").groupBy("site").agg(F.min("part").alias("last")))
    spans = dealt_join(ends, last, ["site"], "left")
    return spans.filter("part <= coalesce(last, part)").select("site", "part", "low", F.when(F.col("sign") > 0, F.col("sign")).otherwise(F.col("size") + 1).alias("high")).filter("low < high")


def read_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages (site, page, title, html) and resources (site, key, mime, is_text, value) of documents in parts of any lengths ``(site, part, text)``."""
    spans = saved(_payload_spans(rows))
    texts = saved(dealt_join(rows.select("site", "part", "text"), spans, ["site", "part"]).select("site", "part", F.expr("substring(text, low, high - low)").alias("text")), A_FILE)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for text in b["text"].to_pylist():
                data = np.frombuffer(text.encode(), np.uint8)
                for state in (OUT, IN, ESCAPED):
                    outside, end = _quotes(data, state)
                    found.append((end, int(_depths(data, outside)[-1]) if len(data) else 0))
            flat = pa.array([x for pair in found for x in pair], pa.int64())
            yield pa.RecordBatch.from_arrays([b["site"], b["part"], pa.FixedSizeListArray.from_arrays(flat, 6).cast(pa.list_(pa.int64()))], ["site", "part", "step"])

    def follow(of_site: pd.DataFrame) -> pd.DataFrame:
        state, depth, states, depths = OUT, 0, [], []
        of_site = of_site.sort_values("part")
        for step in of_site["step"]:
            states.append(state)
            depths.append(depth)
            state, depth = step[2 * state], depth + step[2 * state + 1]
        return pd.DataFrame({"site": of_site["site"], "part": of_site["part"], "state": states, "depth": depths})

    # One row of a few numbers for each part of at most some megabytes: a site's rows are few.
    steps = saved(texts.mapInArrow(look, "site string, part long, step array<long>"))
    known = saved(steps.groupBy("site").applyInPandas(follow, "site string, part long, state int, depth long"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of each part: number 0 goes on with what came before, others begin an entry, or what is none (``entry`` false)."""
        for b in batches:
            for site, part, text, state, depth in zip(*(b[c].to_pylist() for c in ("site", "part", "text", "state", "depth"))):
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                outside, _ = _quotes(data, state)
                depths = depth + _depths(data, outside)
                opens = outside & (data == 123) & (depths == 2)
                cuts = np.flatnonzero(opens | (outside & (data == 44) & (depths == 2)) | (outside & (data == 125) & (depths == 1)))
                at = [0, *(cuts + 1).tolist(), len(raw)]
                pieces = [raw[low : max(low, high - (k + 2 < len(at)))] for k, (low, high) in enumerate(zip(at, at[1:]))]
                entry = [None, *(depths[cuts] == 2).tolist()]
                count = len(pieces)
                yield pa.RecordBatch.from_arrays([pa.array([site] * count), pa.array([part] * count, pa.int64()), pa.array(range(count), pa.int32()), pa.array([k == count - 1 for k in range(count)]), pa.array(entry, pa.bool_()), pa.array([p.decode() for p in pieces])],
                                                 ["site", "part", "number", "last", "entry", "text"])

    read = dealt_join(texts, known, ["site", "part"]).select("site", "part", "text", "state", "depth")
    pieces = saved(read.mapInArrow(cut, "site string, part long, number int, last boolean, entry boolean, text string"))
    # What lies within one part is whole; pieces at borders belong to the last piece that begins something, in their part or before it.
    edge = pieces.filter("number = 0 or last")
    begun = edge.filter("last").select("site", "part", F.when(F.col("number") > 0, F.struct("part", "number", "entry")).alias("begun"))
    begun = begun.withColumn("before", F.last("begun", True).over(Window.partitionBy("site").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("site", "part", "before")
    first = edge.filter("number = 0").join(by_shuffle(begun), ["site", "part"]).filter("before is not null").select("site", "before", "part", "number", "text")
    later = edge.filter("number > 0").select("site", F.struct("part", "number", "entry").alias("before"), "part", "number", "text")
    crossing = first.unionByName(later).filter("before.entry").groupBy("site", "before").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "number", "text"))), lambda p: p["text"]), "").alias("text"))
    whole = pieces.filter("number > 0 and not last and entry").select("site", "text")
    entries = whole.unionByName(crossing.select("site", "text")).filter("text != ''")
    each = entries.select("site", F.explode(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,string>")).alias("name", "raw"))
    page = F.col("raw").startswith('{"title":')
    pages = each.filter(page).withColumn("o", F.from_json("raw", "title string, html string")).select("site", F.col("name").alias("page"), "o.title", "o.html")
    stored = each.filter(~page).withColumn("o", F.when(F.col("raw").startswith("{"), F.from_json("raw", "mime string, text string")))
    mime = F.coalesce("o.mime", F.regexp_extract("raw", r"^data:([^;,]*)", 1))
    return pages, stored.select("site", F.col("name").alias("key"), mime.alias("mime"), F.col("o").isNotNull().alias("is_text"), F.coalesce("o.text", "raw").alias("value"))
