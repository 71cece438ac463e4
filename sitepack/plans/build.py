"""The whole job: files of many sites become bundles, with diagnostics, a manifest and a summary."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import charset, paths
from ..operators import extract, graph, parts, payload, report, resolve, rewrite, sheets, store
from ..operators.graph import by_shuffle, counted
from ..operators.spread import dealt_join
from ..sources import io

STYLES = ("style_text", "style_attr")


class Build(NamedTuple):
    pages: DataFrame  # site, page, ord, title, html
    resources: DataFrame  # site, key, mime, is_text, value
    bundles: DataFrame  # site, part, text: the document of a site is its parts' texts one after another
    errors: DataFrame  # site, ref, code: sites that are not built, and why
    diagnostics: DataFrame  # site, page, seq, ref, level, code, message
    dangling: DataFrame  # site, page, kind, name
    manifest: DataFrame  # site, rel
    summary: DataFrame  # a row for each site


def _resolved(rows: DataFrame, files: DataFrame, dirs: DataFrame, excludes: Iterable[str] | DataFrame, external: str | None = None) -> DataFrame:
    return graph.saved(resolve.look_up(graph.saved(resolve.resolve(rows, base_external=external)), files, excludes, dirs))


def _texts(files: DataFrame, wanted: DataFrame, sniff: Column | None = None) -> DataFrame:
    """``wanted(site, rel, fallback)`` with text and charset: by mark, by what the file declares, else by the fallback."""
    rows = files.select("site", "rel", "content").join(counted(graph.saved(wanted)), ["site", "rel"])
    return charset.decode(rows, [*([] if sniff is None else [sniff]), F.col("fallback")]).drop("content", "fallback")


def _options(sites: DataFrame, **defaults) -> DataFrame:
    """``sites`` with a row for each site and every option as a column: what a site leaves null, or has no column for, is the default."""
    value = lambda name, kind: F.coalesce(F.col(name).cast(kind) if name in sites.columns else F.lit(None).cast(kind), F.lit(defaults[name]).cast(kind)).alias(name)
    entry = F.trim(F.coalesce("entry", F.lit("")))
    kinds = {"max_resource_size": "long", "single_page": "boolean", "default_charset": "string"}
    rows = sites.filter("site is not null").select("site", F.when(entry == "", "index.html").otherwise(entry).alias("entry"), *(value(n, k) for n, k in kinds.items()))
    return rows.groupBy("site").agg(F.min(F.struct("entry", *kinds)).alias("o")).select("site", "o.*")


def checked_sites(files: DataFrame, sites: DataFrame, excludes: Iterable[str] | DataFrame = (), max_resource_size: int = 0, single_page: bool = False, default_charset: str = "utf-8"):
    """What ``build`` begins with: the sites that can be built, with their options and the path of their entry, and errors (site, ref, code).

    Also the files of all these sites, their names and directories, and the patterns as ``look_up`` takes them.  An entry is resolved like a reference
    from the site's root; it must be a file that can be read.
    """
    if isinstance(excludes, DataFrame):
        excludes, malformed = paths.site_patterns(excludes)
        excludes = graph.saved(excludes)
    else:
        excludes, malformed = list(excludes), sites.select("site", F.lit("").alias("pattern")).limit(0)
    options = graph.saved(_options(sites, max_resource_size=max_resource_size, single_page=single_page, default_charset=default_charset))
    files = dealt_join(files, options.select("site"), ["site"], "left_semi")
    names = graph.saved(resolve.inventory(files))
    dirs = graph.saved(resolve.directories(names))
    bad = malformed.select("site", F.col("pattern").alias("ref"), F.lit("exclude_malformed").alias("code"))
    asked = _resolved(options.select("site", F.col("entry").alias("raw"), F.lit("").alias("base")), names, dirs, excludes)
    unread = files.filter("content is null").select("site", "rel", F.lit(True).alias("_unread"))
    asked = asked.join(by_shuffle(unread), ["site", "rel"], "left").join(by_shuffle(options.select("site").join(by_shuffle(bad), "site", "left_semi").withColumn("_bad", F.lit(True))), "site", "left")
    kind = F.when(F.col("kind") != "file", F.col("kind")).when(F.col("_unread"), "unreadable")
    asked = graph.saved(asked.select("site", "raw", "rel", F.concat(F.lit("entry_"), kind).alias("code"), "_bad"))
    errors = bad.join(by_shuffle(options), "site", "left_semi").select("site", "ref", "code").unionByName(asked.filter("code is not null").select("site", F.col("raw").alias("ref"), "code"))
    good = asked.filter("code is null and _bad is null").select("site", F.col("rel").alias("_entry"))
    good = graph.saved(options.join(by_shuffle(good), "site").withColumn("entry", F.col("_entry")).drop("_entry"))
    return good, graph.saved(errors), dealt_join(files, good.select("site"), ["site"], "left_semi"), names, dirs, excludes


def _sheets(files: DataFrame, first: DataFrame, find) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (site, page, text) of the sheets ``first(site, rel, fallback)`` and all that they import, their resolved references, and their charsets (site, page, charset).

    A round reads what is new; the first importer's charset is the fallback of an imported sheet.
    """
    todo, texts, refs, sets = first, [], [], []
    while True:
        now = _texts(files, todo, charset.sniff_css(F.col("content")))
        now = graph.saved(now.select("site", F.col("rel").alias("page"), charset.strip_css_charset(F.col("text")).alias("text"), "charset"))
        if texts and now.isEmpty():
            return tuple(reduce(DataFrame.unionByName, some) for some in (texts, refs, sets))
        texts.append(now.drop("charset"))
        sets.append(now.select("site", "page", "charset"))
        refs.append(find(sheets.sheet_references(now).withColumn("base", F.col("page"))))
        seen = reduce(DataFrame.unionByName, texts).select("site", F.col("page").alias("rel"))
        more = refs[-1].filter("kind = 'file' and role = 'import'").join(by_shuffle(seen), ["site", "rel"], "left_anti").join(by_shuffle(now.select("site", "page", "charset")), ["site", "page"])
        todo = extract.first_referrers(more, ["site", "rel"], ["page", "seq"]).select("site", "rel", F.col("charset").alias("fallback"))


def build(files: DataFrame, sites: DataFrame, max_resource_size: int = 0, excludes: Iterable[str] | DataFrame = (), single_page: bool = False, default_charset: str = "utf-8", part: int = parts.PART, frame_budget: int = 64 << 20, key: int = store.KEY) -> Build:
    """Bundles of ``files(site, rel, content)`` from the entries ``sites(site, entry)``.

    Pages are those reached by links (also links inside embedded frames); what they and their frames use is stored once; other files are
    left out.  Files over ``max_resource_size`` bytes (0: no limit) stay references.  Columns max_resource_size, single_page and default_charset of
    ``sites`` are options of a site of its own, and ``excludes`` may be a table (site, pattern).  An entry is resolved like a reference (empty: index.html);
    sites whose entry is no readable file, or that have a malformed pattern, are not built: they are rows of ``errors``, beside which all others
    are built.  A page that with its frames would exceed ``frame_budget`` bytes, found before any is embedded, keeps its frames as references.  Keys of
    resources have ``key`` hex digits, more where they collide.  A page with null content is unreadable: it is seen, but left out and reported.  Of a site given twice the first entry in order counts.
    """
    sites, errors, files, names, dirs, excludes = checked_sites(files, sites, excludes, max_resource_size, single_page, default_charset)
    single_page = graph.saved(sites.filter("single_page").select("site"))
    sized = files.select("site", "rel", F.length("content").cast("long").alias("size"))
    over = counted(graph.saved(store.within_limit(sized, sites)[1].select("site", "rel")))  # for the right sides of joins, as are the next ones

    html = files.filter(paths.is_html(F.col("rel"))).select("site", F.col("rel").alias("page"), "content")
    entry_page = counted(graph.saved(sites.select("site", F.col("entry").alias("page")).filter(~paths.is_html(F.col("entry")))))  # an entry is a page whatever its name
    html = html.unionByName(files.withColumnRenamed("rel", "page").join(entry_page, ["site", "page"]).select("site", "page", "content"))
    html = dealt_join(html, graph.saved(sites.select("site", "default_charset")), ["site"])
    captured = graph.saved(charset.decode(html, [charset.sniff_html(F.col("content")), F.col("default_charset")]).select("site", "page", "text", "charset"))
    pages, unreadable = captured.filter("text is not null"), captured.filter("text is null").select("site", "page")
    tags = graph.saved(extract.tags(pages.select("site", "page", "text")))
    heads = graph.saved(extract.page_heads(tags, ["site", "page"]))
    based = extract.with_base(extract.references(tags), heads, ["site", "page"], "page")
    inline = graph.saved(based.filter(F.col("role").isin(*STYLES)))
    refs = _resolved(based.filter(~F.col("role").isin(*STYLES)), names, dirs, excludes, "base_external")

    # Frames, then the crawl through them.
    framed = refs.filter("role = 'frame' and kind = 'file' and is_html").join(by_shuffle(pages.select("site", F.col("page").alias("rel"))), ["site", "rel"], "left_semi")
    frames = framed.select("site", F.col("page").alias("src"), F.col("rel").alias("dst"), F.col("seq").cast("long").alias("seq"))
    text = F.col("text")
    own_size = pages.select("site", "page", F.octet_length(text).alias("bytes"), (F.octet_length(rewrite.escape_attribute(text)) - F.octet_length(text)).alias("escaped"), F.regexp_count(text, F.lit("[&\"<>]")).alias("signs"))
    big = counted(graph.saved(graph.frame_sizes(frames, own_size).filter((F.col("bytes") > frame_budget) & (F.col("copies") > 1)).select("site", F.col("page").alias("src"))))
    frames = graph.saved(frames.join(big, ["site", "src"], "left_anti"))
    embedded, refused = graph.closure(frames, pages.select("site", "page"))
    edges = graph.link_edges(refs, single_page).withColumn("seq", F.expr("seq div 1000"))
    met = graph.saved(graph.crawl(graph.links_through_frames(edges, embedded), sites))
    reached, skipped = graph.readable_pages(met, unreadable)
    reached = graph.saved(reached)
    roots = reached.select("site", F.col("page").alias("root"))
    embedded = graph.saved(embedded.join(by_shuffle(roots), ["site", "root"], "left_semi"))
    used = graph.saved(embedded.select("site", "page").distinct())
    here = lambda rows: rows.join(by_shuffle(used), ["site", "page"], "left_semi")
    refs, tags, inline = graph.saved(here(refs)), here(tags), graph.saved(here(inline))

    # Style sheets and styles within pages; these are sheets of their own, named by page, place and attribute.
    find = lambda rows: _resolved(rows.withColumnRenamed("kind", "role"), names, dirs, excludes)
    own = F.concat_ws("\n", "page", "seq", "role")
    blocks = graph.saved(inline.select("site", own.alias("page"), F.col("raw").alias("text"), "base", F.col("page").alias("_page"), "seq", "attr", "role"))
    scanned = [sheets.sheet_references(blocks.filter(F.col("role") == role), imports=role == "style_text") for role in STYLES]
    inner = find(reduce(DataFrame.unionByName, scanned).join(by_shuffle(blocks.select("site", "page", "base")), ["site", "page"]))
    fits = lambda rows: rows.filter("kind = 'file'").join(over, ["site", "rel"], "left_anti")
    of_page = pages.select("site", "page", F.col("charset").alias("fallback"))
    ordered = lambda rows: extract.first_referrers(rows.join(by_shuffle(of_page), ["site", "page"]), ["site", "rel"], ["page", "seq"]).select("site", "rel", "fallback")
    imported = fits(inner.filter("role = 'import'")).withColumn("page", F.element_at(F.split("page", "\n"), 1))
    asked = fits(refs.filter("role = 'style'")).select("site", "rel", "page", "seq").unionByName(imported.select("site", "rel", "page", "seq"))
    css, css_refs, css_sets = _sheets(files.join(over, ["site", "rel"], "left_anti"), ordered(asked), find)
    css, css_refs = graph.saved(css), graph.saved(css_refs)

    # Binary files that anything used refers to, and scripts.
    roles = F.col("role").isin("resource", "url") | (F.col("role").isin("frame", "link") & ~F.col("is_html"))
    want = reduce(DataFrame.unionByName, (fits(r.filter(roles)).select("site", "rel") for r in (refs, inner, css_refs))).distinct()
    found = files.select("site", "rel", "content").join(by_shuffle(want), ["site", "rel"])
    hashed = graph.saved(store.add_hashes(found.select("site", F.lit(0).alias("ord"), "rel", resolve.mime_type(F.col("rel"), F.col("content")).alias("mime"), F.lit(False).alias("is_text"), F.col("content").alias("data"))))
    distinct = graph.saved(store.assign_keys(store.deduplicate(hashed), key).select("site", "hash", "key", "size", "first_rel", "mime"))
    binaries = graph.saved(hashed.select("site", "rel", "hash").join(by_shuffle(distinct.select("site", "hash", "key")), ["site", "hash"]).select("site", "rel", "key"))
    scripts = _texts(files, ordered(fits(refs.filter("role = 'script'")).select("site", "rel", "page", "seq")))
    scripts, known = store.key_texts(scripts.select("site", "rel", "text", "charset"), "text/javascript", distinct.select("site", "hash", "key"), key)
    scripts = graph.saved(scripts)

    # Sheets leaves first; an import that would close a circle stays a reference.
    imports = css_refs.filter("kind = 'file' and role = 'import'").join(by_shuffle(css.select("site", F.col("page").alias("rel"))), ["site", "rel"], "left_semi")
    imports = imports.groupBy("site", F.col("page").alias("src"), F.col("rel").alias("dst")).agg(F.min("seq").alias("seq"))
    starts = asked.join(by_shuffle(reached.select("site", "page", "ord")), ["site", "page"], "left").groupBy("site", F.col("rel").alias("page")).agg(F.min(F.struct(F.coalesce("ord", F.lit(1 << 40)).alias("ord"), "seq")).alias("_at"))
    sound, cut = sheets.import_closure(imports, starts.select("site", "page", "_at.ord"))
    typed = css_refs.select("site", "page", "raw", F.col("role").alias("kind"), "rel", "fragment")
    styled = graph.saved(sheets.rewrite_bottom_up(css, typed, sound, binaries, known, key))

    # Changes of every page that is used.
    keys = binaries.select("site", "rel", F.lit(False).alias("is_text"), "key").unionByName(scripts.select("site", "rel", F.lit(True).alias("is_text"), "key")).unionByName(styled.select("site", F.col("page").alias("rel"), F.lit(True).alias("is_text"), "key"))
    keys = graph.saved(keys)
    tokens = inner.filter("kind = 'file'").withColumn("is_text", F.col("role") == "import").join(by_shuffle(keys), ["site", "rel", "is_text"])
    new = sheets.splice(blocks.select("site", "page", "text"), tokens.select("site", "page", "raw", store.placeholder(F.col("key"), F.col("fragment")).alias("new")))
    new = new.join(by_shuffle(blocks.select("site", "page", "_page", "seq", "attr", "role")), ["site", "page"]).join(by_shuffle(tokens.select("site", "page").distinct()), ["site", "page"], "left_semi")
    styles = new.select("site", F.col("_page").alias("page"), "seq", "attr", F.when(F.col("role") == "style_attr", "set").otherwise("body").alias("op"), F.col("text").alias("value"))
    uses = fits(refs.filter("role = 'sprite'"))
    drawn = uses.select("site", "rel").distinct().withColumn("fallback", F.lit("utf-8"))
    sprites, bad_sprites = rewrite.sprite_changes(uses, _texts(files, drawn), tags)
    changes = reduce(DataFrame.unionByName, (rewrite.link_changes(refs, tags, keys, single_page), rewrite.resource_changes(refs, keys, tags), rewrite.removal_changes(tags), rewrite.head_changes(tags, heads), rewrite.refresh_changes(refs, tags, single_page), sprites, styles))
    done = rewrite.embed_frames(pages, embedded, graph.saved(changes)).join(by_shuffle(reached.select("site", "page", "ord")), ["site", "page"]).join(by_shuffle(heads.select("site", "page", "title")), ["site", "page"], "left")
    done = graph.saved(done.select("site", "page", "ord", F.coalesce("title", F.lit("")).alias("title"), F.col("text").alias("html")))

    # What is stored, once a content.
    texts = scripts.select("site", "key", F.lit("text/javascript").alias("mime"), "text").unionByName(styled.select("site", "key", F.lit("text/css").alias("mime"), "text")).dropDuplicates(["site", "key"])
    one = hashed.join(by_shuffle(distinct.select("site", F.col("first_rel").alias("rel"), "key")), ["site", "rel"])
    stored = one.select("site", "key", "mime", F.lit(False).alias("is_text"), store.base64_url(F.col("mime"), F.col("data")).alias("value"), "size")
    stored = graph.saved(stored.unionByName(texts.select("site", "key", "mime", F.lit(True).alias("is_text"), F.col("text").alias("value"), F.octet_length("text").cast("long").alias("size"))))

    named = payload.titles(sites, heads)
    bundles = graph.saved(parts.parts(sites, done, stored, named, part=part), parts.A_FILE)

    place = lambda rows, code: rows.select("site", "page", "seq", F.col("raw").alias("ref"), F.lit(code).alias("code"))
    loops = refused.join(by_shuffle(roots), ["site", "root"], "left_semi").select("site", F.col("root").alias("page"), F.element_at("seqs", -1).alias("seq"), F.col("page").alias("ref"), "code")
    circles = cut.select("site", F.col("src").alias("page"), F.lit(0).alias("seq"), F.col("dst").alias("ref"), F.lit("circular").alias("code"))
    # A limit is met by what would be embedded, wherever it is asked for; forms and links to pages ask for nothing.
    embeds = F.col("role").isin("resource", "style", "script", "sprite", "import", "url") | (F.col("role").isin("frame", "link") & ~F.col("is_html"))
    own_page = F.element_at(F.split("page", "\n"), 1)
    too_large = reduce(DataFrame.unionByName, (r.filter(embeds & (F.col("kind") == "file")).join(over, ["site", "rel"], "left_semi").select("site", own_page.alias("page"), "seq", "raw", "rel") for r in (refs, inner, css_refs)))
    lost = [r.filter(F.col("kind").isin("missing", "outside", "invalid", "excluded")).withColumn("page", F.element_at(F.split("page", "\n"), 1)).select("site", "page", "seq", F.col("raw").alias("ref"), F.col("kind").alias("code")) for r in (inner, css_refs)]
    others = tags.filter((F.col("tag") == "meta") & (F.lower(F.trim(F.col("attrs")["http-equiv"])) == "content-security-policy")).select("site", "page", "seq", F.lit("").alias("ref"), F.lit("csp").alias("code"))
    left_out = framed.join(big.withColumnRenamed("src", "page"), ["site", "page"], "left_semi").join(by_shuffle(used), ["site", "page"], "left_semi").select("site", "page", "seq", F.col("raw").alias("ref"), F.lit("frames_too_large").alias("code"))
    modules = extract.module_imports(tags, refs, scripts.select("site", "rel", "text"))
    based_on = extract.base_problems(here(heads), ["site", "page"], "page").withColumn("seq", F.lit(0))
    turned = rewrite.refreshed(refs, single_page).select("site", "page", "seq", F.col("raw").alias("ref"), F.lit("refresh").alias("code"))
    sets = here(pages.select("site", "page", "charset")).unionByName(css_sets).unionByName(scripts.select("site", F.col("rel").alias("page"), "charset"))
    decoded = sets.filter("charset != 'utf-8'").select("site", "page", F.lit(0).alias("seq"), F.lit("").alias("ref"), F.lit("decoded").alias("code"))
    diagnostics = report.diagnostics(refs, loops, circles, place(too_large, "too_large"), bad_sprites.select("site", "page", "seq", F.col("raw").alias("ref"), "code"), others, modules, skipped, based_on, turned, decoded, left_out, *lost)
    read = [used.select("site", F.col("page").alias("rel")), want, drawn, scripts, css.select("site", F.col("page").alias("rel")), too_large]
    totals = store.totals(stored.select("site", "size"))
    summary = report.summary(sites, reached, named, totals, bundles, io.manifest(*read))
    return Build(done, stored.drop("size"), bundles, errors, diagnostics, payload.integrity(done, stored, key), io.manifest(*read), summary)
