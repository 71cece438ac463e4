"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("op3_ngram_join", """
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) END) AS s FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)),
    r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
    SELECT r.id AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id""")
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"), "text", 3, 90, 100).select("doc_id", "n_shingles", "component_id")


def crc_mod(column: str, n: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op5_decontaminate", """
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
    i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
    ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM d),
    si AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM i),
    n AS (SELECT item_id, count(*) AS item_shingles FROM si GROUP BY item_id)
    SELECT doc_id, item_id, count(*) AS shared, item_shingles FROM ds JOIN si USING (s) JOIN n USING (item_id)
    GROUP BY doc_id, item_id, item_shingles HAVING count(*) * 100 >= item_shingles * 80""")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_line_dedup", """
    WITH p AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
    t AS (SELECT source, count(*) AS pages FROM p GROUP BY source),
    l AS (SELECT source, unnest(list_distinct(list_filter(list_transform(ls, lambda x: trim(x)), lambda x: x <> ''))) AS line FROM p),
    c AS (SELECT source, line FROM l JOIN t USING (source) GROUP BY source, line, pages HAVING count(*) >= 2 AND count(*) > 0.1::DOUBLE * pages),
    b AS (SELECT source, list(line) AS boiler FROM c GROUP BY source)
    SELECT doc_id, coalesce(len(ls), 0) AS lines_in,
           coalesce(len(ls) - len(list_filter(ls, lambda x: trim(x) = '' OR NOT list_contains(coalesce(boiler, []), trim(x)))), 0) AS lines_dropped,
           array_to_string(list_filter(ls, lambda x: trim(x) = '' OR NOT list_contains(coalesce(boiler, []), trim(x))), chr(10)) AS text
    FROM p LEFT JOIN b USING (source)""")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_boilerplate

    return drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "lines_in", "lines_dropped", "text")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.filter(crc_mod("doc_id", 4) != 2))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p)
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (((('0x' || substr(x, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31)))::BIGINT, 1)), '') AS payload_digest,
        CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM d""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_records, write_archives

    index = write_archives(table(spark, sf_dir, "pages"))
    return read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_nearest")
def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import saved
    from .quality import document_statistics, learn, score

    stats = saved(document_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")))
    model = learn(stats, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 3) != 1))
    return score(stats, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_language_model")
def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)


@query("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import drop_repeats

    cut = drop_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s.stop - s.start)
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# The table of CRC-32 by the polynomial's rule, for DuckDB, which has no such function.
_CRC_TABLE = []
for _k in range(256):
    for _ in range(8):
        _k = _k >> 1 ^ (0xEDB88320 if _k & 1 else 0)
    _CRC_TABLE.append(_k)


def crc_sql(text: str) -> str:
    """DuckDB's expression for the unsigned CRC-32 of a string's UTF-8 bytes."""
    digits = f"hex(encode({text}))"
    every = f"list_transform(range(0, len({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {every}), lambda c, b: xor(c >> 8, ({_CRC_TABLE}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


@query("op11_mixing", """
    WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
        ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[1:15])::BIGINT AS place FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
    f AS (SELECT 0 AS r, 0::BIGINT AS c, sum(w)::BIGINT AS free, sum(source_size)::BIGINT AS t FROM s
        UNION ALL SELECT r + 1, sum(CASE WHEN w * (t - c)::DOUBLE / free > 3 * source_size THEN 3 * source_size ELSE 0 END)::BIGINT, sum(CASE WHEN w * (t - c)::DOUBLE / free > 3 * source_size THEN 0 ELSE w END)::BIGINT, t
        FROM f, s WHERE r < 60 AND free > 0 GROUP BY r, c, free, t),
    e AS (SELECT * FROM f ORDER BY r DESC LIMIT 1),
    a AS (SELECT source, source_size, least(CASE WHEN free > 0 THEN w * (t - c)::DOUBLE / free ELSE 3.0 * source_size END, 3.0 * source_size)::DOUBLE AS target FROM s, e),
    p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM a),
    q AS (SELECT *, target - passes * source_size AS rest FROM p),
    g AS (SELECT source, place, sum(size)::BIGINT AS s, sum(sum(size)) OVER (PARTITION BY source ORDER BY place)::BIGINT AS upto FROM d GROUP BY source, place),
    u AS (SELECT q.source, max(CASE WHEN upto - rest <= rest - (upto - s) THEN place + 1 ELSE place END) AS until FROM q JOIN g ON g.source IS NOT DISTINCT FROM q.source AND s > 0 AND rest > 0 AND upto - s < rest AND rest <= upto GROUP BY q.source)
    SELECT doc_id, d.size, q.source_size, q.target, d.size * (q.passes + CASE WHEN d.place < coalesce(u.until, 0) THEN 1 ELSE 0 END)::BIGINT AS taken
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN u ON d.source IS NOT DISTINCT FROM u.source""")
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import saved
    from .mixing import cyclic_weights, measured, taken, thresholds

    rows = saved(measured(table(spark, sf_dir, "documents")))
    return taken(rows, thresholds(rows, cyclic_weights(rows))).select("doc_id", "size", "source_size", "target", "taken")


@query("op12_spelling", f"""
    WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
    k AS (SELECT d, run, count(*) AS times FROM r WHERE length(run) >= 5 GROUP BY d, run),
    h AS (SELECT run, times, {crc_sql("d || ':' || run")} AS h FROM k),
    w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(times)::BIGINT AS n FROM h GROUP BY 1 HAVING sum(times) >= 3 AND length(word) >= 5),
    x AS (SELECT DISTINCT word, n, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
    o AS (SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
        UNION SELECT x.word, x.n, w.word, w.n FROM x JOIN w ON w.word = x.cut UNION SELECT w.word, w.n, x.word, x.n FROM x JOIN w ON w.word = x.cut),
    m AS (SELECT a, count(*) AS n_near, max(bn) AS top FROM o GROUP BY a),
    b AS (SELECT m.a, m.n_near, m.top, min(o.b) AS best FROM m JOIN o ON o.a = m.a AND o.bn = m.top GROUP BY ALL),
    f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN best END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n FROM w LEFT JOIN b ON b.a = w.word),
    t AS (SELECT word, word AS root, form FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.form)
    SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word AND t.form IS NULL""")
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import count_words, group_variants, letter_runs

    runs = letter_runs(table(spark, sf_dir, "documents")).filter(F.length("run") >= 5)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.left("run", at), F.substring("run", at + 2, F.length("run")))
    changed = runs.withColumn("h", h).select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run")).alias("run"))
    return group_variants(count_words(changed)).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_prefix_trie", f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    k AS (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS key, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words FROM t),
    o AS (SELECT conv_id, key, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS pos FROM k),
    c AS (SELECT conv_id, {crc_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
    r AS (SELECT c.conv_id, 0 AS part, o.pos, o.key, o.words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.pos < c.h
        UNION ALL SELECT c.conv_id, 1, o.pos, o.key, o.words FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos >= c.h),
    q AS (SELECT conv_id, words, row_number() OVER w AS depth, string_agg(key, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
    p AS (SELECT conv_id, depth, path, words FROM q UNION ALL SELECT conv_id, 0, '', 0 FROM c),
    e AS (SELECT max_by(path, depth) AS path, conv_id FROM p GROUP BY conv_id),
    s AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM e GROUP BY path),
    n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY path, depth),
    ch AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
    v AS (SELECT n.path, n.depth, (n.n_convs - 1) * n.words AS own, CASE WHEN ch.path IS NULL THEN 1 ELSE 0 END AS leaf FROM n LEFT JOIN ch USING (path)),
    z AS (SELECT left(path, 32 * up) AS path, sum(leaf)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM (SELECT path, own, leaf, unnest(range(0, depth + 1)) AS up FROM v) GROUP BY 1)
    SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n_children, 0) AS n_children, z.n_leaves, z.saved_tokens, coalesce(s.sha, sha256('')) AS ends_sha256
    FROM n JOIN z USING (path) LEFT JOIN ch USING (path) LEFT JOIN s USING (path) LEFT JOIN n u ON n.depth > 0 AND u.path = left(n.path, greatest(length(n.path) - 32, 0))""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are rebuilt first: each begins with up to three turns of the first of its twenty, as its own checksum says."""
    from .common import saved
    from .prefix_trie import conversations, paths, prefix_trie

    own = saved(conversations(table(spark, sf_dir, "conversations"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % 20)
    heads = own.filter("conv_id = base").select("base", F.slice("turns", 1, 3).alias("head"))
    h = F.col("h")
    rebuilt = F.concat(F.slice(F.coalesce("head", F.array().cast(own.schema["turns"].dataType)), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0))))
    rows = own.join(heads, "base", "left").withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int"))
    return prefix_trie(paths(rows, rebuilt))
