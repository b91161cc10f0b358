"""Document pipeline queries (I3-I5 and D rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import documents as D
from evigraph.operators.tagging import dictionary_tagger, gazetteer, highlight_entities
from evigraph.queries.checksql import chunks_sql, sections_sql
from evigraph.queries.registry import query
from evigraph.sources.html import html_blocks, title_from_url
from evigraph.sources.star import documents, files, node_names, table

LINES = "\n"  # the test documents have one block per line
# Headings of the invented texts are told apart by their first letter.
LETTER_PATTERNS = {"abstract": "^[a-f]", "methods": "^[g-m]", "results": "^[n-s]", "conclusion": "^[t-z]"}
TAG_TYPES = ["material", "process", "condition", "property", "topic", "team", "conclusion"]
TAG_SQL = ", ".join(f"'{t}'" for t in TAG_TYPES)


def docs(spark, d):
    return D.with_blocks(documents(spark, d), LINES)


def doc_files(spark, d):
    """Files with blocks; the articles folder of this corpus is the ``en`` one."""
    return D.with_blocks(files(spark, d), LINES)


@query("text_blocks", "blocks", "SELECT doc_id, ord, location, text FROM blocks")
def _(spark, d):
    return D.text_blocks(documents(spark, d), LINES).select("doc_id", "ord", "location", "text")


@query("table_blocks", "blocks", "SELECT doc_id, ord, length(text) AS n FROM blocks WHERE kind = 'table'")
def _(spark, d):
    return D.text_blocks(documents(spark, d), LINES).filter("kind = 'table'").select("doc_id", "ord", F.length("text").cast("long").alias("n"))


@query("html_blocks")
def _(spark, d):
    return html_blocks(table(spark, d, "pages"))


@query("html_title_fallback", "", "SELECT page_id, CASE WHEN t <> '' THEN t ELSE url END AS title FROM (SELECT page_id, url, trim(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/') AS t FROM pages)")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", title_from_url(F.col("url")).alias("title"))


@query("heading_flag", "blocks", "SELECT doc_id, ord, length(text) < 100 AND right(text, 1) NOT IN ('.', ':', ';', ',') AS heading FROM blocks")
def _(spark, d):
    b = D.text_blocks(documents(spark, d), LINES)
    return b.select("doc_id", "ord", D.is_heading(F.col("kind"), F.col("text")).alias("heading"))


@query("key_sections", "blocks", f"WITH {sections_sql(LETTER_PATTERNS, 300)} SELECT doc_id, section, ord, kind, text FROM sect")
def _(spark, d):
    return D.key_sections(docs(spark, d), LETTER_PATTERNS, 300).select("doc_id", "section", "ord", "kind", "text")


@query("section_fallback", "blocks", f"WITH {sections_sql(D.SECTION_PATTERNS, D.SECTION_CHARS)} SELECT doc_id, section, ord, location FROM sect")
def _(spark, d):
    return D.key_sections(docs(spark, d)).select("doc_id", "section", "ord", "location")


@query("chunk_blocks", "blocks", f"WITH {chunks_sql('blocks')} SELECT chunk_id, doc_id, chunk_no, kind, language, locations, sha256(text) AS text_hash FROM chunks")
def _(spark, d):
    c = D.chunk_documents(docs(spark, d))
    return c.select("chunk_id", "doc_id", "chunk_no", "kind", "language", F.array_join("locations", ", ").alias("locations"), "text_hash")


@query(
    "chunk_blocks_mixed", "blocks",
    f"WITH cyr AS (SELECT doc_id, ord, kind, location, CASE WHEN ord % 3 = 0 THEN translate(text, 'aeinorst', 'аеинорст') ELSE translate(text, 'e', 'е') END AS text FROM blocks), {chunks_sql('cyr')} SELECT chunk_id, kind, language, locations, sha256(text) AS text_hash FROM chunks",
)
def _(spark, d):
    """Blocks that alternate between scripts: language changes cut chunks, mixed blocks do not."""
    cyr = docs(spark, d).withColumn(
        "blocks",
        F.transform(
            "blocks",
            lambda b: b.withField(
                "text",
                F.when(b["ord"] % 3 == 0, F.translate(b["text"], "aeinorst", "аеинорст")).otherwise(F.translate(b["text"], "e", "е")),
            ),
        ),
    )
    return D.chunk_documents(cyr).select("chunk_id", "kind", "language", F.array_join("locations", ", ").alias("locations"), "text_hash")


@query(
    "overlap_chunks", "",
    """WITH s AS (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 201, 0), 800)) AS start FROM documents WHERE length(text) > 0)
    SELECT doc_id, CAST(start / 800 AS BIGINT) AS chunk_no, sha256(substring(text, start + 1, 1000)) AS text_hash FROM s""",
)
def _(spark, d):
    return D.overlap_chunks(documents(spark, d)).select("doc_id", "chunk_no", F.sha2("text", 256).alias("text_hash"))


@query(
    "section_chunk_stats", "blocks",
    f"""WITH {chunks_sql('blocks')}, {sections_sql(LETTER_PATTERNS, 6000)},
    opened AS (SELECT doc_id, cls AS section FROM cl WHERE cls IS NOT NULL AND cls <> 'none' UNION SELECT doc_id, section FROM sect),
    s AS (SELECT doc_id, string_agg(section, ',' ORDER BY section) AS sections FROM opened GROUP BY doc_id),
    c AS (SELECT doc_id, count(*) AS n_chunks, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM chunks GROUP BY doc_id)
    SELECT doc_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(languages, '') AS languages, coalesce(sections, '') AS sections, CAST(0 AS BIGINT) AS ocr_blocks
    FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)""",
)
def _(spark, d):
    return D.section_chunk_stats(docs(spark, d), LETTER_PATTERNS)


FILE_STATS = "SELECT *, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, ' | '))) AS n_tables, split_part(path, '/', 2) AS category FROM files"


def _sample(strategy: str, order: str):
    @query(
        f"stratified_sample_{strategy}", "files",
        f"WITH f AS ({FILE_STATS}), r AS (SELECT category, path, row_number() OVER (PARTITION BY category ORDER BY {order} DESC, path) AS rank FROM f) SELECT * FROM r WHERE rank <= 3",
    )
    def _(spark, d):
        f = files(spark, d).withColumn("n_tables", F.size(F.filter(F.split("text", LINES), lambda x: F.contains(x, F.lit(" | ")))))
        return D.stratified_sample(f, "raw", 3, strategy).select("category", "path", "rank")


_sample("largest", "size")
_sample("most_tables", "n_tables")


@query("stratified_sample_random")
def _(spark, d):
    return D.stratified_sample(files(spark, d), "raw", 3, "random").select("category", "path", "rank")


@query("infer_category", "files", "SELECT path, split_part(path, '/', 2) AS category, 'прочее' AS flat FROM files")
def _(spark, d):
    f = files(spark, d)
    return f.select("path", D.infer_category(F.col("path"), "raw").alias("category"), D.infer_category(F.regexp_extract("path", "([^/]+)$", 1), "raw").alias("flat"))


META_SQL = f"""WITH first20 AS (SELECT doc_id, ord, kind, location, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM blocks) WHERE k <= 20),
    {chunks_sql('first20', 5000, 'mc')}, {sections_sql(LETTER_PATTERNS, 6000)},
    lc AS (SELECT doc_id, language, count(*) AS n, min(chunk_no) AS p FROM mc GROUP BY 1, 2),
    lang AS (SELECT doc_id, arg_min(language, (-n, p)) AS language FROM lc GROUP BY doc_id),
    head3 AS (SELECT doc_id, ord, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM blocks) WHERE k <= 3),
    ab AS (SELECT doc_id, ord, text FROM sect WHERE section = 'abstract'
       UNION ALL SELECT doc_id, ord, text FROM head3 WHERE doc_id NOT IN (SELECT doc_id FROM sect WHERE section = 'abstract')),
    a AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS abstract FROM ab GROUP BY doc_id)
    SELECT f.doc_id, CAST(f.doc_id AS VARCHAR) AS title, CAST(2020 + f.doc_id % 5 AS BIGINT) AS year, coalesce(language, 'unknown') AS language,
      coalesce(nullif(trim(left(abstract, 500)) || CASE WHEN length(abstract) > 500 THEN '…' ELSE '' END, ''), CAST(f.doc_id AS VARCHAR)) AS document_summary,
      sha256(coalesce(abstract, '')) AS abstract_hash, 0.3::DOUBLE AS reliability_score
    FROM files f LEFT JOIN lang USING (doc_id) LEFT JOIN a USING (doc_id)"""


@query("heuristic_metadata", "blocks files", META_SQL)
def _(spark, d):
    f = doc_files(spark, d).withColumn("modified", F.concat((F.col("doc_id") % 5 + 2020).cast("string"), F.lit("-03-01")))
    m = D.heuristic_metadata(f, LETTER_PATTERNS)
    return m.select("doc_id", "title", "year", "language", "document_summary", F.sha2("abstract", 256).alias("abstract_hash"), "reliability_score")


@query(
    "index_block_selection", "blocks files",
    f"""WITH {sections_sql(LETTER_PATTERNS, 6000)},
    s AS (SELECT doc_id, section, ord, text FROM sect),
    art AS (SELECT doc_id FROM files WHERE contains(path, '/en/')),
    cut AS (SELECT doc_id, ord, text, CASE section WHEN 'abstract' THEN 0 WHEN 'methods' THEN 1 WHEN 'results' THEN 2 ELSE 3 END AS k FROM s WHERE doc_id IN (SELECT doc_id FROM art)),
    picked AS (SELECT doc_id, k, ord, text FROM cut UNION ALL SELECT doc_id, 0, ord, text FROM blocks WHERE doc_id NOT IN (SELECT doc_id FROM cut))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, ord) - 1 AS pos, ord, text FROM picked""",
)
def _(spark, d):
    return D.index_block_selection(doc_files(spark, d), "activate", "en", LETTER_PATTERNS).select("doc_id", "pos", "ord", "text")


CONTENT_SQL = "h AS (SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY ord)) AS content_hash FROM blocks GROUP BY doc_id)"


@query(
    "content_dedup", "blocks",
    f"WITH {CONTENT_SQL} SELECT doc_id, content_hash, min(doc_id) OVER (PARTITION BY content_hash) AS kept_doc_id FROM (SELECT doc_id, coalesce(content_hash, sha256('')) AS content_hash FROM documents LEFT JOIN h USING (doc_id))",
)
def _(spark, d):
    return D.content_dedup(docs(spark, d).withColumn("added_at", F.col("doc_id")))


@query(
    "incremental_filter", "files",
    "SELECT doc_id, path FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)",
)
def _(spark, d):
    """Manifest: labelled documents; toxic ones were seen with another content."""
    f = files(spark, d)
    seen = f.join(table(spark, d, "labels").filter("quality = 1"), "doc_id")
    manifest = seen.select("path", F.when(F.col("toxic") == 0, F.col("sha256")).otherwise(F.sha1("path")).alias("sha256"))
    return D.incremental_filter(f, manifest).select("doc_id", "path")


@query(
    "manifest_update", "files",
    """WITH m AS (SELECT path, sha256, 1 AS seq FROM files UNION ALL SELECT path, sha1(path), 2 FROM files JOIN labels USING (doc_id) WHERE toxic = 1)
    SELECT path, arg_max(sha256, seq) AS sha256, CAST(max(seq) AS BIGINT) AS processed_at FROM m GROUP BY path""",
)
def _(spark, d):
    f = files(spark, d)
    manifest = f.select("path", "sha256", F.lit(1).cast("long").alias("processed_at"))
    again = f.join(table(spark, d, "labels").filter("toxic = 1"), "doc_id").select("path", F.sha1("path").alias("sha256"), F.lit(2).cast("long").alias("processed_at"))
    return D.update_manifest(manifest, again)


@query(
    "staged_priority_order", "files",
    """WITH p AS (SELECT doc_id AS priority, path FROM files JOIN labels USING (doc_id) WHERE quality = 1),
    i AS (SELECT path FROM files JOIN labels USING (doc_id) WHERE toxic = 1)
    SELECT path, CASE WHEN priority IS NULL THEN 2 ELSE 1 END::BIGINT AS stage, priority FROM files LEFT JOIN p USING (path) WHERE priority IS NOT NULL OR path NOT IN (SELECT path FROM i) ORDER BY stage, priority, path""",
)
def _(spark, d):
    f, lab = files(spark, d).select("doc_id", "path"), table(spark, d, "labels")
    priority = f.join(lab.filter("quality = 1"), "doc_id").select("path", F.col("doc_id").alias("priority"))
    indexed = f.join(lab.filter("toxic = 1"), "doc_id").select("path")
    return D.staged_priority_order(f, priority, indexed).select("path", "stage", "priority")


@query(
    "prune_except_keep", "files",
    """SELECT path, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS kept FROM files WHERE split_part(path, '/', 3) <> 'en'""",
)
def _(spark, d):
    f = files(spark, d).withColumn("source_type", F.when(F.col("path").contains("/en/"), "file").otherwise("corpus")).select("doc_id", "path", "source_type")
    keep = f.join(table(spark, d, "labels").filter("quality = 1"), "doc_id", "left_semi")
    kept, gone = D.prune_except_keep(f, keep)
    return kept.select("path", F.lit(True).alias("kept")).unionByName(gone.select("path", F.lit(False).alias("kept")))


@query(
    "extraction_cache", "blocks",
    f"""WITH {chunks_sql('blocks')},
    h AS (SELECT chunk_id, doc_id, sha256(text) AS text_hash FROM chunks WHERE trim(text) <> ''),
    cached AS (SELECT DISTINCT text_hash FROM h JOIN labels USING (doc_id) WHERE quality = 1)
    SELECT text_hash, text_hash IN (SELECT text_hash FROM cached) AS from_cache, count(*) AS n_chunks FROM h GROUP BY text_hash""",
)
def _(spark, d):
    """Cache: chunks of good documents at version 1, of bad ones at version 0 (stale)."""
    chunks = D.chunk_documents(docs(spark, d))
    lab = table(spark, d, "labels")
    cache = chunks.join(lab, "doc_id").select("text_hash", F.col("quality").alias("v"), F.lit("[]").alias("entities"), F.lit("[]").alias("relations"))
    hits, work = D.extraction_cache(chunks, cache, 1)
    counted = chunks.filter(F.trim("text") != "").groupBy("text_hash").agg(F.count(F.lit(1)).alias("n_chunks"))
    known = hits.select("text_hash").distinct().withColumn("from_cache", F.lit(True)).unionByName(work.select("text_hash", F.lit(False).alias("from_cache")))
    return known.join(counted, "text_hash")


NAMES_SQL = f"nm AS (SELECT DISTINCT lower(trim(name)) AS lname FROM g_nodes WHERE type IN ({TAG_SQL}) AND length(trim(name)) >= 3)"


@query(
    "highlight_entities", "blocks g_nodes",
    f"""WITH {chunks_sql('blocks')}, nm AS (SELECT DISTINCT lower(trim(name)) AS lname FROM g_nodes WHERE type <> 'publication' AND length(trim(name)) >= 3),
    low AS (SELECT chunk_id, lower(text) AS t FROM chunks),
    c AS (SELECT lname, count(chunk_id) AS mentions FROM nm LEFT JOIN low ON contains(t, lname) GROUP BY lname)
    SELECT id, type, trim(name) AS name, mentions FROM g_nodes JOIN c ON lname = lower(trim(name)) WHERE type <> 'publication'""",
)
def _(spark, d):
    """Every node that has a name to highlight."""
    return highlight_entities(D.chunk_documents(docs(spark, d)), gazetteer(node_names(spark, d)))


@query(
    "dictionary_tagger", "blocks g_nodes",
    f"""WITH {chunks_sql('blocks')}, {NAMES_SQL},
    low AS MATERIALIZED (SELECT chunk_id, lower(text) AS t FROM chunks),
    pr AS MATERIALIZED (SELECT chunk_id, t, lname FROM low JOIN nm ON contains(t, lname)),
    sp AS MATERIALIZED (SELECT chunk_id, lname, s AS start, s + length(lname) AS stop FROM (SELECT chunk_id, t, lname, unnest(generate_series(1, length(t) - length(lname) + 1)) AS s FROM pr) WHERE substring(t, s, length(lname)) = lname),
    pick AS (
      SELECT chunk_id, CAST(0 AS BIGINT) AS start, CAST(1 AS BIGINT) AS free, '' AS lname FROM (SELECT DISTINCT chunk_id FROM sp)
      UNION ALL
      SELECT chunk_id, start, stop, lname FROM (
        SELECT p.chunk_id, sp.start, sp.stop, sp.lname, row_number() OVER (PARTITION BY p.chunk_id ORDER BY sp.start, sp.stop DESC) AS k
        FROM pick p JOIN sp ON sp.chunk_id = p.chunk_id AND sp.start >= p.free) WHERE k = 1)
    SELECT chunk_id, lname, count(*) AS n_mentions FROM pick WHERE start > 0 GROUP BY chunk_id, lname""",
)
def _(spark, d):
    tags = dictionary_tagger(D.chunk_documents(docs(spark, d)), gazetteer(node_names(spark, d), TAG_TYPES))
    return tags.groupBy("chunk_id", "lname").agg(F.count(F.lit(1)).alias("n_mentions"))
