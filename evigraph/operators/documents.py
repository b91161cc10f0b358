"""Blocks, sections, chunks and document metadata.

A document is one row. Its blocks are an array column of that row, so splitting, section finding
and chunk packing are projections: no shuffle, and documents are processed in parallel.

Costly arrays are exploded in the outer form and null rows dropped afterwards: for the inner form
the optimizer adds a test for emptiness that computes the whole array a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.skew import spread_join
from evigraph.functions.text import let, script_language

# Section headings, limits and file categories.
SECTION_PATTERNS = {
    "abstract": "^(аннотаци|реферат|abstract|резюме)",
    "methods": "^(метод[аы]?( и материал)?|материал[аы] и метод|methodology|methods)",
    "results": "^(результат|results)",
    "conclusion": "^(заключени|вывод|conclusion|discussion|итог)",
}
SECTION_ORDER = ("abstract", "methods", "results", "conclusion")
MAX_HEADING_LENGTH = 100
SECTION_CHARS = 6000
CHUNK_CHARS = 2200
PARAGRAPH_SEPARATOR = r"\n\s*\n"
CATEGORY_BY_EXT = {".pptx": "доклад", ".docx": "статья_или_отчёт", ".pdf": "статья_или_отчёт_pdf"}
OTHER_CATEGORY = "прочее"
ARTICLES_FOLDER = "статьи"
SUMMARY_CHARS = 500
METADATA_BLOCKS = 20
METADATA_CHUNK_CHARS = 5000
HEURISTIC_RELIABILITY = 0.3


def block_array(text: Column, separator: str = PARAGRAPH_SEPARATOR) -> Column:
    """Trimmed non-empty pieces as struct(ord, location, kind, text); the index counts empties."""
    pieces = F.transform(
        F.split(text, separator),
        lambda line, i: F.struct(
            i.cast("long").alias("ord"),
            F.concat(F.lit("para "), i.cast("string")).alias("location"),
            F.when(F.contains(line, F.lit(" | ")), "table").otherwise("paragraph").alias("kind"),
            F.trim(line).alias("text"),
        ),
    )
    return F.filter(pieces, lambda b: b["text"] != "")


def with_blocks(docs: DataFrame, separator: str = PARAGRAPH_SEPARATOR, text: str = "text") -> DataFrame:
    """Replace the text column of one-row documents by their ``blocks`` array."""
    return docs.withColumn("blocks", block_array(F.col(text), separator)).drop(text)


def gather_blocks(blocks: DataFrame) -> DataFrame:
    """Block rows (from paged or HTML sources) back to one row per document, in order."""
    b = F.struct("ord", "location", "kind", "text")
    return blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(b)).alias("blocks"))


def text_blocks(docs: DataFrame, separator: str = PARAGRAPH_SEPARATOR) -> DataFrame:
    return with_blocks(docs.select("doc_id", "text"), separator).select("doc_id", F.inline_outer("blocks")).filter(F.col("ord").isNotNull())


def is_heading(kind: Column, text: Column) -> Column:
    t = F.trim(text)
    short = (t != "") & (F.length(t) < MAX_HEADING_LENGTH) & ~F.substring(t, -1, 1).isin(".", ":", ";", ",")
    return (kind == "heading") | short


def heading_class(text: Column, patterns: dict[str, str]) -> Column:
    """Name of the first pattern that the heading starts with, null for any other heading."""
    t = F.trim(text)
    out = F.lit(None).cast("string")
    for name, pattern in reversed(list(patterns.items())):
        out = F.when(t.rlike("(?iu)" + pattern), name).otherwise(out)
    return out


def _tail(blocks: Column, n: int) -> Column:
    size = F.size(blocks)
    return F.when(size <= n, blocks).otherwise(F.slice(blocks, F.greatest(size - (n - 1), F.lit(1)), n))


def _section_blocks(blocks: Column, segments: Column, name: str, max_chars: int) -> Column:
    """Blocks of one section in order, until the characters taken so far reach the limit."""
    mine = F.flatten(
        F.transform(
            F.filter(segments, lambda s: s["section"] == name),
            lambda s: F.slice(blocks, s["first"], s["size"]),
        )
    )

    def taken(found: Column) -> Column:
        return F.aggregate(
            found,
            F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("chars")),
            lambda acc, b: F.when(
                acc["chars"] < max_chars,
                F.struct((acc["n"] + 1).alias("n"), (acc["chars"] + F.length(b["text"])).cast("long").alias("chars")),
            ).otherwise(acc),
        )["n"]

    return let(mine, lambda found: F.slice(found, 1, taken(found)))


def with_sections(docs: DataFrame, patterns: dict[str, str] | None = None, max_chars: int = SECTION_CHARS) -> DataFrame:
    """Add ``sections``: array of struct(section, blocks) in section order.

    A matching heading opens its section, any other heading closes it, tables neither open nor
    close. Documents without a matching heading get their first and last three blocks.
    """
    patterns = patterns or SECTION_PATTERNS
    heads = F.filter(
        F.transform(
            "blocks",
            lambda b, i: F.struct(
                (i + 1).alias("at"),
                ((b["kind"] != "table") & is_heading(b["kind"], b["text"])).alias("is_head"),
                heading_class(b["text"], patterns).alias("section"),
            ),
        ),
        lambda h: h["is_head"],
    )
    segments = F.filter(
        F.transform(
            "_heads",
            lambda h, i: F.struct(
                (h["at"] + 1).alias("first"),
                (F.coalesce(F.get("_heads", i + 1)["at"], F.size("blocks") + 1) - h["at"] - 1).alias("size"),
                h["section"].alias("section"),
            ),
        ),
        lambda s: s["section"].isNotNull(),
    )
    formal = F.array(
        *[
            F.struct(F.lit(name).alias("section"), _section_blocks(F.col("blocks"), F.col("_segments"), name, max_chars).alias("blocks"))
            for name in patterns
        ]
    )
    fallback = F.array(
        F.struct(F.lit("abstract").alias("section"), F.slice("blocks", 1, 3).alias("blocks")),
        F.struct(F.lit("conclusion").alias("section"), _tail(F.col("blocks"), 3).alias("blocks")),
    )
    return (
        docs.withColumn("_heads", heads)
        .withColumn("_segments", segments)
        .withColumn("has_sections", F.size("_segments") > 0)
        .withColumn(
            "sections",
            F.when(
                F.col("has_sections"),
                F.filter(formal, lambda s: F.exists("_segments", lambda g: g["section"] == s["section"])),
            ).otherwise(F.filter(fallback, lambda s: F.size(s["blocks"]) > 0)),
        )
        .drop("_heads", "_segments")
    )


def key_sections(docs: DataFrame, patterns: dict[str, str] | None = None, max_chars: int = SECTION_CHARS) -> DataFrame:
    """One row per (document, section, block)."""
    cut = with_sections(docs, patterns, max_chars).select("doc_id", F.inline_outer("sections"))
    return cut.select("doc_id", "section", F.inline_outer("blocks")).filter(F.col("ord").isNotNull())


def chunk_array(blocks: Column, max_chars: int = CHUNK_CHARS) -> Column:
    """Chunks of an array of struct(ord, location, kind, text, lang).

    A fold over the blocks finds where chunks start; it appends only at a start, so the work is
    linear in the blocks. A table is a chunk of its own. A language change (neither side mixed) or
    a full buffer starts a chunk. The chunk language is its first that is not mixed.
    """
    start_state = F.struct(
        F.array().cast("array<int>").alias("starts"), F.lit(1).alias("at"), F.lit(0).alias("len"),
        F.lit("").alias("lang"), F.lit(False).alias("open"),
    )

    def step(acc: Column, b: Column) -> Column:
        is_table = b["kind"] == "table"
        piece = F.length(b["text"]) + F.length(b["location"]) + 4
        changed = (b["lang"] != "mixed") & (acc["lang"] != "mixed") & (b["lang"] != acc["lang"])
        new_chunk = is_table | ~acc["open"] | changed | (acc["len"] + piece > max_chars)
        return let(
            new_chunk,
            lambda starts: F.struct(
                F.when(starts, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"),
                (acc["at"] + 1).alias("at"),
                F.when(is_table, 0).when(starts, piece).otherwise(acc["len"] + piece).alias("len"),
                F.when(is_table, "").when(starts | (acc["lang"] == "mixed"), b["lang"]).otherwise(acc["lang"]).alias("lang"),
                (~is_table).alias("open"),
            ),
        )

    def assemble(part: Column, number: Column) -> Column:
        return F.struct(
            number.cast("long").alias("chunk_no"),
            F.get(part, F.lit(0))["kind"].alias("kind"),
            F.coalesce(
                F.get(F.filter(F.transform(part, lambda b: b["lang"]), lambda x: x != "mixed"), F.lit(0)), F.lit("mixed")
            ).alias("language"),
            F.transform(part, lambda b: b["location"]).alias("locations"),
            F.array_join(
                F.transform(part, lambda b: F.concat(F.lit("["), b["location"], F.lit("] "), b["text"])), "\n\n"
            ).alias("text"),
        )

    def pack(bs: Column) -> Column:
        return let(
            F.aggregate(bs, start_state, step)["starts"],
            lambda starts: F.transform(
                starts,
                lambda s, i: let(
                    F.slice(bs, s, F.coalesce(F.get(starts, i + 1), F.size(bs) + 1) - s), lambda part: assemble(part, i)
                ),
            ),
        )

    return let(blocks, pack)


def with_language(blocks: Column) -> Column:
    return F.transform(
        blocks,
        lambda b: F.struct(b["ord"].alias("ord"), b["location"].alias("location"), b["kind"].alias("kind"), b["text"].alias("text"), script_language(b["text"]).alias("lang")),
    )


def chunk_documents(docs: DataFrame, max_chars: int = CHUNK_CHARS, blocks: str = "blocks") -> DataFrame:
    """chunks(chunk_id, doc_id, chunk_no, kind, language, locations, text, text_hash)."""
    return (
        docs.select("doc_id", with_language(F.col(blocks)).alias("b"))
        .select("doc_id", chunk_array(F.col("b"), max_chars).alias("c"))
        .select("doc_id", F.inline_outer("c"))
        .filter(F.col("chunk_no").isNotNull())
        .select(
            F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("chunk_no").cast("string")).alias("chunk_id"),
            "doc_id", "chunk_no", "kind", "language", "locations", "text", F.sha2("text", 256).alias("text_hash"),
        )
    )


def overlap_chunks(docs: DataFrame, chunk_size: int = 1000, overlap: int = 200) -> DataFrame:
    """Fixed-size character windows; a window inside its predecessor is not made."""
    if overlap >= chunk_size:
        raise ValueError("overlap must be smaller than chunk_size")
    step = chunk_size - overlap
    last = F.greatest(F.length("text") - overlap - 1, F.lit(0))
    at = docs.filter(F.length("text") > 0).select("doc_id", "text", F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("chunk_no", "start"))
    return at.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.expr(f"substring(text, start + 1, {chunk_size})").alias("text"))


def section_chunk_stats(docs: DataFrame, patterns: dict[str, str] | None = None, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per document: chunks of all blocks, their languages, sections found, OCR blocks."""
    ocr = F.size(F.filter("blocks", lambda b: b["ocr"])) if "ocr" in docs.schema["blocks"].dataType.elementType.names else F.lit(0)
    return (
        with_sections(docs, patterns)
        .withColumn("_c", chunk_array(with_language(F.col("blocks")), max_chars))
        .select(
            "doc_id",
            F.size("_c").cast("long").alias("n_chunks"),
            F.array_join(F.array_sort(F.array_distinct(F.transform("_c", lambda c: c["language"]))), ",").alias("languages"),
            F.array_join(F.array_sort(F.transform("sections", lambda s: s["section"])), ",").alias("sections"),
            ocr.cast("long").alias("ocr_blocks"),
        )
    )


def infer_category(path: Column, root: str) -> Column:
    """Folders below the root without the deepest one; a flat file falls back to its extension."""
    prefix = root.rstrip("/") + "/"
    rel = F.when(F.startswith(path, F.lit(prefix)), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)
    parts = F.split(rel, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    trimmed = F.when(F.size(folders) > 1, F.slice(folders, 1, F.size(folders) - 1)).otherwise(folders)
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    by_ext = F.lit(OTHER_CATEGORY)
    for suffix, name in CATEGORY_BY_EXT.items():
        by_ext = F.when(ext == suffix, name).otherwise(by_ext)
    return F.when(F.size(folders) == 0, by_ext).otherwise(F.array_join(trimmed, "/"))


SAMPLE_STRATEGIES = ("random", "largest", "newest", "most_tables")


def stratified_sample(files: DataFrame, root: str, per_category: int = 3, strategy: str = "random", seed: int = 42) -> DataFrame:
    """Up to ``per_category`` files of each category; rows beyond that are cut before the shuffle."""
    if strategy not in SAMPLE_STRATEGIES:
        raise ValueError(f"strategy must be one of {SAMPLE_STRATEGIES}")
    order = {
        "random": lambda: F.xxhash64(F.col("path"), F.lit(seed)).asc(),
        "largest": lambda: F.col("size").desc(),
        "newest": lambda: F.col("modified").desc(),
        "most_tables": lambda: F.col("n_tables").desc(),
    }[strategy]()
    ranked = files.withColumn("category", infer_category(F.col("path"), root)).withColumn(
        "rank", F.row_number().over(W.partitionBy("category").orderBy(order, "path")).cast("long")
    )
    return ranked.filter(F.col("rank") <= per_category)


def section_text(sections: Column, name: str) -> Column:
    return F.get(F.filter(sections, lambda s: s["section"] == name), F.lit(0))["blocks"]


def abstract_blocks(docs_with_sections: DataFrame) -> Column:
    found = section_text(F.col("sections"), "abstract")
    return F.when(F.size(found) > 0, found).otherwise(F.slice("blocks", 1, 3))


def first_mode(values: Column) -> Column:
    """Most frequent value, the earliest on ties."""
    counted = F.transform(
        F.array_distinct(values),
        lambda v, i: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-i).alias("p"), v.alias("v")),
    )
    return F.array_max(counted)["v"]


def heuristic_metadata(docs: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Title, year, language, abstract and summary without a model.

    ``docs`` carries doc_id, path, modified (ISO text) and blocks.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    title = F.replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit("_"), F.lit(" "))
    cut = with_sections(docs, patterns)
    cut = cut.withColumn("_abs", abstract_blocks(cut)).withColumn(
        "_langs",
        F.transform(chunk_array(with_language(F.slice("blocks", 1, METADATA_BLOCKS)), METADATA_CHUNK_CHARS), lambda c: c["language"]),
    )
    abstract = F.array_join(F.filter(F.transform("_abs", lambda b: b["text"]), lambda t: F.trim(t) != ""), "\n\n")
    head = F.trim(F.substring(abstract, 1, SUMMARY_CHARS))
    summary = F.when(F.length(abstract) > SUMMARY_CHARS, F.concat(head, F.lit("…"))).otherwise(head)
    return cut.select(
        "doc_id",
        title.alias("title"),
        name.alias("source"),
        F.substring("modified", 1, 4).try_cast("bigint").alias("year"),
        F.coalesce(first_mode(F.col("_langs")), F.lit("unknown")).alias("language"),
        F.lit("unknown").alias("geography"),
        F.lit("unknown").alias("domain"),
        F.lit(HEURISTIC_RELIABILITY).alias("reliability_score"),
        F.when(summary != "", summary).otherwise(title).alias("document_summary"),
        abstract.alias("abstract"),
    )


def in_folder(path: Column, folder: str) -> Column:
    return F.array_contains(F.split(F.lower(path), "/"), folder.lower())


def index_block_selection(docs: DataFrame, mode: str, folder: str = ARTICLES_FOLDER, patterns: dict[str, str] | None = None) -> DataFrame:
    """Blocks to index (``abstract``) or to search (``sections``): articles are cut, the rest is whole."""
    cut = with_sections(docs, patterns)
    if mode == "index":
        chosen = abstract_blocks(cut)
    elif mode == "activate":
        ordered = F.flatten(
            F.array(*[F.coalesce(section_text(F.col("sections"), s), F.slice("blocks", 1, 0)) for s in SECTION_ORDER])
        )
        chosen = F.when(F.size(ordered) > 0, ordered).otherwise(F.col("blocks"))
    else:
        raise ValueError("mode is 'index' or 'activate'")
    picked = F.when(in_folder(F.col("path"), folder), chosen).otherwise(F.col("blocks"))
    rows = cut.select("doc_id", F.posexplode_outer(picked).alias("pos", "b")).filter(F.col("pos").isNotNull())
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "b.*")


def content_hash(docs: DataFrame) -> Column:
    return F.sha2(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n"), 256)


def content_dedup(docs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(doc_id, content_hash, kept_doc_id): equal contents point to the first document in order.

    ``docs`` carries doc_id, added_at and blocks; ``stored(content_hash, doc_id)`` are ready
    documents that win over new ones. Copies are combined map-side; the join back spreads a
    content that a large share of the documents repeats.
    """
    hashed = docs.select("doc_id", "added_at", content_hash(docs).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min(F.struct("added_at", "doc_id")).alias("_f")).select("content_hash", F.col("_f.doc_id").alias("kept_doc_id"))
    if stored is not None:
        old = stored.groupBy("content_hash").agg(F.min("doc_id").alias("_old"))
        first = first.join(old, "content_hash", "left").select("content_hash", F.coalesce("_old", "kept_doc_id").alias("kept_doc_id"))
    return spread_join(hashed, first, ["content_hash"]).select("doc_id", "content_hash", "kept_doc_id")


def incremental_filter(files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Files whose (path, sha256) is not in the manifest; a moved file counts as new."""
    return files if force else files.join(manifest.select("path", "sha256"), ["path", "sha256"], "left_anti")


def update_manifest(manifest: DataFrame, processed: DataFrame) -> DataFrame:
    """One row per path: the entry processed last."""
    both = manifest.select("path", "sha256", "processed_at").unionByName(processed.select("path", "sha256", "processed_at"))
    return both.groupBy("path").agg(F.max(F.struct("processed_at", "sha256")).alias("m")).select("path", "m.sha256", "m.processed_at")


def staged_priority_order(files: DataFrame, priority: DataFrame, indexed: DataFrame) -> DataFrame:
    """Priority files in list order (stage 1), then the rest not yet indexed (stage 2)."""
    staged = files.join(priority.select("path", "priority"), "path", "left").withColumn(
        "stage", F.when(F.col("priority").isNotNull(), 1).otherwise(2).cast("long")
    )
    first = staged.filter("stage = 1")
    rest = staged.filter("stage = 2").join(indexed.select("path"), "path", "left_anti")
    return first.unionByName(rest).orderBy("stage", "priority", "path")


def prune_except_keep(docs: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, to remove) corpus documents by path."""
    corpus = docs.filter("source_type = 'corpus'")
    return corpus.join(keep.select("path"), "path", "left_semi"), corpus.join(keep.select("path"), "path", "left_anti")


def extraction_cache(chunks: DataFrame, cache: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """(hits, work): chunks with a cached extraction of this version, and distinct texts without one."""
    valid = cache.filter((F.col("v") == version) & F.col("entities").isNotNull()).select("text_hash", "entities", "relations").dropDuplicates(["text_hash"])
    keyed = chunks.filter(F.trim("text") != "")
    hits = spread_join(keyed, valid, ["text_hash"])
    work = keyed.select("text_hash", "text").dropDuplicates(["text_hash"]).join(valid.select("text_hash"), "text_hash", "left_anti")
    return hits, work
