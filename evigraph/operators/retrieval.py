"""Dense retrieval with lexical re-ranking, citations and confidence, for batches of questions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.skew import spread_join
from evigraph.functions.text import PLAIN_DIGITS, STOPWORDS, SUBSCRIPT_DIGITS, let, match_key, normalize_subscripts, word_match
from evigraph.model import CONFIDENCE_HIGH, CONFIDENCE_LOW, CONFIDENCE_MEDIUM, CONFIDENCE_NONE
from evigraph.session import cut_lineage, cut_to_table

# Depths, thresholds and weights of retrieval.
TOP_K = 6
MIN_SCORE = 0.35
DISCOVERY_MIN_SCORE = 0.25
TOP_DOCS = 5
DISCOVERY_TOP_K = TOP_DOCS * 4
DISCOVERY_CHUNKS = 3
ACTIVATE_MIN_SCORE = 0.35
ACTIVATE_TOP_RATIO = 0.7
POOL_FACTOR = 4
BOOST_WEIGHT = 0.15
HARD_WEIGHT, TERM_WEIGHT = 0.7, 0.3
SNIPPET_CHARS = 280
EXCERPT_CHARS = 600
HISTORY_LIMIT = 50
# Tokens that must match literally.
UNITS = (
    r"мг/дм³|мг/дм3|мг/л|г/дм³|г/дм3|г/л|м³/ч|м3/ч|м³/сут|м3/сут|т/сут|т/год|"
    r"а/м²|а/м2|°c|°с|мпа|кпа|ppm|mg/l|%|мкм|нм|мм|см|км|кв|мвт|квт"
)
FORMULAS = (
    r"so₂|so2|co₂|co2|h₂so₄|h2so4|no[x₂2]?|caco₃|caco3|"
    r"\bpt\b|\bpd\b|\brh\b|\bir\b|\bos\b|\bru\b|\bau\b|\bag\b|\bni\b|\bcu\b|"
    r"\bca\b|\bmg\b|\bna\b|\bfe\b|\bco\b|\bpb\b|\bzn\b|\bs\b"
)
NUMBER = r"\d+(?:[.,]\d+)?"
CODE = r"\b(?=\w*\d)(?=\w*[a-zа-яё])[\w\-]{2,}\b"
ACRONYM = r"\b[А-ЯA-Z]{2,}\b"
BIG_NUMBER = r"\b\d{3,}\b"
# Answer texts.
NOT_FOUND_ANSWER = (
    "В загруженных документах и ссылках не нашлось информации по этому вопросу. "
    "Загрузите релевантный файл или добавьте ссылку на статью, чтобы получить ответ по нему."
)
EXCERPTS_HEAD = "Показаны наиболее релевантные фрагменты источников:"
EXTERNAL_DEFAULTS = {
    "scholar": ("S", "авторы не указаны", "год не указан", "источник не указан"),
    "patent": ("P", "изобретатели не указаны", "год не указан", "номер не указан"),
}

QUERY_VALUES = 4_000_000  # values of the questions in one block
TILE_ROWS = 50_000  # chunks in one tile
CELLS = 8_000_000  # scores held at a time
SCORE_DIGITS = 9  # equal vectors tie exactly, whatever the summation order


def _score_batch(ids: pd.DataFrame, vectors: pd.Series, qsets: np.ndarray, matrix: np.ndarray, min_score: float, pool: int | None) -> pd.DataFrame:
    """Best formulation score per chunk and question set of one batch, below-threshold entries dropped.

    ``qsets`` is sorted. With ``pool`` only entries that can be among the best ``pool`` of the
    batch stay (ties kept), which no global ranking can miss.
    """
    scores = np.stack(vectors.to_numpy()).astype(np.float64) @ matrix.T
    labels, first = np.unique(qsets, return_index=True)
    best = np.round(np.maximum.reduceat(scores, first, axis=1), SCORE_DIGITS)
    keep = best >= min_score
    if pool is not None and len(best) > pool:
        keep &= best >= np.partition(best, len(best) - pool, axis=0)[len(best) - pool]
    rows, cols = np.nonzero(keep)
    out = ids.iloc[rows].reset_index(drop=True)
    out.insert(0, "qset_id", labels[cols])
    out["score"] = best[rows, cols]
    return out


def score_group(chunks: pd.DataFrame, queries: pd.DataFrame, min_score: float, pool: int | None, cells: int) -> pd.DataFrame:
    """Scores of one group of chunks and questions; ``cells`` of them are held at a time."""
    if chunks.empty or queries.empty:
        # Columns made from empty lists would be numbers, which Arrow does not take for text ids.
        return pd.DataFrame(columns=["qset_id", "chunk_id", "doc_id", "score"], dtype=object)
    queries = queries.sort_values("qset_id", kind="stable")
    qsets, matrix = queries["qset_id"].to_numpy(), np.stack(queries["embedding"].to_numpy()).astype(np.float64)
    step = max(1, cells // len(matrix))
    parts = (chunks.iloc[i : i + step] for i in range(0, len(chunks), step))
    return pd.concat([_score_batch(p[["chunk_id", "doc_id"]], p["embedding"], qsets, matrix, min_score, pool) for p in parts])


def score_chunks(
    chunks: DataFrame, queries: DataFrame, min_score: float, pool: int | None = None,
    query_values: int = QUERY_VALUES, tile_rows: int = TILE_ROWS, cells: int = CELLS,
) -> DataFrame:
    """(qset_id, chunk_id, doc_id, score): maximum dot product over the formulations of a set.

    Questions are cut into blocks and chunks into tiles that meet in a grouped join of bounded groups.
    Inside a group scores are computed for so many chunks at a time that ``cells`` of them are held.
    Without ``pool`` this is a threshold join: every pair at or above ``min_score`` is returned.
    """
    ids = ["chunk_id", "doc_id"]
    base = chunks.select(*ids, "embedding")
    asked = cut_lineage(queries.select("qset_id", "embedding"))
    schema = f"qset_id {asked.schema['qset_id'].dataType.simpleString()}, " + ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in ids) + ", score double"
    values = asked.agg(F.sum(F.size("embedding").cast("long")).alias("n")).first()["n"] or 0
    n_blocks = int(-(-values // query_values)) or 1
    n_tiles = int(-(-base.count() // tile_rows)) or 1
    tiled = base.select("*", F.pmod(F.xxhash64("chunk_id"), F.lit(n_tiles)).alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    blocked = asked.select("*", F.pmod(F.xxhash64("qset_id"), F.lit(n_blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_tiles - 1).cast("long"))).alias("tile"))

    def grouped(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return score_group(left, right, min_score, pool, cells)

    return tiled.groupBy("tile", "block").cogroup(blocked.groupBy("tile", "block")).applyInPandas(grouped, schema)


def top_scores(scored: DataFrame, k: int) -> DataFrame:
    """Best k per question set; rank k is also applied before the shuffle."""
    best = W.partitionBy("qset_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int, min_score: float) -> DataFrame:
    return top_scores(score_chunks(chunks, queries, min_score, k), k)


def candidate_pool(chunks: DataFrame, queries: DataFrame, top_k: int = TOP_K, min_score: float = MIN_SCORE) -> DataFrame:
    return vector_topk(chunks, queries, top_k * POOL_FACTOR, min_score)


def query_signals(queries: DataFrame) -> DataFrame:
    """(qset_id, hard, terms): literal tokens without white space, and words that may inflect.

    ``queries(qset_id, variant_no, text)``. The arrays are as long as the question's own words.
    """
    flags = "(?iuU)"
    norm = normalize_subscripts(F.col("text"))
    patterns = [f"{NUMBER}\\s*(?:{UNITS})", FORMULAS, CODE, BIG_NUMBER]
    found = F.concat(
        *[F.regexp_extract_all(norm, F.lit(flags + p), F.lit(0)) for p in patterns],
        F.transform(F.regexp_extract_all(F.translate("text", SUBSCRIPT_DIGITS, PLAIN_DIGITS), F.lit("(?U)" + ACRONYM), F.lit(0)), lambda a: F.lower(a)),
    )
    hard_tokens = F.transform(found, lambda t: F.trim(t))
    words = F.regexp_extract_all(F.lower("text"), F.lit("[А-Яа-яЁёA-Za-z-]+"), F.lit(0))
    per_variant = queries.select("qset_id", hard_tokens.alias("tokens"), words.alias("words"))
    # One set is a handful of formulations of one question.
    per_set = per_variant.groupBy("qset_id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"), F.flatten(F.collect_list("words")).alias("words"))
    keys = F.filter(F.array_distinct(F.transform("tokens", lambda t: F.regexp_replace(t, r"\s+", ""))), lambda k: F.length(k) >= 2)
    whole = F.filter("tokens", lambda t: F.length(F.regexp_replace(t, r"\s+", "")) >= 2)
    joined = F.array_join(whole, " ")
    with_hard = per_set.select("qset_id", "words", keys.alias("hard"), joined.alias("joined"))
    terms = F.filter(F.array_distinct("words"), lambda w: (F.length(w) > 3) & ~w.isin(*STOPWORDS) & ~F.contains(F.col("joined"), w))
    return with_hard.select("qset_id", "hard", terms.alias("terms"))


def lexical_score(hard: Column, terms: Column, text: Column) -> Column:
    """Share of literal tokens and of words found in a text, 0.7 to 0.3 if both are asked."""
    norm = normalize_subscripts(text)
    # Literal tokens are looked for in the text as it is spaced; only a number and its unit may stand apart.
    closed = F.regexp_replace(norm, rf"(\d)\s+({UNITS})", "$1$2")
    both = F.concat_ws("\n", norm, closed)
    hard_share = let(both, lambda g: F.size(F.filter(hard, lambda h: F.contains(g, h)))) / F.nullif(F.size(hard), F.lit(0))
    words = F.array_distinct(F.regexp_extract_all(norm, F.lit("[а-яёa-z-]+"), F.lit(0)))
    # Only words that share their first three characters with a term can match it.
    near = let(F.transform(terms, match_key), lambda keys: F.filter(words, lambda w: F.array_contains(keys, match_key(w))))
    term_share = let(near, lambda ws: F.size(F.filter(terms, lambda t: F.exists(ws, lambda w: word_match(t, w))))) / F.nullif(F.size(terms), F.lit(0))
    return F.coalesce(hard_share * HARD_WEIGHT + term_share * TERM_WEIGHT, hard_share, term_share, F.lit(0.0))


def lexical_rerank(pool: DataFrame, signals: DataFrame, texts: DataFrame, top_k: int, weight: float = BOOST_WEIGHT) -> DataFrame:
    """hits(qset_id, rank, chunk_id, doc_id, score, boosted): order by score + weight * lexical share.

    The reported score stays the vector score. Pools are small per question; chunk texts are read
    for pool members only.
    """
    # A table has its real size, so a small pool is joined where the texts lie and they are not shuffled.
    joined = cut_to_table(pool.drop("rank")).join(texts.select("chunk_id", "text"), "chunk_id").join(signals, "qset_id", "left")
    empty = F.array().cast("array<string>")
    lex = lexical_score(F.coalesce("hard", empty), F.coalesce("terms", empty), F.col("text"))
    boosted = joined.withColumn("boosted", F.round(F.col("score") + lex * weight, SCORE_DIGITS))
    order = W.partitionBy("qset_id").orderBy(F.desc("boosted"), F.desc("score"), "chunk_id")
    return boosted.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top_k).select("qset_id", "rank", "chunk_id", "doc_id", "score", "boosted")


def doc_scores(hits: DataFrame) -> DataFrame:
    return hits.groupBy("qset_id", "doc_id").agg(F.max("score").alias("score"))


def activation_floor(scores: DataFrame, top_docs: int = TOP_DOCS) -> DataFrame:
    """Documents not far below the best one: (qset_id, doc_id, score, rank)."""
    best = F.max("score").over(W.partitionBy("qset_id"))
    near = scores.withColumn("best", best).filter(F.col("score") >= F.greatest(F.lit(ACTIVATE_MIN_SCORE), F.col("best") * ACTIVATE_TOP_RATIO))
    order = W.partitionBy("qset_id").orderBy(F.desc("score"), "doc_id")
    return near.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top_docs).select("qset_id", "doc_id", "score", "rank")


UPLOADS = ("file", "link")


def ready_corpus(docs: DataFrame) -> DataFrame:
    """Documents that discovery may activate: ready ones of the corpus, not uploads."""
    return docs.filter((F.col("status") == "ready") & ~F.coalesce(F.col("source_type").isin(*UPLOADS), F.lit(False)))


def searchable_filter(docs: DataFrame) -> DataFrame:
    """Ready documents with chunks that are attached (or undecided) and fully indexed or uploaded."""
    return docs.filter(
        (F.col("status") == "ready") & (F.col("num_chunks") > 0)
        & (F.col("attached").isNull() | F.col("attached"))
        & (F.col("index_mode").isNull() | (F.col("index_mode") == "full") | F.coalesce(F.col("source_type").isin(*UPLOADS), F.lit(False)))
    )


def attach_state(log: DataFrame) -> DataFrame:
    """(doc_id, attached, attach_source, index_mode) of corpus documents after all logged actions.

    ``log(doc_id, seq, action)``: activate, attach_manual, delete (a soft detach), detach_auto (acts
    on automatically attached ones and keeps a full index), others ignored. The state depends only
    on the last actions of each kind, so it is an aggregate with map-side combine.
    """
    at = F.struct("seq", "action")
    last = log.groupBy("doc_id").agg(
        F.max(F.when(F.col("action").isin("activate", "attach_manual", "delete"), at)).alias("e"),
        F.max(F.when(F.col("action") == "detach_auto", F.col("seq"))).alias("detached"),
        F.max(F.when(F.col("action").isin("activate", "delete"), at)).alias("m"),
    )
    action = F.coalesce(F.col("e.action"), F.lit("none"))
    auto_off = (action == "activate") & F.coalesce(F.col("detached") > F.col("e.seq"), F.lit(False))
    attached = action.isin("activate", "attach_manual") & ~auto_off
    return last.select(
        "doc_id", attached.alias("attached"),
        F.when(~attached, "").when(action == "activate", "auto").otherwise("manual").alias("attach_source"),
        F.when(F.col("m.action") == "activate", "full").otherwise("abstract").alias("index_mode"),
    )


def list_documents(docs: DataFrame) -> DataFrame:
    shown = F.col("attached") | (F.col("attached").isNull() & F.col("source_type").isin("file", "link"))
    return docs.filter(F.col("source_type").isNotNull() & F.coalesce(shown, F.lit(False))).orderBy(F.desc("added_at"), "doc_id")


def citations(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Numbered citations with the context line of each: one row per hit."""
    c = chunks.select("chunk_id", F.col("text").alias("chunk_text"), "location")
    rows = hits.join(c, "chunk_id").join(docs.select("doc_id", "title", "source_type", "source_name"), "doc_id", "left")
    title = F.coalesce("title", F.lit("?"))
    return rows.select(
        "qset_id", F.col("rank").alias("index"), "chunk_id", "doc_id", title.alias("title"),
        F.coalesce("source_type", F.lit("?")).alias("source_type"), F.coalesce("source_name", F.lit("?")).alias("source_name"), "location",
        F.round("score", 3).alias("score"), F.substring("chunk_text", 1, SNIPPET_CHARS).alias("snippet"),
        F.format_string("[%d] (%s, %s):\n%s", "rank", title, "location", "chunk_text").alias("context_line"),
        F.substring("chunk_text", 1, EXCERPT_CHARS).alias("excerpt"),
    )


def answer_confidence(cited: DataFrame, questions: DataFrame) -> DataFrame:
    """(qset_id, confidence) from the first citation's score and the number of documents cited."""
    per = cited.groupBy("qset_id").agg(F.min_by("score", "index").alias("top"), F.count_distinct("doc_id").alias("n_docs"))
    label = (
        F.when(F.col("top").isNull(), CONFIDENCE_NONE)
        .when((F.col("top") >= 0.60) & (F.col("n_docs") >= 2), CONFIDENCE_HIGH)
        .when(F.col("top") >= 0.45, CONFIDENCE_MEDIUM)
        .otherwise(CONFIDENCE_LOW)
    )
    return questions.select("qset_id").distinct().join(per, "qset_id", "left").select("qset_id", label.alias("confidence"))


def extractive_answer(cited: DataFrame, questions: DataFrame) -> DataFrame:
    """(qset_id, grounded, answer): numbered excerpts, a fixed refusal without hits.

    A question has at most top_k citations, so its array is short.
    """
    per = cited.groupBy("qset_id").agg(F.array_sort(F.collect_list(F.struct("index", "excerpt"))).alias("c"))
    body = F.concat(F.lit(EXCERPTS_HEAD + "\n\n"), F.array_join(F.transform("c", lambda x: F.concat(F.lit("["), x["index"].cast("string"), F.lit("] "), x["excerpt"])), "\n\n"))
    return questions.select("qset_id").distinct().join(per, "qset_id", "left").select(
        "qset_id", F.col("c").isNotNull().alias("grounded"), F.coalesce(body, F.lit(NOT_FOUND_ANSWER)).alias("answer")
    )


def external_relevance(sources: DataFrame) -> DataFrame:
    """+ matched_keywords, relevance for ``sources(keywords, title, snippet, rank, total)``."""
    text = F.lower(F.concat_ws(" ", "title", "snippet"))
    matched = let(text, lambda t: F.filter("keywords", lambda k: F.contains(t, F.lower(k))))
    share = F.size("matched_keywords") / F.greatest(F.size("keywords"), F.lit(1))
    place = 1.0 - F.col("rank") / F.greatest(F.col("total"), F.lit(1))
    return sources.withColumn("matched_keywords", matched).withColumn("relevance", F.round(0.6 * share + 0.4 * place, 2))


def external_context(sources: DataFrame) -> DataFrame:
    """(kind, n, line): numbered context lines per kind; missing fields get their default."""
    n = F.row_number().over(W.partitionBy("qset_id", "kind").orderBy("rank"))
    numbered = sources.withColumn("n", n.cast("long"))

    def pick(i: int) -> Column:
        return F.when(F.col("kind") == "patent", EXTERNAL_DEFAULTS["patent"][i]).otherwise(EXTERNAL_DEFAULTS["scholar"][i])

    def given(c: Column, i: int) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(pick(i))

    line = F.trim(
        F.format_string(
            "[%s%d] «%s» — %s. %s. %s. %s", pick(0), "n", F.coalesce("title", F.lit("")), given(F.array_join("authors", ", "), 1),
            given(F.col("year").cast("string"), 2), given(F.col("venue"), 3), F.trim(F.coalesce("snippet", F.lit(""))),
        )
    )
    return numbered.select("qset_id", "kind", "n", line.alias("line"))


PROMPT_TEMPLATE = (
    "Answer only from the fragments. Mark every statement and number with its fragment [N]; say what is missing.\n\n"
    "FRAGMENTS:\n%s\n\nQUESTION: %s\n\nANSWER:"
)


def prompt_table(cited: DataFrame, questions: DataFrame, template: str = PROMPT_TEMPLATE) -> DataFrame:
    """(qset_id, prompt) for an offline model run over the questions that have citations."""
    per = cited.groupBy("qset_id").agg(F.array_sort(F.collect_list(F.struct("index", "context_line"))).alias("c"))
    context = F.array_join(F.transform("c", lambda x: x["context_line"]), "\n\n")
    return per.join(questions.select("qset_id", "text"), "qset_id").select("qset_id", F.format_string(template, context, "text").alias("prompt"))


def query_history(answers: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Newest answers per user: ``answers(user_id, ts, ...)`` + rank."""
    newest = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return answers.withColumn("rank", F.row_number().over(newest).cast("long")).filter(F.col("rank") <= limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)


def score_within(active: DataFrame, chunks: DataFrame, queries: DataFrame, min_score: float) -> DataFrame:
    """Scores of the chunks of each question's active documents only.

    ``chunks`` carry embeddings. A document that many questions activate is spread.
    """
    variants = queries.groupBy("qset_id").agg(F.collect_list("embedding").alias("vs"))
    pairs = spread_join(active.select("qset_id", "doc_id"), chunks.select("chunk_id", "doc_id", "embedding"), ["doc_id"]).join(variants, "qset_id")
    best = F.round(F.array_max(F.transform("vs", lambda v: dot(v, F.col("embedding")))), SCORE_DIGITS)
    return pairs.select("qset_id", "chunk_id", "doc_id", best.alias("score")).filter(F.col("score") >= min_score)
