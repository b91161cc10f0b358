"""Retrieval queries (R rows of the inventory)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.text import STOPWORDS
from evigraph.operators import documents as D
from evigraph.operators import retrieval as R
from evigraph.operators.chunk_index import ChunkIndex, add_chunks, compact, create_index, delete_documents, indexed_topk, search, stored_chunks
from evigraph.operators.embedding import embed_text, embed_with_model
from evigraph.operators.extraction import parse_extractions, run_extractor
from evigraph.plans.grounded_answers import answer_from_index
from evigraph.queries.checksql import chunks_sql
from evigraph.queries.documents import docs
from evigraph.queries.hooks import load_extractor, load_model
from evigraph.queries.registry import query
from evigraph.queries.text import MATCH, tokens_sql
from evigraph.session import cut_to_table, ensure_checkpoint_dir
from evigraph.sources.answers import answer_documents, question_chains
from evigraph.sources.star import edges, node_names, query_vectors, table, view

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
CV = "cv AS (SELECT chunk_id, doc_id, chunk_no, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM chunk_vectors)"
ALL_SCORES = f"""{CV},
    pair AS (SELECT qset_id, variant_no, chunk_id, doc_id, chunk_no, sum(v * CAST(x AS DOUBLE)) AS s FROM query_vectors JOIN cv USING (pos) GROUP BY ALL),
    sc AS (SELECT qset_id, chunk_id, doc_id, chunk_no, round(max(s), 9) AS score FROM pair GROUP BY ALL)"""


STORED: dict[tuple[str, str, str], ChunkIndex] = {}


def stored_index(spark, d, name, chunks, embed=None) -> ChunkIndex:
    """The index of a table, written once a session below the checkpoint folder and read by all queries."""
    ensure_checkpoint_dir(spark)
    key = (spark.sparkContext.applicationId, d, name)
    if key not in STORED:
        path = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
        STORED[key] = create_index(path, chunks(spark, d), embed)
    return STORED[key]


def vectors(spark, d):
    return view(spark, d, "chunk_vectors")


def chunk_vectors(spark, d):
    return vectors(spark, d).select("*", F.lit("").alias("location"), F.lit("").alias("text"))


def vector_index(spark, d) -> ChunkIndex:
    return stored_index(spark, d, "vectors", chunk_vectors)


def document_chunks(spark, d):
    return D.chunk_documents(docs(spark, d)).withColumn("location", F.array_join("locations", ", ")).drop("locations")


def text_index(spark, d) -> ChunkIndex:
    return stored_index(spark, d, "texts", document_chunks, embed_text)


@query(
    "vector_topk", "query_vectors chunk_vectors",
    f"""WITH {ALL_SCORES}, one AS (SELECT qset_id * 10 + variant_no AS qset_id, chunk_id, round(s, 9) AS score FROM pair WHERE round(s, 9) >= 0.25),
    r AS (SELECT *, row_number() OVER (PARTITION BY qset_id ORDER BY score DESC, chunk_id) AS rank FROM one)
    SELECT qset_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
)
def _(spark, d):
    """Each formulation on its own."""
    single = query_vectors(spark, d).withColumn("qset_id", F.col("qset_id") * 10 + F.col("variant_no"))
    return indexed_topk(vector_index(spark, d), single, 10, R.DISCOVERY_MIN_SCORE).select("qset_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("multi_query_max", "query_vectors chunk_vectors", f"WITH {ALL_SCORES} SELECT qset_id, chunk_id, round(score, 6) AS score FROM sc WHERE score >= 0.25")
def _(spark, d):
    return search(vector_index(spark, d), query_vectors(spark, d), 0.25).select("qset_id", "chunk_id", F.round("score", 6).alias("score"))


@query(
    "candidate_pool", "query_vectors chunk_vectors",
    f"WITH {ALL_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY qset_id ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE score >= 0.35) SELECT qset_id, chunk_id, rank FROM r WHERE rank <= 24",
)
def _(spark, d):
    return indexed_topk(vector_index(spark, d), query_vectors(spark, d), R.TOP_K * R.POOL_FACTOR, R.MIN_SCORE).select("qset_id", "chunk_id", "rank")


@query(
    "index_updates", "query_vectors chunk_vectors",
    f"""WITH {ALL_SCORES}, live AS (SELECT * FROM sc WHERE doc_id % 5 <> 2), r AS (SELECT *, row_number() OVER (PARTITION BY qset_id ORDER BY score DESC, chunk_id) AS rank FROM live WHERE score >= 0.25)
    SELECT qset_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 50""",
)
def _(spark, d):
    """An index in its life: nine tenths written, the rest added, every fifth document deleted, then compacted."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
    chunks = chunk_vectors(spark, d)
    create_index(path, chunks.filter("pmod(xxhash64(chunk_id), 10) < 9"), None)
    add_chunks(path, chunks, None)
    delete_documents(path, chunks.filter("doc_id % 5 = 2").select("doc_id"))
    index = compact(path, spark)
    return indexed_topk(index, query_vectors(spark, d), 50, R.DISCOVERY_MIN_SCORE).select("qset_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


DISCOVERY = f"""{ALL_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY qset_id ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE score >= 0.25 AND chunk_no < 3),
    ds AS (SELECT qset_id, doc_id, max(score) AS score FROM r WHERE rank <= 20 GROUP BY ALL)"""


def discovered(spark, d):
    head = lambda rows: rows.filter(F.col("chunk_no") < R.DISCOVERY_CHUNKS)
    return R.doc_scores(indexed_topk(vector_index(spark, d), query_vectors(spark, d), R.DISCOVERY_TOP_K, R.DISCOVERY_MIN_SCORE, head))


@query("doc_discovery", "query_vectors chunk_vectors", f"WITH {DISCOVERY} SELECT qset_id, doc_id, round(score, 6) AS score FROM ds")
def _(spark, d):
    return discovered(spark, d).withColumn("score", F.round("score", 6))


@query(
    "activation_floor", "query_vectors chunk_vectors",
    f"""WITH {DISCOVERY}, m AS (SELECT *, max(score) OVER (PARTITION BY qset_id) AS best FROM ds),
    k AS (SELECT *, row_number() OVER (PARTITION BY qset_id ORDER BY score DESC, doc_id) AS rank FROM m WHERE score >= greatest(0.35, 0.7 * best))
    SELECT qset_id, doc_id, rank FROM k WHERE rank <= 5""",
)
def _(spark, d):
    return R.activation_floor(discovered(spark, d)).select("qset_id", "doc_id", "rank")


@query(
    "query_signals", "",
    """WITH w AS (SELECT p_partkey, p_size, unnest(list_concat(['compare', 'brand', 'with', 'tests'], string_split(p_name, ' '))) AS t FROM part)
    SELECT p_partkey AS qset_id, array_to_string(list_sort(list_distinct([CAST(100 + p_size AS VARCHAR) || 'mg/l', 'mg', 'ad' || CAST(p_partkey AS VARCHAR), CAST(100 + p_size AS VARCHAR), 'pvp'])), ' ') AS hard,
      string_agg(DISTINCT t, ' ' ORDER BY t) FILTER (WHERE length(t) > 3) AS terms FROM w GROUP BY p_partkey, p_size""",
)
def _(spark, d):
    s = lambda e: F.expr(f"cast({e} as string)")
    first = F.concat(F.lit("Compare "), "p_name", F.lit(" brand at "), s("100 + p_size"), F.lit(" mg/l with AD"), s("p_partkey"), F.lit(" PVP"))
    q = table(spark, d, "part").select(
        F.col("p_partkey").alias("qset_id"),
        F.inline(F.array(F.struct(F.lit(0).alias("variant_no"), first.alias("text")), F.struct(F.lit(1).alias("variant_no"), F.concat("p_name", F.lit(" tests")).alias("text")))),
    )
    sig = R.query_signals(q)
    return sig.select("qset_id", F.array_join(F.array_sort("hard"), " ").alias("hard"), F.array_join(F.array_sort("terms"), " ").alias("terms"))


@query("embedder_hook")
def _(spark, d):
    """A model object made once per worker: letter counts of the text."""
    return embed_with_model(docs_text(spark, d), load_model).select("doc_id", "embedding")


@query("extractor_hook")
def _(spark, d):
    chunks = D.chunk_documents(docs(spark, d))
    return parse_extractions(run_extractor(chunks, load_extractor))[0]


def docs_text(spark, d):
    from evigraph.sources.star import documents

    return documents(spark, d).select("doc_id", "text")


META = "dm AS (SELECT doc_id, 'Document ' || CAST(doc_id AS VARCHAR) AS title, source || '/' || lang AS source_name, CASE WHEN n_chars = 0 THEN 'error' ELSE 'ready' END AS status, n_chars AS num_chunks, quality = 1 AS attached, CASE WHEN toxic = 0 THEN 'full' WHEN toxic = 1 THEN 'abstract' END AS index_mode, CASE WHEN lang = 'fr' THEN 'link' WHEN lang = 'es' THEN 'file' ELSE 'corpus' END AS source_type, n_chars AS added_at FROM documents LEFT JOIN labels USING (doc_id))"


def docs_meta(spark, d):
    """Document states: quality decides attachment, toxicity the index mode, unlabelled ones are undecided."""
    j = docs_text(spark, d).drop("text").join(table(spark, d, "documents").drop("text"), "doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select(
        "doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.concat("source", F.lit("/"), "lang").alias("source_name"),
        F.when(F.col("n_chars") == 0, "error").otherwise("ready").alias("status"), F.col("n_chars").alias("num_chunks"), (F.col("quality") == 1).alias("attached"),
        F.when(F.col("toxic") == 0, "full").when(F.col("toxic") == 1, "abstract").alias("index_mode"),
        F.when(F.col("lang") == "fr", "link").when(F.col("lang") == "es", "file").otherwise("corpus").alias("source_type"), F.col("n_chars").alias("added_at"),
    )


@query(
    "searchable_filter", "",
    f"WITH {META} SELECT doc_id FROM dm WHERE status = 'ready' AND num_chunks > 0 AND coalesce(attached, true) AND (coalesce(index_mode, 'full') = 'full' OR source_type IN ('file', 'link'))",
)
def _(spark, d):
    return R.searchable_filter(docs_meta(spark, d)).select("doc_id")


@query("list_documents", "", f"WITH {META} SELECT doc_id, title, added_at FROM dm WHERE attached OR (attached IS NULL AND source_type IN ('file', 'link')) ORDER BY added_at DESC, doc_id")
def _(spark, d):
    return R.list_documents(docs_meta(spark, d)).select("doc_id", "title", "added_at")


@query(
    "attach_state", "attach_log",
    """WITH l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i FROM attach_log),
    st AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, false AS attached, '' AS src, 'abstract' AS mode FROM l
      UNION ALL SELECT l.doc_id, l.i,
        CASE action WHEN 'activate' THEN true WHEN 'attach_manual' THEN true WHEN 'delete' THEN false WHEN 'detach_auto' THEN CASE WHEN src = 'auto' THEN false ELSE attached END ELSE attached END,
        CASE action WHEN 'activate' THEN 'auto' WHEN 'attach_manual' THEN 'manual' WHEN 'delete' THEN '' WHEN 'detach_auto' THEN CASE WHEN src = 'auto' THEN '' ELSE src END ELSE src END,
        CASE action WHEN 'activate' THEN 'full' WHEN 'delete' THEN 'abstract' ELSE mode END
      FROM st JOIN l ON l.doc_id = st.doc_id AND l.i = st.i + 1)
    SELECT doc_id, arg_max(attached, i) AS attached, arg_max(src, i) AS attach_source, arg_max(mode, i) AS index_mode FROM st GROUP BY doc_id""",
)
def _(spark, d):
    return R.attach_state(view(spark, d, "attach_log"))


def embed_sql(name: str, src: str, key: str) -> str:
    return f"""{name}_t AS (SELECT {key}, md5(unnest({tokens_sql('lower(text)')})) AS h FROM {src}),
    {name}_d AS (SELECT {key}, CAST('0x' || left(h, 8) AS BIGINT) % 64 AS dim, sum(CASE WHEN substring(h, 9, 1) < '8' THEN 1.0 ELSE -1.0 END)::DOUBLE AS w FROM {name}_t GROUP BY ALL),
    {name} AS MATERIALIZED (SELECT {key}, dim, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY {key})), 0) AS w FROM {name}_d)"""


@query("embed_text", "", f"WITH {embed_sql('e', 'benchmark', 'item_id')} SELECT item_id, dim, round(w, 6) AS value FROM e WHERE abs(w) > 1e-9")
def _(spark, d):
    values = embed_text(table(spark, d, "benchmark")).select("item_id", F.posexplode("embedding").alias("dim", "value"))
    return values.filter(F.abs("value") > 1e-9).select("item_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def lexical_sql(pool: str) -> str:
    return f"""{pool}_x AS (SELECT p.*, lower(translate(c.text, '{'₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹'}', '01234567890123456789')) AS norm, hard, terms FROM {pool} p JOIN chunks c USING (chunk_id) JOIN sg USING (qset_id)),
    {pool}_w AS (SELECT *, len(list_filter(hard, lambda h: contains(norm || chr(10) || regexp_replace(norm, '(\\d)\\s+({R.UNITS})', '\\1\\2', 'g'), h))) / nullif(len(hard), 0) AS hs, list_distinct(regexp_extract_all(norm, '[а-яёa-z-]+')) AS ws FROM {pool}_x),
    {pool}_l AS (SELECT *, len(list_filter(terms, lambda t: len(list_filter(ws, lambda w: left(w, 3) = left(t, 3) AND {MATCH.format(a='t', b='w')})) > 0)) / nullif(len(terms), 0) AS ts FROM {pool}_w),
    {pool}_r AS (SELECT *, row_number() OVER (PARTITION BY qset_id ORDER BY boosted DESC, score DESC, chunk_id) AS rank FROM (
      SELECT qset_id, chunk_id, doc_id, score, round(score + 0.15 * coalesce(hs * 0.7 + ts * 0.3, hs, ts, 0), 9) AS boosted FROM {pool}_l))"""


# The checking engine has no word boundary for letters outside ASCII, so whole symbols are compared as words.
SYMBOLS = ", ".join(f"'{f[2:-2]}'" for f in R.FORMULAS.split("|") if f.startswith("\\b"))
SUBSTRING_FORMULAS = "|".join(f for f in R.FORMULAS.split("|") if not f.startswith("\\b"))


RAG = f"""{chunks_sql('blocks')},
    vr AS (SELECT item_id AS qset_id, 0 AS variant_no, text FROM benchmark UNION ALL SELECT item_id, 1, split_part(text, '. ', 1) FROM benchmark),
    {embed_sql('ce', 'chunks', 'chunk_id')}, {embed_sql('qe', 'vr', 'qset_id, variant_no')},
    sv AS (SELECT qset_id, variant_no, chunk_id, sum(qe.w * ce.w) AS s FROM qe JOIN ce USING (dim) GROUP BY ALL),
    sc AS MATERIALIZED (SELECT qset_id, chunk_id, doc_id, chunk_no, round(max(s), 9) AS score FROM sv JOIN chunks USING (chunk_id) GROUP BY ALL),
    tk AS (SELECT qset_id, variant_no, list_concat(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({SYMBOLS})), regexp_extract_all(lower(text), '{SUBSTRING_FORMULAS}'), list_transform(regexp_extract_all(text, '\\b[А-ЯA-Z]{{2,}}\\b'), lambda a: lower(a))) AS toks, regexp_extract_all(lower(text), '[А-Яа-яЁёA-Za-z-]+') AS words FROM vr),
    tj AS (SELECT qset_id, list_filter(flatten(list(toks)), lambda t: length(t) >= 2) AS toks, flatten(list(words)) AS words FROM tk GROUP BY qset_id),
    sg AS MATERIALIZED (SELECT qset_id, list_distinct(toks) AS hard, list_filter(list_distinct(words), lambda w: length(w) > 3 AND w NOT IN ({STOP}) AND NOT contains(array_to_string(toks, ' '), w)) AS terms FROM tj),
    st AS (SELECT doc_id, doc_id % 13 <> 0 AS ready, doc_id % 17 = 5 AS upload, doc_id % 19 <> 0 AS attached FROM documents),
    dp AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY qset_id ORDER BY score DESC, chunk_id) AS k FROM sc JOIN st USING (doc_id) WHERE ready AND NOT upload AND score >= 0.25 AND chunk_no < 3) WHERE k <= 80),
    {lexical_sql('dp')},
    dd AS (SELECT qset_id, doc_id, max(score) AS score FROM dp_r WHERE rank <= 20 GROUP BY ALL),
    af AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qset_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT *, max(score) OVER (PARTITION BY qset_id) AS best FROM dd) WHERE score >= greatest(0.35, 0.7 * best)) WHERE rank <= 5),
    sp AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY qset_id ORDER BY sc.score DESC, chunk_id) AS k FROM sc JOIN st USING (doc_id) LEFT JOIN af USING (qset_id, doc_id)
      WHERE ready AND attached AND (upload OR af.rank IS NOT NULL) AND sc.score >= 0.35) WHERE k <= 24),
    {lexical_sql('sp')},
    hits AS (SELECT * FROM sp_r WHERE rank <= 6),
    ci AS (SELECT qset_id, rank AS index, h.doc_id, chunk_id, 'Document ' || CAST(h.doc_id AS VARCHAR) AS title, locations AS location, round(score, 3) AS score, left(text, 280) AS snippet, left(text, 600) AS excerpt, text FROM hits h JOIN chunks USING (chunk_id)),
    cf AS (SELECT item_id AS qset_id, CASE WHEN count(index) = 0 THEN 'нет данных' WHEN arg_min(score, index) >= 0.6 AND count(DISTINCT doc_id) >= 2 THEN 'высокая' WHEN arg_min(score, index) >= 0.45 THEN 'средняя' ELSE 'низкая' END AS confidence FROM benchmark LEFT JOIN ci ON qset_id = item_id GROUP BY item_id)"""


def states(docs):
    """Some documents failed, some are uploads and some are detached, by their ids."""
    i = F.col("doc_id")
    return docs.drop("source_type").withColumns({
        "status": F.when(i % 13 == 0, "error").otherwise("ready"), "source_type": F.when(i % 17 == 5, "file").otherwise("corpus"),
        "num_chunks": F.lit(1), "attached": i % 19 != 0, "index_mode": F.lit("meta"),
    })


def formulations(asked):
    """(qset_id, variant_no, text): the question itself and its first sentence."""
    first = F.split_part("text", F.lit(". "), F.lit(1))
    return asked.select("qset_id", F.inline(F.array(F.struct(F.lit(0).alias("variant_no"), F.col("text")), F.struct(F.lit(1).alias("variant_no"), first.alias("text")))))


def answered(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qset_id"), "text")
    return asked, answer_from_index(text_index(spark, d), states(docs_meta(spark, d)), asked, formulations(asked))


@query("rag_answer", "blocks", f"WITH {RAG} SELECT qset_id, rank, chunk_id, doc_id, round(score, 6) AS score, round(boosted, 6) AS boosted FROM hits")
def _(spark, d):
    hits = answered(spark, d)[1]["hits"]
    return hits.select("qset_id", "rank", "chunk_id", "doc_id", F.round("score", 6).alias("score"), F.round("boosted", 6).alias("boosted"))


@query("rag_active_documents", "blocks", f"WITH {RAG} SELECT qset_id, doc_id, rank FROM af")
def _(spark, d):
    return answered(spark, d)[1]["active"].select("qset_id", "doc_id", "rank")


def _pool(spark, d):
    """Pool of the benchmark questions over all chunks of ready corpus documents, with its signals and texts."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qset_id"), "text")
    variants = formulations(asked)
    corpus = R.ready_corpus(states(docs_meta(spark, d))).select("doc_id")
    index = text_index(spark, d)
    pool = indexed_topk(index, embed_text(variants), R.DISCOVERY_TOP_K * R.POOL_FACTOR, R.DISCOVERY_MIN_SCORE, lambda rows: rows.join(corpus, "doc_id", "left_semi"))
    return pool, R.query_signals(variants), stored_chunks(index)


LEXICAL = f"""{RAG},
    lp AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY qset_id ORDER BY score DESC, chunk_id) AS k FROM sc JOIN st USING (doc_id) WHERE ready AND NOT upload AND score >= 0.25) WHERE k <= 80),
    {lexical_sql('lp')}"""


@query("lexical_score", "blocks", f"WITH {LEXICAL} SELECT qset_id, chunk_id, round(coalesce(hs * 0.7 + ts * 0.3, hs, ts, 0), 6) AS lex FROM lp_l")
def _(spark, d):
    pool, signals, head = _pool(spark, d)
    j = cut_to_table(pool).join(head.select("chunk_id", "text"), "chunk_id").join(signals, "qset_id")
    return j.select("qset_id", "chunk_id", F.round(R.lexical_score(F.col("hard"), F.col("terms"), F.col("text")), 6).alias("lex"))


@query("lexical_rerank", "blocks", f"WITH {LEXICAL} SELECT qset_id, rank, chunk_id, round(boosted, 6) AS boosted FROM lp_r WHERE rank <= 20")
def _(spark, d):
    pool, signals, head = _pool(spark, d)
    return R.lexical_rerank(pool, signals, head, R.DISCOVERY_TOP_K).select("qset_id", "rank", "chunk_id", F.round("boosted", 6).alias("boosted"))


@query("citations", "blocks", f"WITH {RAG} SELECT qset_id, index, doc_id, title, location, score, snippet, sha256('[' || CAST(index AS VARCHAR) || '] (' || title || ', ' || location || '):' || chr(10) || text) AS context_hash FROM ci")
def _(spark, d):
    c = answered(spark, d)[1]["citations"]
    return c.select("qset_id", "index", "doc_id", "title", "location", "score", "snippet", F.sha2("context_line", 256).alias("context_hash"))


@query("answer_confidence", "blocks", f"WITH {RAG} SELECT * FROM cf")
def _(spark, d):
    return answered(spark, d)[1]["confidence"]


@query(
    "extractive_answer", "blocks",
    f"""WITH {RAG}, a AS (SELECT qset_id, string_agg('[' || CAST(index AS VARCHAR) || '] ' || excerpt, chr(10) || chr(10) ORDER BY index) AS t FROM ci GROUP BY qset_id)
    SELECT item_id AS qset_id, t IS NOT NULL AS grounded, sha256(coalesce('{R.EXCERPTS_HEAD}' || chr(10) || chr(10) || t, '{R.NOT_FOUND_ANSWER}')) AS answer_hash FROM benchmark LEFT JOIN a ON qset_id = item_id""",
)
def _(spark, d):
    return answered(spark, d)[1]["answers"].select("qset_id", "grounded", F.sha2("answer", 256).alias("answer_hash"))


def prompt_sql() -> str:
    """The prompt template as a concatenation."""
    head, middle, tail = (p.replace("%%", "%").replace("'", "''") for p in R.PROMPT_TEMPLATE.split("%s"))
    return f"'{head}' || c || '{middle}' || text || '{tail}'"


@query(
    "prompt_table", "blocks",
    f"""WITH {RAG}, x AS (SELECT qset_id, string_agg('[' || CAST(index AS VARCHAR) || '] (' || title || ', ' || location || '):' || chr(10) || text, chr(10) || chr(10) ORDER BY index) AS c FROM ci GROUP BY qset_id)
    SELECT qset_id, sha256({prompt_sql()}) AS prompt_hash FROM x JOIN benchmark ON item_id = qset_id""",
)
def _(spark, d):
    return answered(spark, d)[1]["prompts"].select("qset_id", F.sha2("prompt", 256).alias("prompt_hash"))


EXTERNAL = """ex AS (SELECT *, item_id // 10 AS qset_id, row_number() OVER (PARTITION BY item_id // 10 ORDER BY item_id) - 1 AS rank, count(*) OVER (PARTITION BY item_id // 10) AS total FROM external_sources)"""


def _external(spark, d):
    """Sources of questions, ten ids each, whose keywords are all longer words of the title and one it lacks."""
    src = view(spark, d, "external_sources").withColumn("qset_id", F.floor(F.col("item_id") / 10))
    words = F.array_distinct(F.filter(F.split(F.lower("title"), " "), lambda w: F.length(w) >= 4))
    asked = W.partitionBy("qset_id")
    return src.select(
        "*", F.concat(words, F.array(F.lit("zzz"))).alias("keywords"),
        (F.row_number().over(asked.orderBy("item_id")) - 1).cast("long").alias("rank"), F.count(F.lit(1)).over(asked).alias("total"),
    )


def _authored(sources):
    """Publications have two authors, patents none."""
    authors = F.when(F.col("kind") == "scholar", F.array(F.lit("Doe"), F.lit("Roe"))).otherwise(F.array().cast("array<string>"))
    return sources.select("*", authors.alias("authors"), F.lit("").alias("venue"))


@query(
    "external_relevance", "external_sources",
    f"""WITH {EXTERNAL}, w AS (SELECT item_id, unnest(string_split(lower(title), ' ')) AS w, generate_subscripts(string_split(lower(title), ' '), 1) AS p FROM ex),
    f AS (SELECT item_id, w, min(p) AS p FROM w WHERE length(w) >= 4 GROUP BY ALL),
    u AS (SELECT item_id, list(w ORDER BY p) AS k FROM f GROUP BY item_id),
    k AS (SELECT ex.*, title || ' ' || snippet AS t, list_append(coalesce(k, []), 'zzz') AS k FROM ex LEFT JOIN u USING (item_id)),
    m AS (SELECT *, list_filter(k, lambda x: contains(lower(t), x)) AS mk FROM k)
    SELECT item_id, array_to_string(mk, ',') AS matched, round(0.6 * (len(mk) / len(k)) + 0.4 * (1 - rank / total), 2) AS relevance FROM m""",
)
def _(spark, d):
    return R.external_relevance(_external(spark, d)).select("item_id", F.array_join("matched_keywords", ",").alias("matched"), "relevance")


@query(
    "external_context", "external_sources",
    f"""WITH {EXTERNAL}, n AS (SELECT *, row_number() OVER (PARTITION BY qset_id, kind ORDER BY rank) AS n FROM ex)
    SELECT qset_id, kind, n, trim('[' || CASE WHEN kind = 'patent' THEN 'P' ELSE 'S' END || CAST(n AS VARCHAR) || '] «' || title || '» — ' || CASE WHEN kind = 'patent' THEN 'изобретатели не указаны' ELSE 'Doe, Roe' END || '. ' || CAST(year AS VARCHAR) || '. ' || CASE WHEN kind = 'patent' THEN 'номер не указан' ELSE 'источник не указан' END || '. ' || trim(snippet)) AS line FROM n""",
)
def _(spark, d):
    return R.external_context(_authored(_external(spark, d)))


@query("query_history", "", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 50")
def _(spark, d):
    return R.query_history(table(spark, d, "events")).select("user_id", "event_id", "rank")


@query("answers_export")
def _(spark, d):
    """With the chains of the experiments that cited documents describe and the external sources of each question."""
    asked, parts = answered(spark, d)
    # The parts read the citations several times.
    cited = cut_to_table(parts["citations"].drop("context_line", "excerpt"))
    node = F.concat(F.lit("pub_"), F.col("doc_id").cast("string"))
    chains = question_chains(cited, node_names(spark, d), edges(spark, d), node)
    external = R.external_relevance(_authored(_external(spark, d)))
    return answer_documents(asked, parts["answers"], parts["confidence"], cited, formulations(asked), chains, external)
