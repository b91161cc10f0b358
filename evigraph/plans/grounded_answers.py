"""Grounded answers for a batch of questions: discovery, chunk search, citations, answer."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators import retrieval as R
from evigraph.operators.chunk_index import ChunkIndex, create_index, indexed_topk, search, stored_chunks
from evigraph.operators.embedding import embed_text
from evigraph.session import cut_lineage, cut_to_table, ensure_checkpoint_dir


def discover(index: ChunkIndex, corpus: DataFrame, queries: DataFrame, signals: DataFrame) -> DataFrame:
    """Document scores per question from the first chunks of each document in ``corpus(doc_id)``."""
    head = lambda rows: rows.filter(F.col("chunk_no") < R.DISCOVERY_CHUNKS).join(corpus, "doc_id", "left_semi")
    pool = indexed_topk(index, queries, R.DISCOVERY_TOP_K * R.POOL_FACTOR, R.DISCOVERY_MIN_SCORE, head)
    return R.doc_scores(R.lexical_rerank(pool, signals, stored_chunks(index), R.DISCOVERY_TOP_K))


def answer_from_index(
    index: ChunkIndex, docs: DataFrame, questions: DataFrame, variants: DataFrame,
    embed: Callable[[DataFrame], DataFrame] = embed_text, top_k: int = R.TOP_K,
) -> dict[str, DataFrame]:
    """All parts of the answers: active documents, hits, citations, confidence, answer, prompts.

    ``docs(doc_id, title, source_type, source_name, status, num_chunks, attached, index_mode)``,
    ``questions(qset_id, text)``, ``variants(qset_id, variant_no, text)`` with the question itself among them. Ready
    corpus documents are discovered by their first chunks; the best are activated. Searched are the activated
    documents and all uploads, as far as they are ready, attached and have chunks. Only the questions are embedded;
    chunk texts and vectors come from the index, from the cells that can hold a hit.
    """
    queries = cut_lineage(embed(variants))
    signals = R.query_signals(variants)
    corpus = R.ready_corpus(docs).select("doc_id")
    active = cut_to_table(R.activation_floor(discover(index, corpus, queries, signals)))
    indexed = R.searchable_filter(docs.withColumn("index_mode", F.lit("full"))).select("doc_id")
    allowed = active.join(indexed, "doc_id", "left_semi")
    chunks = stored_chunks(index)
    near = chunks.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    uploads = R.searchable_filter(docs).filter(F.col("source_type").isin(*R.UPLOADS)).select("doc_id")
    pool_size = top_k * R.POOL_FACTOR
    found = search(index, queries, R.MIN_SCORE, pool_size, lambda rows: rows.join(uploads, "doc_id", "left_semi"))
    scored = R.score_within(allowed, near, queries, R.MIN_SCORE).unionByName(found)
    hits = cut_to_table(R.lexical_rerank(R.top_scores(scored, pool_size), signals, chunks, top_k))
    cited = R.citations(hits, chunks, docs)
    return {
        "active": active,
        "hits": hits,
        "citations": cited,
        "confidence": R.answer_confidence(cited, questions),
        "answers": R.extractive_answer(cited, questions),
        "prompts": R.prompt_table(cited, questions),
    }


def rag_answer(
    chunks: DataFrame, docs: DataFrame, questions: DataFrame, variants: DataFrame,
    embed: Callable[[DataFrame], DataFrame] = embed_text, top_k: int = R.TOP_K,
) -> dict[str, DataFrame]:
    """``answer_from_index`` over an index that is made for this batch of questions below the checkpoint folder."""
    ensure_checkpoint_dir(chunks.sparkSession)
    path = f"{chunks.sparkSession.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
    return answer_from_index(create_index(path, chunks, embed), docs, questions, variants, embed, top_k)
