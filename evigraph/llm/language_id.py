"""Language identification by compression.

Each language gets a raw-content zstandard dictionary made of labelled text. A text is encoded with
every dictionary; the language whose encoding is smallest is its language. Long texts are encoded in
pieces, so that each piece is judged by the dictionary and not by the text before it. A narrow margin
between the two smallest encodings is a rejection: the operator still names the best language and sets
``rejected``.

The dictionaries are fitted on a bounded sample: ``SAMPLE_DOCS`` documents a language with the smallest
hash of (doc_id, text), of each at most ``SAMPLE_CHARS`` characters, cut to ``DICT_BYTES`` a language. That
bound is per language; everything else reads whole texts. The sample is ranked with a group limit before
the shuffle, so a language with most of the rows costs a few rows per task.

Defined results: a null text or one without a letter is ``und`` with score 0; without any labelled
text everything is ``und``. Ties go to the language that sorts first. Repeated rows are judged each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.llm.tables import fold_of, read

SAMPLE_DOCS = 400
SAMPLE_CHARS = 1_000
DICT_BYTES = 24 << 10
PIECE_BYTES = 16 << 10
MARGIN = 0.01  # a second-best encoding less than 1 % longer is a rejection
SHARPNESS = 0.35  # bytes of difference to log-odds
HELD_OUT = "coalesce(fold = 2, true)"


def letters_only(text: str) -> str:
    """Lower-cased words between single spaces: marks, digits and capitals say nothing of the language."""
    return f" {re.sub(r'[^\w]+|[0-9_]+', ' ', text.lower())} "


def coder(content: bytes):
    """Encoder under a raw-content dictionary; tables small enough to be reset for every text."""
    import zstandard as zs

    params = zs.ZstdCompressionParameters.from_level(
        3, window_log=17, hash_log=14, chain_log=14, search_log=4, min_match=4, strategy=zs.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    dictionary = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(compression_params=params, dict_data=dictionary).compress


def fit_dictionaries(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Language to dictionary content, from rows with doc_id, text and lang."""
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "text")
    rows = (
        labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .select("lang", "doc_id", F.substring("text", 1, sample_chars).alias("text"))
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= sample_docs)
        .orderBy("lang", "_r")
        .collect()
    )
    texts: dict[str, list[str]] = {}
    for r in rows:
        texts.setdefault(r["lang"], []).append(letters_only(r["text"]))
    joined = {lang: "\n".join(dict.fromkeys(t)).encode() for lang, t in texts.items()}
    return {lang: joined[lang][:dict_bytes] for lang in sorted(joined)}


def predict_languages(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected for every row of ``docs`` (doc_id, text)."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(dictionaries)  # bounded: DICT_BYTES a language
    piece, sharpness = PIECE_BYTES, SHARPNESS

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import math

        names = list(shared.value)
        coders = [coder(shared.value[name]) for name in names]
        for batch in batches:
            pred, score, margins = [], [], []
            for text, lettered in zip(batch.column("text").to_pylist(), batch.column("lettered").to_pylist(), strict=True):
                if not lettered or not names:
                    pred.append("und"), score.append(0.0), margins.append(0.0)
                    continue
                data = letters_only(text).encode()
                pieces = [data[i : i + piece] for i in range(0, len(data), piece)]
                sizes = [sum(len(code(p)) for p in pieces) for code in coders]
                best = min(range(len(names)), key=sizes.__getitem__)
                others = [s for i, s in enumerate(sizes) if i != best]
                weight = sum(math.exp(-min(50.0, (s - sizes[best]) * sharpness)) for s in others)
                pred.append(names[best])
                score.append(1.0 / (1.0 + weight))
                margins.append((min(others) - sizes[best]) / min(others) if others else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margins, pa.float64())], ["doc_id", "lang_pred", "score", "margin"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    found = rows.mapInArrow(classify, "doc_id long, lang_pred string, score double, margin double")
    return found.withColumn("rejected", (F.col("margin") < margin) | (F.col("lang_pred") == "und"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the documents whose fold is not 2; lang, source and doc_id are no inputs of a prediction."""
    docs = read(spark, sf_dir, "documents")
    learned = fit_dictionaries(docs.filter(fold_of(F.col("doc_id"), 4) != 2))
    found = predict_languages(docs, learned).withColumn("fold", fold_of(F.col("doc_id"), 4))
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op7_language_id": op7_language_id}
