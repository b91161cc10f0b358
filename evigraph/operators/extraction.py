"""Raw model completions as mention rows, and the hook that produces completions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import outer_object, typed_attributes
from evigraph.model import ENTITY_TYPES, NON_FACT_KEYS, RELATION_TYPES

# Elements stay JSON text until they are exploded: one bad element cannot spoil its neighbours.
_RAW_SCHEMA = "entities array<string>, relations array<string>"
_ENTITY = "tmp_id string, type string, name string, attrs string"
_RELATION = "source string, target string, type string, attrs string"


def parse_extractions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of ``raw(doc_id, chunk_no, raw)``.

    Fences and prose around the outermost object are ignored. Rows with a missing field or a type
    outside the vocabulary are dropped one by one.
    """
    parsed = raw.select("doc_id", "chunk_no", F.from_json(outer_object(F.col("raw")), _RAW_SCHEMA).alias("j"))

    def rows(field: str, schema: str, types: tuple[str, ...], required: tuple[str, ...]) -> DataFrame:
        # Parsed inside the generator: as a column of its own an element would be parsed again for every field that is
        # tested or read. Outer form, because the emptiness test of the other one computes the array twice.
        items = F.transform(f"j.{field}", lambda x: F.from_json(x, schema))
        one = parsed.select("doc_id", "chunk_no", F.posexplode_outer(items).alias("ord", "e"))
        ok = F.col("e.type").isin(*types)
        for name in required:
            ok = ok & F.col(f"e.{name}").isNotNull()
        return one.filter(ok).withColumn("ord", F.col("ord").cast("long"))

    bag = F.coalesce(F.from_json("e.attrs", "map<string,string>"), F.create_map().cast("map<string,string>"))
    num, txt = typed_attributes(F.col("e.attrs"), NON_FACT_KEYS)
    entities = rows("entities", _ENTITY, ENTITY_TYPES, ("tmp_id", "name")).select(
        "doc_id", "chunk_no", "ord", "e.tmp_id", "e.type", "e.name", num.alias("attrs_num"), txt.alias("attrs_str")
    )
    relations = rows("relations", _RELATION, RELATION_TYPES, ("source", "target")).select(
        "doc_id", "chunk_no", "ord", F.col("e.source").alias("source_tmp"), F.col("e.target").alias("target_tmp"), "e.type", bag.alias("attrs_str")
    )
    return entities, relations


def run_extractor(chunks: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """Completions per chunk from a pluggable extractor: (doc_id, chunk_no, text_hash, raw).

    ``load`` runs once per Python worker and returns a function from texts to completions.
    """

    def complete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "chunk_no": batch["chunk_no"], "text_hash": batch["text_hash"], "raw": model(list(batch["text"]))}
            )

    cols = chunks.select("doc_id", "chunk_no", "text_hash", "text")
    doc_type = cols.schema["doc_id"].dataType.simpleString()
    return cols.mapInPandas(complete, f"doc_id {doc_type}, chunk_no long, text_hash string, raw string")
