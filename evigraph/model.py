"""Vocabulary and schemas of the evidence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The closed vocabulary of node types, edge types and labels.
ENTITY_TYPES = (
    "publication", "experiment", "material", "process", "property", "condition",
    "equipment", "facility", "team", "expert", "topic", "conclusion",
)
RELATION_TYPES = (
    "USES_MATERIAL", "USES_PROCESS", "ON_EQUIPMENT", "AT_CONDITION", "AT_FACILITY",
    "MEASURES_PROPERTY", "PRODUCES_CONCLUSION", "DESCRIBES_EXPERIMENT", "CONDUCTED_BY",
    "AUTHORED_BY", "TAGGED_AS", "MEMBER_OF", "CONTRADICTS", "VALIDATED_BY", "NEEDS_REVIEW",
)
# relation -> (source type, allowed target types)
RELATION_SIGNATURE = {
    "USES_MATERIAL": ("experiment", ("material",)),
    "USES_PROCESS": ("experiment", ("process",)),
    "AT_CONDITION": ("experiment", ("condition",)),
    "AT_FACILITY": ("experiment", ("facility",)),
    "ON_EQUIPMENT": ("experiment", ("equipment",)),
    "MEASURES_PROPERTY": ("experiment", ("property",)),
    "PRODUCES_CONCLUSION": ("experiment", ("conclusion",)),
    "DESCRIBES_EXPERIMENT": ("publication", ("experiment",)),
    "CONDUCTED_BY": ("experiment", ("team", "expert")),
    "AUTHORED_BY": ("publication", ("expert",)),
    "TAGGED_AS": ("publication", ("topic",)),
    "MEMBER_OF": ("expert", ("team",)),
    "CONTRADICTS": ("conclusion", ("conclusion",)),
    "VALIDATED_BY": ("conclusion", ("publication",)),
    "NEEDS_REVIEW": ("conclusion", ("conclusion",)),
}
# anchor type -> relation that links an experiment to it
ANCHOR_RELATION = {
    "material": "USES_MATERIAL",
    "process": "USES_PROCESS",
    "condition": "AT_CONDITION",
    "equipment": "ON_EQUIPMENT",
    "facility": "AT_FACILITY",
    "property": "MEASURES_PROPERTY",
}
# experiment chain step -> relations that fill it, in order
CHAIN_STEPS = {
    "material": ("USES_MATERIAL",),
    "process": ("USES_PROCESS",),
    "equipment": ("ON_EQUIPMENT",),
    "result": ("MEASURES_PROPERTY", "PRODUCES_CONCLUSION"),
}
CHAIN_STEP_LABELS = {"material": "Материал", "process": "Процесс", "equipment": "Оборудование", "result": "Результат"}
CONFIDENCE_HIGH = "высокая"
CONFIDENCE_MEDIUM = "средняя"
CONFIDENCE_LOW = "низкая"
CONFIDENCE_NONE = "нет данных"
CONFIDENCE_UNCHECKED = "не проверено"
CONFIDENCE_EXTERNAL = "внешний источник"
NUMERIC_EVIDENCE_SUFFIXES = ("_mg_l", "_pct", "_m3_h", "_a_m2", "_musd", "_m3_day", "_m", "_c", "_h", "_mpa")
NON_FACT_KEYS = ("source_file", "sources", "confidence", "date")
VERIFIED_TYPES = ("experiment", "conclusion", "publication")
VERIFICATION_FIELDS = ("source_file", "confidence", "date")
KEYWORD_TYPES = ("material", "process", "equipment", "facility", "team", "expert", "topic", "conclusion")
UNTITLED = "(без названия)"

# Schemas of the stored tables.
NODES_SCHEMA = (
    "id string, type string, name string, date string, country string, confidence string, "
    "source_file string, sources array<string>, attrs_num map<string,double>, attrs_str map<string,string>"
)
EDGES_SCHEMA = "source string, target string, type string, attrs_str map<string,string>"
BLOCKS_SCHEMA = "doc_id long, ord long, kind string, location string, text string, ocr boolean"
DOCUMENTS_META_SCHEMA = (
    "id string, title string, source_type string, source_name string, added_at string, num_chunks int, "
    "status string, error string, content_hash string, authors array<string>, source string, year int, "
    "geography string, language string, domain string, reliability_score double, document_summary string, "
    "abstract string, source_path string, index_mode string, attached boolean, attach_source string"
)
EXTRACTION_SCHEMA = (
    "entities array<struct<tmp_id:string,type:string,name:string,attrs:map<string,string>>>, "
    "relations array<struct<source:string,target:string,type:string,attrs:map<string,string>>>"
)


def entity_type_table(spark: SparkSession) -> DataFrame:
    """12 rows, fixed."""
    return spark.createDataFrame([(t,) for t in ENTITY_TYPES], "type string")


def relation_type_table(spark: SparkSession) -> DataFrame:
    """15 rows, fixed."""
    return spark.createDataFrame([(t,) for t in RELATION_TYPES], "type string")


def signature_table(spark: SparkSession) -> DataFrame:
    """15 rows, fixed: the whole ontology constraint set."""
    rows = [(rel, src, list(tgt)) for rel, (src, tgt) in RELATION_SIGNATURE.items()]
    return spark.createDataFrame(rows, "type string, want_source string, want_targets array<string>")
