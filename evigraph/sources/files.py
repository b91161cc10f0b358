"""File listing and plain-text loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus_files(spark: SparkSession, root: str, extensions: list[str], exclude: str = "uploads") -> DataFrame:
    """(path, size, modified) below ``root`` with one of the extensions, outside ``exclude`` folders.

    File contents are not read: only listing columns are selected.
    """
    glob = "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    inside = F.split("path", "/")
    return (
        found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
        .filter(~F.array_contains(inside, exclude))
        .orderBy("path")
    )


def load_texts(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """(path, modified, sha256, text) of text files, one row each."""
    glob = "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return raw.select(
        "path",
        F.date_format("modificationTime", "yyyy-MM-dd").alias("modified"),
        F.sha2("content", 256).alias("sha256"),
        F.decode("content", "UTF-8").alias("text"),
    )
