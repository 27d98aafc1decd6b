"""Problem 6: texts of itens_avaliacao in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavra.llm.leaks import cleaned, leaked_pairs, passages
from lavra.sources.tables import table


def _passages(spark, directory):
    return passages(table(spark, directory, "documents"), table(spark, directory, "itens_avaliacao"))


def found(spark, directory):
    """Documents that hold an item, or 20 consecutive words of it."""
    return _passages(spark, directory).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def coverage(spark, directory):
    """Words held and share of the item, by document and item."""
    return leaked_pairs(_passages(spark, directory)).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def items(spark, directory):
    """The leaked items with the number of documents that hold them."""
    pairs = leaked_pairs(_passages(spark, directory)).groupBy("item").agg(F.count("*").alias("documentos"), F.max("cobertura").alias("cobertura"))
    names = table(spark, directory, "itens_avaliacao").select("item_id", "conjunto", "estrato")
    return names.join(pairs.withColumnRenamed("item", "item_id"), "item_id")


def clean(spark, directory):
    """Documents with the passages cut out."""
    return cleaned(table(spark, directory, "documents"), _passages(spark, directory)).withColumnRenamed("doc", "doc_id")


QUERIES = {"p6_found": found, "p6_coverage": coverage, "p6_items": items, "p6_clean": clean}
ORACLES: dict[str, str] = {}
