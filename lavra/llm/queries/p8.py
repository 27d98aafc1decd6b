"""Problem 8: languages of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavra.llm.languages import fit, identify, mislabelled
from lavra.sources.tables import table


def _segments(spark, directory):
    documents = table(spark, directory, "documents")
    return identify(documents, fit(table(spark, directory, "amostras_idioma"), documents)).withColumnRenamed("doc", "doc_id")


def found(spark, directory):
    """Segments of documents whose label is missing or wrong, or that mix languages."""
    return mislabelled(_segments(spark, directory)).select("doc_id", "segmento", "idioma")


def segments(spark, directory):
    """Every segment with its language and confidence."""
    return _segments(spark, directory)


def summary(spark, directory):
    """Documents by label code and found language."""
    first = _segments(spark, directory).where("segmento = 0")
    return first.groupBy(F.coalesce("rotulo", F.lit("")).alias("rotulo"), F.when(F.col("segmentos") > 1, F.lit("misto")).otherwise(F.col("idioma")).alias("idioma")).agg(F.count("*").alias("documentos"), F.round(F.avg("confianca"), 4).alias("confianca"))


QUERIES = {"p8_found": found, "p8_segments": segments, "p8_summary": summary}
ORACLES: dict[str, str] = {}
