"""Problem 2: defective pairs of dataset_sintetico_v05b."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavra.llm.pairs import defects, languages, train
from lavra.sources.tables import table


def _defects(spark, directory):
    return defects(table(spark, directory, "dataset_sintetico_v05b"), train(table(spark, directory, "amostras_idioma")))


def found(spark, directory):
    """Every defect of every pair."""
    return _defects(spark, directory)


def by_origin(spark, directory):
    """Defects by origin and kind, with their share of the origin's pairs."""
    pairs = table(spark, directory, "dataset_sintetico_v05b").select("id", "origem")
    sizes = pairs.groupBy("origem").agg(F.count("*").alias("pares"))
    counts = _defects(spark, directory).join(pairs, "id").groupBy("origem", "defeito").agg(F.count("*").alias("defeitos"))
    return counts.join(sizes, counts.origem.eqNullSafe(sizes.origem)).select(counts.origem, "defeito", "defeitos", F.round(F.col("defeitos") / F.col("pares"), 6).alias("taxa"))


def language_posteriors(spark, directory):
    """Languages of questions and answers with their leads."""
    rows = languages(table(spark, directory, "dataset_sintetico_v05b"), train(table(spark, directory, "amostras_idioma")))
    return rows.withColumn("adiante_pergunta", F.round("adiante_pergunta", 3)).withColumn("adiante_resposta", F.round("adiante_resposta", 3))


QUERIES = {"p2_found": found, "p2_by_origin": by_origin, "p2_languages": language_posteriors}
ORACLES: dict[str, str] = {}
