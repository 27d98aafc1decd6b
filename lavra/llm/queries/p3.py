"""Problem 3: noise in the texts of chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavra.llm.scans import noise, repair, repaired
from lavra.sources.durable import cut
from lavra.sources.tables import table


def _repair(spark, directory):
    return repair(table(spark, directory, "chunks"), keep=cut)


def found(spark, directory):
    """The distinct pieces of noise of every chunk."""
    return noise(_repair(spark, directory))


def text(spark, directory):
    """Every chunk's repaired text."""
    chunks = table(spark, directory, "chunks")
    return repaired(chunks, repair(chunks, keep=cut)).withColumnRenamed("chunk", "chunk_id")


def summary(spark, directory):
    """Pieces and chunks by kind of noise and type of chunk."""
    kinds = table(spark, directory, "chunks").select(F.col("id").alias("chunk_id"), F.coalesce(F.lower(F.trim("tipo")), F.lit("texto")).alias("tipo"))
    return found(spark, directory).join(kinds, "chunk_id").groupBy("tipo", "ruido").agg(F.count("*").alias("trechos"), F.countDistinct("chunk_id").alias("chunks"))


QUERIES = {"p3_found": found, "p3_text": text, "p3_summary": summary}
ORACLES: dict[str, str] = {}
