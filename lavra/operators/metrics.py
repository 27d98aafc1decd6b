"""Scores of routers, judges and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, group: Column) -> DataFrame:
    """Accuracy and the four cells of a two-class router, in all (null group) and by group; rows have esperado and previsto."""
    hit = F.col("esperado") == F.col("previsto")
    simple = F.col("esperado") == "SIMPLES"
    return rows.withColumn("grupo", group).rollup("grupo").agg(
        F.count("*").alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("acuracia"),
        F.count_if(simple & hit).alias("vp_s"), F.count_if(~simple & hit).alias("vp_c"), F.count_if(~simple & ~hit).alias("falso_s"), F.count_if(simple & ~hit).alias("falso_c"),
    )


def sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Decided share, accuracy among decided and escalated rows at every threshold of confidence."""
    limits = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("limiar")
    kept = F.col("confianca") >= F.col("limiar")
    hit = F.col("esperado") == F.col("previsto")
    return rows.select("esperado", "previsto", "confianca", limits).groupBy("limiar").agg(
        F.round(F.avg(kept.cast("double")), 6).alias("decididos"), F.round(F.avg(F.when(kept, hit.cast("double"))), 6).alias("acuracia"), F.count_if(~kept).alias("escalados"))


def cascade(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Accuracy, escalation and blended latency when rows below the threshold take the second model's prediction."""
    limits = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("limiar")
    below = F.col("confianca") < F.col("limiar")
    final = F.when(below, F.col("segundo")).otherwise(F.col("previsto"))
    wait = F.col("latencia") + F.when(below, F.col("latencia_segundo")).otherwise(0.0)
    return rows.select("*", limits).groupBy("limiar").agg(F.round(F.avg((final == F.col("esperado")).cast("double")), 6).alias("acuracia"), F.round(F.avg(below.cast("double")), 6).alias("escalados"), F.round(F.avg(wait), 6).alias("latencia"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Bins of confidence with size, accuracy, mean confidence and gap; confidence 1 falls into the last bin."""
    hit = (F.col("esperado") == F.col("previsto")).cast("double")
    placed = rows.withColumn("faixa", F.least(F.floor(F.col("confianca") * bins), F.lit(bins - 1)).cast("int")).withColumn("acerto", hit)
    return placed.groupBy("faixa").agg(F.count("*").alias("n"), F.avg("acerto").alias("acuracia"), F.avg("confianca").alias("confianca"), F.sum((F.col("confianca") - F.col("acerto")) ** 2).alias("quadrado"))


def ece_brier(bins: DataFrame) -> DataFrame:
    """Expected calibration error and Brier score, from the bins alone."""
    total = F.sum("n")
    return bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("acuracia") - F.col("confianca"))) / total, 6).alias("ece"), F.round(F.sum("quadrado") / total, 6).alias("brier"))


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word edit distance over the reference's length (at least 1); null if either side is null.

    Every different word of a pair becomes one character, so that the built-in
    distance of texts is that of words. A pair has at most 55,000 different ones.
    """
    words = F.array_distinct(F.concat(reference, hypothesis))
    sign = lambda w: F.lpad(F.hex(F.array_position(words, w)), 4, "0")
    text = lambda side: F.decode(F.unhex(F.array_join(F.transform(side, sign), "")), "UTF-16BE")
    distance = F.levenshtein(text(reference), text(hypothesis)) / F.greatest(F.size(reference), F.lit(1))
    return F.when(F.size(words) > 55_000, F.raise_error(F.lit("over 55,000 different words in a pair"))).otherwise(distance)


def set_shares(sets: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """(id, dentro) per distinct token of ``sets`` (id, keys, termo): how many of its tokens ``others`` (keys, termo) hold."""
    there = others.select(*keys, "termo").distinct().withColumn("tem", F.lit(1))
    return sets.select("id", *keys, "termo").distinct().join(there, [*keys, "termo"], "left").groupBy("id").agg(F.count("tem").alias("dentro"), F.count("*").alias("termos"))
