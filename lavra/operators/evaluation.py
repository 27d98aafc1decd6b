"""Aggregates over evaluated answers. A row is one answer to one question; verdict columns are null where no judge saw it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.functions.text import tokens
from lavra.operators.routing import cost


def held_share(expected: Column, text: Column) -> Column:
    """Share of the distinct expected tokens that a text holds; null without expected ones."""
    wanted = F.array_distinct(tokens(expected))
    return F.size(F.array_intersect(wanted, tokens(text))) / F.nullif(F.size(wanted), F.lit(0))


def share(part: Column, whole: Column | None = None) -> Column:
    """Share of rows that ``part`` holds for among those of ``whole`` (all without it); 0 where there are none."""
    if whole is None:
        return F.round(F.avg(part.cast("double")), 3)
    return F.round(F.count_if(part & whole) / F.greatest(F.lit(1), F.count_if(whole)), 3)


def answer_metrics() -> list[Column]:
    """Recall, accuracy over the judged and over all, abstention and citation rates of a group of answers."""
    return [
        F.count("*").alias("n"), F.round(F.avg("recall"), 3).alias("recall"), share(F.col("correta"), F.col("julgada")).alias("acerto_julgadas"), share(F.coalesce("correta", F.lit(False))).alias("acerto_todas"),
        share(F.col("absteve") == F.col("deve")).alias("abstencao_correta"), F.count_if(F.col("absteve") & ~F.col("deve")).alias("abstencao_indevida"), share(F.col("absteve"), ~F.col("deve")).alias("taxa_indevida"),
        share(F.size("marcas") > 0, ~F.col("absteve")).alias("citacao"), F.count_if(~F.col("julgada")).alias("nao_julgadas"),
    ]


def route_metrics() -> list[Column]:
    """Verdicts, abstentions, tokens, cost, latency and fallbacks of a group of answers."""
    right = F.count_if(F.col("julgada") & F.col("correta"))
    judged = F.count_if("julgada")
    return [
        F.count("*").alias("n"), judged.alias("julgadas"), right.alias("acertos"), F.round(right / F.nullif(judged, F.lit(0)), 3).alias("acuracia"), F.count_if(F.col("julgada") & F.col("alucinou")).alias("alucinacoes"),
        F.round(F.coalesce(F.sum(F.when(F.col("julgada"), F.col("nota"))), F.lit(0)) / F.greatest(F.lit(1), judged), 2).alias("nota_media"), share(F.col("absteve") == F.col("deve")).alias("abstencao_correta"),
        share(F.col("respondida"), ~F.col("absteve")).alias("nao_vazias"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.round(cost(F.sum("prompt"), F.sum("completion")), 5).alias("custo"),
        F.round(F.avg(F.coalesce("latencia", F.lit(0.0))), 2).alias("latencia_media"), F.count_if("reserva").alias("reservas"),
    ]


def citation_kinds(most: int) -> list[Column]:
    """Answers with a body, with citations, and of these those faithful to the expected documents, outside them, and with a mark beyond ``most``."""
    body = ~F.col("absteve")
    cited = body & (F.size("marcas") > 0) & (F.size("esperados") > 0)
    faithful = (F.size("docs") > 0) & (F.size(F.array_except("docs", "esperados")) == 0)
    return [F.count_if(body).alias("corpo"), F.count_if(cited).alias("com_citacao"), F.count_if(cited & faithful).alias("fiel"), F.count_if(cited & ~faithful).alias("fora"), F.count_if(cited & F.exists("marcas", lambda n: n > most)).alias("fantasma")]


def confidence(answer: Column, probabilities: Column) -> Column:
    """A model's own confidence, else its greatest probability, else one half."""
    return F.coalesce(answer, F.array_max(F.map_values(probabilities)), F.lit(0.5))


def expected_score(probabilities: Column) -> Column:
    """Mean of the scores that are the keys of a map, weighted with their probabilities; null without any."""
    pairs = F.map_entries(probabilities)
    total = F.aggregate(pairs, F.lit(0.0), lambda s, e: s + e["value"])
    return F.aggregate(pairs, F.lit(0.0), lambda s, e: s + e["key"].cast("double") * e["value"]) / F.nullif(total, F.lit(0.0))
