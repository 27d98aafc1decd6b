"""Problem 1: samples of perguntas_v05b for the plans of planos_amostra."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavra.llm.proportions import allocate, draw
from lavra.sources.tables import table


def _tables(spark, directory):
    return table(spark, directory, "perguntas_v05b"), table(spark, directory, "planos_amostra")


def found(spark, directory):
    """Lines of a plan whose target the table cannot fill."""
    report = allocate(*_tables(spark, directory))
    return report.where(~F.col("cumprida")).select(F.col("plano_id").cast("int"), F.col("linha").cast("int"))


def report(spark, directory):
    """Target, quota, capacity and allocation of every line."""
    return allocate(*_tables(spark, directory)).drop("inicio")


def sample(spark, directory):
    """The question ids drawn for every line."""
    rows, plans = _tables(spark, directory)
    return draw(rows, allocate(rows, plans))


def shares(spark, directory):
    """Share of each drawn category against its target share, by plan."""
    rows, plans = _tables(spark, directory)
    allocation = allocate(rows, plans)
    drawn = draw(rows, allocation).groupBy("plano_id", "linha").agg(F.count("*").alias("n"))
    sums = drawn.groupBy("plano_id").agg(F.sum("n").alias("soma"))
    lines = allocation.select("plano_id", "linha", "total", "cota").join(drawn, ["plano_id", "linha"], "left").join(sums, "plano_id")
    return lines.select(
        "plano_id", "linha", F.coalesce("n", F.lit(0)).cast("bigint").alias("sorteadas"),
        F.round(F.coalesce("n", F.lit(0)) / F.col("soma"), 6).alias("parte_obtida"), F.round(F.col("cota") / F.nullif(F.col("total"), F.lit(0)), 6).alias("parte_alvo"),
    )


QUERIES = {"p1_found": found, "p1_report": report, "p1_sample": sample, "p1_shares": shares}

_FOLD = "coalesce(regexp_replace(lower(estrato), '[\\s_]+', '', 'g'), '')"
_REPORT = f"""
WITH pop AS (SELECT DISTINCT {_FOLD} AS grupo, coalesce(deve_abster, false) AS marca, id AS chave FROM perguntas_v05b WHERE id IS NOT NULL),
cap AS (SELECT grupo, marca, count(*) AS disponivel FROM pop GROUP BY 1, 2),
l0 AS (SELECT p.plano_id, p.linha, p.grupo, p.marca, total, parte, minimo, coalesce(disponivel, 0) AS disponivel,
  greatest(minimo::DOUBLE, total * parte) AS alvo, minimo > total * parte AS presa0
  FROM (SELECT plano_id, linha, {_FOLD} AS grupo, coalesce(deve_abster, false) AS marca, coalesce(n_total, 0)::BIGINT AS total, coalesce(proporcao, 0.0) AS parte, coalesce(minimo, 0)::BIGINT AS minimo FROM planos_amostra) p
  LEFT JOIN cap ON cap.grupo = p.grupo AND cap.marca = p.marca),
""" + "".join(
    f"""
f{k} AS (SELECT *, sum(CASE WHEN presa{k} THEN minimo ELSE 0 END) OVER (PARTITION BY plano_id) AS gasto{k}, sum(CASE WHEN presa{k} THEN 0.0 ELSE parte END) OVER (PARTITION BY plano_id) AS solta{k}, least(1.0, sum(parte) OVER (PARTITION BY plano_id)) AS inteira{k} FROM l{k}),
j{k} AS (SELECT *, CASE WHEN presa{k} THEN minimo::DOUBLE WHEN solta{k} > 0 THEN greatest(0.0, (total - gasto{k}) * parte / solta{k} * inteira{k}) ELSE 0.0 END AS justa{k} FROM f{k}),
l{k + 1} AS (SELECT *, presa{k} OR minimo > justa{k} AS presa{k + 1} FROM j{k}),"""
    for k in range(4)
) + """
q0 AS (SELECT *, round(greatest(justa3, minimo::DOUBLE), 6) AS justa FROM l4),
q1 AS (SELECT *, round(sum(justa) OVER (PARTITION BY plano_id))::BIGINT - sum(floor(justa)) OVER (PARTITION BY plano_id) AS faltam, row_number() OVER (PARTITION BY plano_id ORDER BY justa - floor(justa) DESC, linha) AS lugar FROM q0),
q2 AS (SELECT *, (floor(justa) + CASE WHEN lugar <= faltam THEN 1 ELSE 0 END)::BIGINT AS cota FROM q1),
q3 AS (SELECT *, greatest(0, disponivel - coalesce(sum(cota) OVER (PARTITION BY plano_id, grupo, marca ORDER BY linha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS livre, row_number() OVER (PARTITION BY plano_id, grupo, marca ORDER BY linha DESC) AS rev FROM q2),
q4 AS (SELECT *, least(cota, livre) AS proprio, CASE WHEN rev = 1 THEN livre - least(cota, livre) ELSE 0 END AS sobra, cota - least(cota, livre) AS aberto FROM q3),
q5 AS (SELECT *, least(sum(aberto) OVER g, sum(sobra) OVER g) AS passado, sum(sobra) OVER g AS folga, sum(sobra) OVER (PARTITION BY plano_id, grupo ORDER BY linha ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ate FROM q4 WINDOW g AS (PARTITION BY plano_id, grupo)),
q6 AS (SELECT *, CASE WHEN folga > 0 THEN floor(passado * ate / folga) - floor(passado * (ate - sobra) / folga) ELSE 0 END AS de_irmaos FROM q5),
q7 AS (SELECT *, sobra - de_irmaos AS resta FROM q6),
q8 AS (SELECT *, least(sum(aberto) OVER g - sum(de_irmaos) OVER g, sum(resta) OVER g) AS passado2, sum(resta) OVER g AS folga2, sum(resta) OVER (PARTITION BY plano_id ORDER BY linha ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ate2 FROM q7 WINDOW g AS (PARTITION BY plano_id)),
q9 AS (SELECT *, CASE WHEN folga2 > 0 THEN floor(passado2 * ate2 / folga2) - floor(passado2 * (ate2 - resta) / folga2) ELSE 0 END AS de_primos FROM q8),
rel AS (SELECT plano_id, linha, grupo, marca, total, round(alvo, 6) AS alvo, disponivel, cota, de_irmaos::BIGINT AS de_irmaos, de_primos::BIGINT AS de_primos, (proprio + de_irmaos + de_primos)::BIGINT AS alocado, greatest(0.0, round(alvo - disponivel, 6)) AS falta, alvo <= disponivel AS cumprida FROM q9)"""
_SAMPLE = """,
tomada AS (SELECT *, coalesce(sum(alocado) OVER (PARTITION BY plano_id, grupo, marca ORDER BY linha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inicio FROM rel),
posta AS (SELECT *, dense_rank() OVER (PARTITION BY grupo, marca ORDER BY md5(chave::VARCHAR || '-42'), chave) AS posto FROM pop),
amostra AS (SELECT t.plano_id, t.linha, p.chave AS id, p.grupo, p.marca, p.posto FROM posta p JOIN tomada t ON t.grupo = p.grupo AND t.marca = p.marca WHERE p.posto > t.inicio AND p.posto <= t.inicio + t.alocado)"""

ORACLES = {
    "p1_found": f"""
WITH cap AS (SELECT {_FOLD} AS grupo, coalesce(deve_abster, false) AS marca, count(DISTINCT id) AS n FROM perguntas_v05b GROUP BY 1, 2)
SELECT plano_id, linha FROM planos_amostra p LEFT JOIN cap ON cap.grupo = {_FOLD.replace('estrato', 'p.estrato')} AND cap.marca = coalesce(p.deve_abster, false)
WHERE greatest(minimo, n_total * proporcao) > coalesce(n, 0)""",
    "p1_report": _REPORT + " SELECT * FROM rel",
    "p1_sample": _REPORT + _SAMPLE + " SELECT * FROM amostra",
    "p1_shares": _REPORT + _SAMPLE + """, conta AS (SELECT plano_id, linha, count(*) AS n FROM amostra GROUP BY 1, 2), soma AS (SELECT plano_id, sum(n) AS s FROM conta GROUP BY 1)
SELECT rel.plano_id, rel.linha, coalesce(n, 0)::BIGINT AS sorteadas, round(coalesce(n, 0) / s, 6) AS parte_obtida, round(cota / nullif(total, 0), 6) AS parte_alvo
FROM rel LEFT JOIN conta ON conta.plano_id = rel.plano_id AND conta.linha = rel.linha JOIN soma ON soma.plano_id = rel.plano_id""",
}
