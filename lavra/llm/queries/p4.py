"""Problem 4: cut answers of chatresponse and dataset_sintetico_v05b."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavra.llm import truncation as T
from lavra.llm.truncation import rates, verdicts
from lavra.sources.tables import table


def answers(spark, directory):
    """Answers of both tables; the source is channel and agent, or origin."""
    chat = table(spark, directory, "chatresponse").select(
        F.lit("chatresponse").alias("tabela"), F.col("resposta_id").cast("bigint").alias("registro"), F.concat_ws("/", F.coalesce("canal", F.lit("")), F.coalesce("multiagente.agente", F.lit(""))).alias("fonte"), F.col("resposta").alias("texto"), F.lit(None).cast("string").alias("pergunta"))
    pairs = table(spark, directory, "dataset_sintetico_v05b").select(F.lit("dataset_sintetico_v05b").alias("tabela"), F.col("id").cast("bigint").alias("registro"), F.col("origem").alias("fonte"), F.col("resposta").alias("texto"), "pergunta")
    return chat.unionByName(pairs)


def found(spark, directory):
    """Records whose answer was cut."""
    return verdicts(answers(spark, directory)).where("cortado").select("tabela", "registro")


def rate(spark, directory):
    """Truncation rate of every source."""
    return rates(verdicts(answers(spark, directory)))


def ends(spark, directory):
    """Every answer's form, share at which its last trigram stands at ends, and verdict."""
    return verdicts(answers(spark, directory))


QUERIES = {"p4_found": found, "p4_rates": rate, "p4_ends": ends}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_LETTER = _quoted(T.LETTER)
_TEXTS = """textos AS (
  SELECT 'chatresponse' AS tabela, resposta_id AS registro, coalesce(canal, '') || '/' || coalesce(multiagente.agente, '') AS fonte, resposta AS texto, NULL AS pergunta FROM chatresponse
  UNION ALL SELECT 'dataset_sintetico_v05b', id, origem, resposta, pergunta FROM dataset_sintetico_v05b)"""
_WORDS = f"""corpos AS (
  SELECT md5(texto) AS d, regexp_replace(regexp_replace(texto, {_quoted(T.REFERENCES)}, ''), {_quoted(T.LAST_CITATIONS)}, '') AS corpo
  FROM (SELECT texto FROM textos UNION SELECT pergunta FROM textos) WHERE regexp_matches(texto, '\\S')),
lidos AS (
  SELECT d, corpo, regexp_matches(corpo, {_quoted(T.LAST_DOTS)}) AS reticencias,
    regexp_replace(regexp_replace(regexp_replace(corpo, {_quoted(T.LAST_DOTS)}, ''), {_quoted(T.CITATION)}, '', 'g'), {_quoted(T.BOUNDARY)}, '\\1\\4\\6 ⏎⏎ \\2\\3\\5\\7', 'g') AS t FROM corpos),
palavras AS (
  SELECT d, corpo, reticencias, CASE WHEN regexp_matches(corpo, {_quoted(T.LIST_LINE)}) THEN 'lista' WHEN regexp_matches(corpo, {_quoted(T.SEVERAL)}) THEN 'texto' ELSE 'frase' END AS forma,
    ['⏎', '⏎', '⏎'] || regexp_extract_all(translate(lower(regexp_replace(t, '[0-9]+', '0', 'g')), '*)', '••'), {_quoted(T.TOKEN)}) || ['⏏', '⏏'] AS p FROM lidos)"""
_COUNTS = f"""posicoes AS (SELECT unnest(p[1:len(p) - 4]) AS a, unnest(p[2:len(p) - 3]) AS b, unnest(p[3:len(p) - 2]) AS c, unnest(p[4:len(p) - 1]) AS y, unnest(p[5:]) AS z FROM palavras),
contadas AS (
  SELECT a, b, c, a IN ('-', '•') AS item, y IN ('⏎', '⏏') OR (y IN ('.', '!', '?') AND z IN ('⏎', '⏏')) AS fim FROM posicoes
  WHERE c <> '⏎' AND NOT (y = '⏏' AND regexp_matches(c, {_LETTER}))),
tri AS (SELECT a, b, c, count(*) AS n, count(*) FILTER (WHERE fim) AS f FROM contadas GROUP BY ALL),
bi AS (SELECT b, c, item, count(*) AS n, count(*) FILTER (WHERE fim) AS f FROM contadas GROUP BY ALL),
uni AS (SELECT c, count(*) AS n, count(*) FILTER (WHERE fim) AS f FROM contadas GROUP BY ALL)"""
_ENDS = f"""fins AS (
  SELECT d, reticencias, forma, len(list_filter(p, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))) > 0 AS dito, regexp_matches(p[-3], {_LETTER}) AS aberto, p[-5] IN ('-', '•') OR p[-4] IN ('-', '•') OR (p[-5] = '⏎' AND forma = 'frase') AS curto, p[-5] AS a, p[-4] AS b, p[-3] AS c,
    md5(lower(trim(regexp_replace(corpo, '[.!?]$', '')))) AS dn FROM palavras),
registros AS (
  SELECT tabela, registro, md5(texto) AS d, fonte, length(texto) AS tamanho FROM textos WHERE registro IS NOT NULL AND regexp_matches(texto, '\\S')
  QUALIFY row_number() OVER (PARTITION BY tabela, registro ORDER BY md5(texto), fonte NULLS FIRST) = 1),
ditos AS (SELECT dn, count(*) - 1 AS outros FROM (SELECT d FROM registros UNION ALL SELECT md5(pergunta) FROM textos) JOIN fins USING (d) WHERE NOT reticencias GROUP BY dn),
contados AS (
  SELECT tabela, registro, fonte, tamanho, reticencias, forma, dito, aberto, curto, CASE WHEN fins.c IN ('.', '!', '?') THEN 1e0 WHEN fins.c IN (',', '(', '–', '—') OR (aberto AND NOT curto) THEN 0.01e0 ELSE 0.5e0 END AS base, CASE WHEN reticencias THEN 0 ELSE outros END AS outros, CASE WHEN aberto OR NOT dito THEN 0 ELSE 1 END AS own,
    coalesce(tri.n, 0) - own AS n3, coalesce(tri.f, 0) - own AS f3, coalesce(bi.n, 0) - own AS n2, coalesce(bi.f, 0) - own AS f2, coalesce(uni.n, 0) - own AS n1, coalesce(uni.f, 0) - own AS f1
  FROM registros JOIN fins USING (d) LEFT JOIN ditos USING (dn) LEFT JOIN tri ON tri.a = fins.a AND tri.b = fins.b AND tri.c = fins.c
  LEFT JOIN bi ON bi.b = fins.b AND bi.c = fins.c AND bi.item = (fins.a IN ('-', '•')) LEFT JOIN uni ON uni.c = fins.c)"""
_VERDICTS = """medidos AS (
  SELECT *, n1 = 0 OR n2 >= 3 AS sabido, tamanho // 40 AS faixa,
    greatest(outros / (outros + 0.5e0), (f3 + 5e0 * (f2 + 5e0 * (f1 + 5e0 * base) / (n1 + 5e0)) / (n2 + 5e0)) / (n3 + 5e0)) AS parte FROM contados),
claros AS (SELECT *, parte <= 0.05 / 5 OR (parte <= 0.05 AND sabido AND NOT curto AND forma <> 'lista') AS claro FROM medidos),
grupos AS (SELECT tabela, fonte, faixa, forma, count(*) FILTER (WHERE claro) * 2 > count(*) AS maioria FROM claros WHERE aberto GROUP BY ALL),
vistos AS (
  SELECT m.tabela, m.registro, m.fonte, m.tamanho, m.reticencias, round(m.parte, 6) AS parte,
    m.dito AND (m.claro OR (m.parte < 0.6 AND (m.reticencias OR (m.aberto AND NOT m.curto AND coalesce(g.maioria, false))))) AS cortado
  FROM claros m LEFT JOIN grupos g ON g.tabela = m.tabela AND g.fonte IS NOT DISTINCT FROM m.fonte AND g.faixa = m.faixa AND g.forma = m.forma)"""
_ALL = ",\n".join(["WITH " + _TEXTS, _WORDS, _COUNTS, _ENDS, _VERDICTS])

ORACLES = {
    "p4_found": _ALL + " SELECT tabela, registro FROM vistos WHERE cortado",
    "p4_rates": _ALL + " SELECT tabela, fonte, count(*) AS textos, count(*) FILTER (WHERE cortado) AS cortados, round(avg(cortado::INT), 6) AS taxa FROM vistos GROUP BY 1, 2",
    "p4_ends": _ALL + " SELECT * FROM vistos",
}
