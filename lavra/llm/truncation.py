"""Texts cut off by field limits or in transfer, found by SQL alone.

Texts are read as words and single signs. Trigrams of them are counted inside
texts and at ends, those of sentences, lines and texts alike. A text is cut when
its last trigram is frequent inside texts but almost never stands at an end, or
is not known at all, as when the last word is only the front of one. Every end
meets the counts, whatever it ends with: a stop, a comma, a figure, a list item.
Where a last trigram stands at ends now and then, dots after it, or the endings
of the same source, length and form, decide:
it is cut where most of those without a stop are clear cuts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lavra.sources.durable import cut


@dataclass(frozen=True)
class Settings:
    """Shares of its occurrences at which a trigram stands at ends: up to ``never`` it ends nothing, from ``often`` on it ends texts.

    ``lean`` is the weight, in occurrences, of the share of the last two words in
    that of their trigram, and of the last word's in that of the two; ``unseen``
    the share of a last word that stands nowhere else. Unless the last word is
    such, its last two must stand ``frequent`` times elsewhere to tell. ``band`` is the width in
    characters of the length bands in which a source's endings are compared.
    """

    never: float = 0.05
    often: float = 0.6
    frequent: int = 3
    lean: float = 5.0
    unseen: float = 0.01
    band: int = 40


# Heads of a reference list, citation marks, dots that stand for what is left out.
REFERENCES = r"(?is)\n\s*(refer[eêÊ]ncias?|references|fontes|referenci\w*|r[eêÊ]f\w*)\s*:?\s*(\n.*)?\z|\n\s*\n\s*r\w{0,9}:?\s*\z"
CITATION = r"\s*\[\d+\]"
LAST_CITATIONS = r"(\s*\[\d+\])*\s*\z"
LAST_DOTS = r"(\s*(\.{2,}|…))+\z"
# Where a sentence or line ends; its parts beside the end are put back.
BOUNDARY = r"([.!?][\"”»)']*)\s+([^\p{Ll}\s])|[ \t]*\n\s*([^\p{Ll}\s])|([:;.!?])[ \t]*\n\s*(\p{Ll})|(\p{Ll}[.!?])(\p{Lu})"
TOKEN = r"[a-z0-9_'\p{L}\p{M}\p{N}\x{FFFD}-]+|[^\s]"
LETTER = r"[\p{L}\x{FFFD}]"
# A last line that is a list item, and a text of several sentences or lines.
LIST_LINE = r"(^|\n)[ \t]*([-*•]|\d+[.)])[ \t][^\n]*\z"
SEVERAL = r"[.!?][\"”»)']*\s+[^\p{Ll}\s]|\n"
#: Stand for the end, or the beginning, of a sentence or line, and for the end of a text.
END, LAST = "⏎", "⏏"
#: Signs that end a sentence, and signs that nothing ends with.
STOPS, OPEN = (".", "!", "?"), (",", "(", "–", "—")
#: Marks of list items, after all but the dash are made one.
ITEMS = ("-", "•")


def _spark(pattern: str) -> str:
    """A pattern as a string literal of Spark's SQL."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tokens(text: str) -> str:
    """SQL expression of the words and signs of a text, between marks of ends; figures are all one."""
    for pattern, by in ((f"{CITATION}|{LAST_DOTS}", ""), (BOUNDARY, f"$1$4$6 {END}{END} $2$3$5$7"), ("[0-9]+", "0")):
        text = f"regexp_replace({text}, {_spark(pattern)}, '{by}')"
    return f"concat(array('{END}', '{END}', '{END}'), regexp_extract_all(translate(lower({text}), '*)', '••'), {_spark(TOKEN)}, 0), array('{LAST}', '{LAST}'))"


def bodies_sql(texts: str) -> str:
    """SQL of (d, corpo) of every different text: its digest, and the text without references and citations at its end."""
    return f"""SELECT md5(texto) AS d, regexp_replace(regexp_replace(texto, {_spark(REFERENCES)}, ''), {_spark(LAST_CITATIONS)}, '') AS corpo
FROM (SELECT DISTINCT texto FROM (SELECT explode(array(texto, pergunta)) AS texto FROM {texts}) WHERE texto RLIKE {_spark(chr(92) + "S")})"""


def _keys(a: str, b: str, c: str) -> str:
    """Hashes of three words, of the last two and of the last; two that begin a list item are two of their own kind."""
    item = f"{a} IN {ITEMS}"
    return f"xxhash64({a}, {b}, {c}) AS abc, xxhash64({b}, {c}, {item}) AS bc, xxhash64({c}) AS c"


def trigrams_sql(texts: str) -> str:
    """SQL of (abc, bc, c, n, f): how often each trigram stands in the different texts, and how often at ends.

    The end of a text counts as one where no letter stands last; after a letter it
    may be a cut and counts for nothing. Trigrams are grouped by their hashes.
    """
    return f"""
SELECT {_keys("a", "b", "c")}, count(*) AS n, count_if(y IN ('{END}', '{LAST}') OR (y IN {STOPS} AND z IN ('{END}', '{LAST}'))) AS f
FROM (SELECT {_tokens("corpo")} AS p FROM ({bodies_sql(texts)})) LATERAL VIEW inline(arrays_zip(slice(p, 1, size(p) - 4), slice(p, 2, size(p) - 4), slice(p, 3, size(p) - 4), slice(p, 4, size(p) - 4), slice(p, 5, size(p) - 4))) AS a, b, c, y, z
WHERE c <> '{END}' AND NOT (y = '{LAST}' AND c RLIKE {_spark(LETTER)}) GROUP BY 1, 2, 3"""


def ends_sql(texts: str) -> str:
    """SQL of the end of every different text: digests of the text and of its words, form, what its last word says by itself, and the hashes of its last words."""
    a, b, c = (f"element_at(p, -{k})" for k in (5, 4, 3))
    short = f"{a} IN {ITEMS} OR {b} IN {ITEMS} OR ({a} = '{END}' AND forma = 'frase')"
    # The last words of a long text are read off its tail; where that holds few, whole.
    return f"""
SELECT d, md5(lower(trim(regexp_replace(corpo, '[.!?]$', '')))) AS dn, corpo RLIKE {_spark(LAST_DOTS)} AS reticencias, forma, corpo RLIKE {_spark("[" + chr(92) + "p{L}" + chr(92) + "p{N}]")} AS dito, {c} RLIKE {_spark(LETTER)} AS aberto, {short} AS curto,
  CASE WHEN {c} IN {STOPS} THEN 'fim' WHEN {c} IN {OPEN} THEN 'meio' WHEN {short} OR NOT {c} RLIKE {_spark(LETTER)} THEN 'nada' ELSE 'meio' END AS diz, {_keys(a, b, c)}
FROM (
  SELECT d, corpo, CASE WHEN corpo RLIKE {_spark(LIST_LINE)} THEN 'lista' WHEN corpo RLIKE {_spark(SEVERAL)} THEN 'texto' ELSE 'frase' END AS forma, if(length(corpo) > 160 AND size(t) >= 13, t, {_tokens("corpo")}) AS p
  FROM (SELECT d, corpo, {_tokens("right(corpo, 160)")} AS t FROM ({bodies_sql(texts)})))"""


def measured_sql(texts: str, ends: str, trigrams: str, share: str) -> str:
    """SQL of every record's end with its ``share``: an expression of how often its last trigram, two words and word stand anywhere (n3, n2, n1) and at ends (f3, f2, f1), its own end left out.

    ``outros`` is how many other records give or ask the same, with or without a
    stop but not with dots. Records are joined to the counts of the different ends
    only, so that a usual last word is one row there.
    """
    return f"""
WITH registros AS (
  SELECT tabela, registro, x.d, x.fonte, x.tamanho FROM (
    SELECT tabela, registro, min(named_struct('d', md5(texto), 'fonte', fonte, 'tamanho', CAST(length(texto) AS BIGINT))) AS x
    FROM {texts} WHERE registro IS NOT NULL AND texto RLIKE {_spark(chr(92) + "S")} GROUP BY tabela, registro)),
bigramas AS (SELECT bc, c, sum(n) AS n, sum(f) AS f FROM {trigrams} GROUP BY bc, c),
unigramas AS (SELECT c, sum(n) AS n, sum(f) AS f FROM bigramas GROUP BY c),
contados AS (
  SELECT e.abc, coalesce(t.n, 0) - own AS n3, coalesce(t.f, 0) - own AS f3, coalesce(b.n, 0) - own AS n2, coalesce(b.f, 0) - own AS f2, coalesce(u.n, 0) - own AS n1, coalesce(u.f, 0) - own AS f1
  FROM (SELECT DISTINCT abc, bc, c, if(aberto OR NOT dito, 0, 1) AS own FROM {ends}) e LEFT JOIN {trigrams} t ON t.abc = e.abc LEFT JOIN bigramas b ON b.bc = e.bc LEFT JOIN unigramas u ON u.c = e.c),
ditos AS (SELECT d, count(*) AS vezes FROM (SELECT d FROM registros UNION ALL SELECT md5(pergunta) AS d FROM {texts}) GROUP BY d),
iguais AS (SELECT dn, sum(vezes) - 1 AS outros FROM {ends} JOIN ditos USING (d) WHERE NOT reticencias GROUP BY dn)
SELECT tabela, registro, fonte, tamanho, faixa, reticencias, forma, dito, aberto, curto, sabido, {share} AS parte
FROM (
  SELECT r.*, CAST(floor(r.tamanho / {{band}}) AS BIGINT) AS faixa, f.reticencias, f.forma, f.dito, f.aberto, f.curto, f.diz, k.*, n1 = 0 OR n2 >= {{frequent}} AS sabido, if(f.reticencias, 0, outros) AS outros
  FROM registros r JOIN (SELECT * FROM {ends} LEFT JOIN iguais USING (dn)) f ON f.d = r.d JOIN contados k ON k.abc = f.abc)"""


def _unseen(settings: Settings) -> str:
    """Share at ends of a last word or sign by itself: a stop always ends; an unknown word does not, unless it is one of two words alone, or of two of a list item, which may be all there is to say."""
    return f"CASE diz WHEN 'fim' THEN 1e0 WHEN 'meio' THEN {settings.unseen}e0 ELSE 0.5e0 END"


def _clear(share: str, settings: Settings) -> str:
    """Condition of a clear cut: the share is low and rests on the last two words; one that rests on less, or is of a list item or of two words alone, must be far lower."""
    return f"({share} <= {settings.never} / 5 OR ({share} <= {settings.never} AND m.sabido AND NOT m.curto AND m.forma <> 'lista'))"


def _share(lean: float, settings: Settings) -> str:
    """Share at which a last trigram stands at ends; ``lean`` is the weight, in occurrences, of the share of the shorter n-gram in that of the longer."""
    one = f"(f1 + {lean}e0 * {_unseen(settings)}) / (n1 + {lean}e0)"
    two = f"(f2 + {lean}e0 * {one}) / (n2 + {lean}e0)"
    return f"greatest(outros / (outros + 0.5e0), (f3 + {lean}e0 * {two}) / (n3 + {lean}e0))"


def verdict_sql(measured: str, settings: Settings = Settings()) -> str:
    """SQL of every text's end: share at which its last trigram stands at ends, and whether it is cut."""
    return f"""
WITH grupos AS (SELECT tabela, fonte, faixa, forma, count_if({_clear('parte', settings)}) * 2 > count(*) AS cortados FROM {measured} m WHERE aberto GROUP BY tabela, fonte, faixa, forma)
SELECT m.tabela, m.registro, m.fonte, m.tamanho, m.reticencias, round(m.parte, 6) AS parte,
  m.dito AND ({_clear('m.parte', settings)} OR (m.parte < {settings.often} AND (m.reticencias OR (m.aberto AND NOT m.curto AND coalesce(g.cortados, false))))) AS cortado
FROM {measured} m LEFT JOIN grupos g ON g.tabela = m.tabela AND g.fonte <=> m.fonte AND g.faixa = m.faixa AND g.forma = m.forma"""


def _judged(texts: DataFrame, lean: float, settings: Settings) -> DataFrame:
    """Verdicts by shares that lean on shorter n-grams with ``lean``; what several branches read is made once and stored, and holds no text."""
    spark, names = texts.sparkSession, [f"{kind}_{uuid.uuid4().hex}" for kind in ("textos", "fins", "trigramas", "medidos")]
    text, ends, trigrams, measured = names
    texts.createOrReplaceTempView(text)
    try:
        cut(spark.sql(ends_sql(text))).createOrReplaceTempView(ends)
        cut(spark.sql(trigrams_sql(text))).createOrReplaceTempView(trigrams)
        made = measured_sql(text, ends, trigrams, _share(lean, settings)).replace("{band}", str(settings.band)).replace("{frequent}", str(settings.frequent))
        cut(spark.sql(made)).createOrReplaceTempView(measured)
        return spark.sql(verdict_sql(measured, settings))
    finally:
        for name in names:
            spark.catalog.dropTempView(name)


def verdicts(texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Verdict on every text of (tabela, registro, fonte, texto, pergunta).

    One row per (tabela, registro): records read twice count once. Null, empty
    and blank texts, and null ids, give no row; a null source is a source of its
    own. ``pergunta`` may be null; questions are counted as texts too, so that one
    that only repeats its question is whole. A text without letter or digit is
    not cut. Whole texts are counted, over all rows, equal ones once.
    """
    return _judged(texts, settings.lean, settings)


def end_likelihoods(texts: DataFrame, settings: Settings = Settings(), trust: float = 2.0) -> DataFrame:
    """Likelihood (``chance``) that a text ends after its last words, and whether it is cut; inputs and nulls as in :func:`verdicts`.

    The share of a trigram's occurrences that stand at ends is smoothed with that
    of its last two words, and this with that of its last word; ``trust`` is the
    weight of the shorter n-gram in occurrences.
    """
    return _judged(texts, trust, settings).select("tabela", "registro", "parte", "cortado").withColumnRenamed("parte", "chance")


def rates(verdicts_: DataFrame) -> DataFrame:
    """Texts, cut texts and their share, by table and source."""
    from pyspark.sql import functions as F

    return verdicts_.groupBy("tabela", "fonte").agg(F.count("*").alias("textos"), F.count_if("cortado").alias("cortados"), F.round(F.avg(F.col("cortado").cast("double")), 6).alias("taxa"))
