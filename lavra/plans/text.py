"""Text quality, tokens, keys and answers over documents, perguntas_v05b and chatresponse."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavra.functions import quality as Q
from lavra.functions import text as X
from lavra.sources.tables import table

# Page quality ---------------------------------------------------------------


def page_clean(spark, d):
    """Cleaned text of every document with text."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", Q.clean_page(F.col("text")).alias("limpo"))


def line_reject_reasons(spark, d):
    """Lines of all documents by the reason they are dropped for."""
    lines = table(spark, d, "documents").where("text IS NOT NULL").select(F.explode(Q.page_lines(F.col("text"))).alias("linha"))
    return lines.select(F.coalesce(Q.reject_reason(F.col("linha")), F.lit("mantida")).alias("motivo")).groupBy("motivo").agg(F.count("*").alias("linhas"))


def letter_spaced_pages(spark, d):
    """Chunks by type whose text is letter-spaced."""
    rows = table(spark, d, "chunks").where("texto IS NOT NULL")
    return rows.groupBy(F.coalesce("tipo", F.lit("")).alias("tipo")).agg(F.count("*").alias("chunks"), F.count_if(Q.letter_spaced(F.col("texto"))).alias("espacados"), F.round(F.avg(Q.text_ratio(F.col("texto"))), 6).alias("razao_media"))


def doc_titles(spark, d):
    """Title found in the text of every chunk, where there is one."""
    return table(spark, d, "chunks").select("id", Q.title(F.col("texto")).alias("titulo_achado")).where("titulo_achado IS NOT NULL")


# Tokens and keys -----------------------------------------------------------


def token_counts(spark, d):
    """Tokens and distinct tokens of every chunk."""
    t = X.tokens(F.col("texto"))
    return table(spark, d, "chunks").where("texto IS NOT NULL").select("id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distintos"))


def term_frequencies(spark, d):
    """Frequency and document frequency of every term of the chunks."""
    rows = table(spark, d, "chunks").where("texto IS NOT NULL").select("id", F.explode(X.tokens(F.col("texto"))).alias("termo"))
    per = rows.groupBy("termo", "id").agg(F.count("*").alias("n"))
    return per.groupBy("termo").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def query_tokens(spark, d):
    """Tokens of every question without stop words."""
    return table(spark, d, "perguntas_v05b").select("id", "pergunta").distinct().select("id", F.array_join(X.query_tokens(F.col("pergunta")), " ").alias("termos"))


def question_keys(spark, d):
    """The normal forms of every question."""
    q = F.col("pergunta")
    rows = table(spark, d, "perguntas_v05b").select("id", "pergunta").distinct()
    return rows.select("id", X.router_key(q).alias("roteador"), X.scan_key(q).alias("digitalizado"), X.duplicate_key(q).alias("duplicata"), F.array_join(F.array_sort(X.word_set(q)), " ").alias("palavras"), F.array_join(X.lemmas(q), " ").alias("lemas"))


def slugify(spark, d):
    """Slug of every file name of the manifest."""
    return table(spark, d, "manifesto_corpus").select("arquivo", X.file_slug(F.regexp_replace("arquivo", r"\.[A-Za-z0-9]+$", "")).alias("slug"))


def typo_variants(spark, d):
    """The four misspelling operators on every question."""
    q = F.col("pergunta")
    return table(spark, d, "perguntas_v05b").select("id", "pergunta").distinct().select("id", X.unaccent(q).alias("sem_acento"), X.colloquial(q).alias("coloquial"), X.drop_middle(q).alias("sem_meio"), X.swap_middle(q).alias("meio_trocado"))


def question_filter(spark, d):
    """Questions of valid length with a question mark, and those that ask for a negative."""
    q = F.col("pergunta")
    valid = F.length(q).between(12, 240) & q.contains("?")
    negative = X.scan_key(q).rlike(r"\bnao\b")
    return table(spark, d, "perguntas_v05b").select("id", "pergunta").distinct().select("id", valid.alias("valida"), negative.alias("negativa"))


def options(spark, d):
    """Options after the last colon of questions and answers that hold one."""
    rows = table(spark, d, "dataset_sintetico_v05b").where(F.col("pergunta").contains(":"))
    return rows.select("id", F.array_join(X.options(F.col("pergunta")), "|").alias("opcoes"))


def fingerprints(spark, d):
    """Fingerprint of every question, free of terminal codes."""
    return table(spark, d, "perguntas_v05b").select("id", "pergunta").distinct().select("id", X.fingerprint(X.without_ansi(F.col("pergunta"))).alias("digital"))


# Answers -------------------------------------------------------------------


def _answers(spark, d):
    return table(spark, d, "chatresponse").select("resposta_id", "resposta", "abstencao", "referencias").dropDuplicates(["resposta_id"])


def abstention_flags(spark, d):
    """The three abstention tests against the recorded flag."""
    r = F.col("resposta")
    rows = _answers(spark, d).select(F.coalesce("abstencao", F.lit(False)).alias("registrada"), X.abstains(r).alias("qualquer"), X.abstains_at_front(r).alias("inicio"), X.abstains_by_mark(r).alias("marca"))
    return rows.groupBy("registrada", "qualquer", "inicio", "marca").agg(F.count("*").alias("respostas"))


def citation_extract(spark, d):
    """Citation marks of every answer that has any."""
    rows = _answers(spark, d).select("resposta_id", X.citations(F.col("resposta")).alias("c")).where(F.size("c") > 0)
    return rows.select("resposta_id", F.size("c").cast("bigint").alias("marcas"), F.size(F.array_distinct("c")).cast("bigint").alias("distintas"), F.array_max("c").alias("maior"))


def citation_renumber(spark, d):
    """Answers with their marks renumbered by first appearance; marks beyond the references go."""
    rows = _answers(spark, d).where("resposta IS NOT NULL").withColumn("r", X.renumbered(F.col("resposta"), F.coalesce(F.size("referencias"), F.lit(0))))
    return rows.select("resposta_id", F.col("r.texto").alias("texto"), F.array_join(F.transform("r.marcas", lambda n: n.cast("string")), ",").alias("marcas"))


def tts_normalize(spark, d):
    """Answers as they are read aloud."""
    return _answers(spark, d).where("resposta IS NOT NULL").select("resposta_id", X.spoken(F.col("resposta")).alias("falada"))


def _judged(spark, d):
    """Texts of a judge around the values of every event: a draft in braces, then the object, whose reason and details hold braces too."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    values = F.to_json(F.struct((F.col("k") % 5 + 1).alias("nota"), (F.col("k") % 2 == 0).alias("correta"), (F.col("k") % 10 == 0).alias("alucinou"), F.concat(F.lit("{"), F.col("event_type"), F.lit("} diz")).alias("justificativa"), F.struct(F.col("k").alias("peso")).alias("detalhe")))
    return e.select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit("não é json")).when(F.col("event_id") % 7 == 1, values).otherwise(F.concat(F.lit("Veredito {rascunho} "), values, F.lit(" fim"))).alias("dito"))


def verdict_parse(spark, d):
    """Judge verdicts read from texts around a JSON object that nests another and has braces in a string."""
    v = _judged(spark, d).select("event_id", X.verdict(F.col("dito")).alias("v"))
    return v.select("event_id", F.col("v.nota").alias("nota"), F.col("v.correta").alias("correta"), F.col("v.alucinou").alias("alucinou"), F.col("v.justificativa").alias("justificativa"))


def greedy_parse(spark, d):
    """What the greedy reader makes of the same texts: it fails where a draft in braces stands in front."""
    v = _judged(spark, d).select("event_id", X.greedy_verdict(F.col("dito")).alias("v"))
    return v.groupBy(F.col("v.nota").isNotNull().alias("lido")).agg(F.count("*").alias("textos"))


def array_parse(spark, d):
    """Question and answer lists as a model writes them, fenced and with commas too many, read back: rows and characters by origin."""
    rows = table(spark, d, "dataset_sintetico_v05b").where("pergunta IS NOT NULL")
    said = F.concat(F.lit("Aqui está:\n```json\n["), F.to_json(F.struct(F.col("pergunta").alias("q"), F.col("resposta").alias("a"))), F.lit(",]\n```"))
    read = rows.select("origem", F.explode(X.first_array(said, "q:string,a:string")).alias("x"))
    return read.groupBy("origem").agg(F.count("*").alias("pares"), F.sum(F.length("x.q")).alias("caracteres"))


QUERIES = {
    "page_clean": page_clean, "line_reject_reasons": line_reject_reasons, "letter_spaced_pages": letter_spaced_pages, "doc_titles": doc_titles,
    "token_counts": token_counts, "term_frequencies": term_frequencies, "query_tokens": query_tokens, "question_keys": question_keys, "slugify": slugify, "typo_variants": typo_variants,
    "question_filter": question_filter, "options": options, "fingerprints": fingerprints,
    "abstention_flags": abstention_flags, "citation_extract": citation_extract, "citation_renumber": citation_renumber, "tts_normalize": tts_normalize, "verdict_parse": verdict_parse, "greedy_parse": greedy_parse, "array_parse": array_parse,
}

# SQL of the shared pieces, in DuckDB's dialect.
def fold_sql(x: str) -> str:
    return f"strip_accents(lower({x}))"


def tokens_sql(x: str, least: int = 2) -> str:
    return f"regexp_extract_all({fold_sql(x)}, '[a-z0-9]{{{least},}}')"


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
_TRIM = r"regexp_replace({0}, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"
_LINES = "list_transform(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda l: " + _TRIM.format("l") + ")"
_WORDS = "list_filter(string_split_regex({0}, '[\\s\\x0b]+'), lambda w: w <> '')"
_RATIO = "CASE WHEN length({0}) = 0 THEN 1.0 ELSE length(regexp_replace({0}, '[^A-Za-z0-9áéíóúâêôãõç ]', '', 'g')) / length({0}) END"
_SUM = "coalesce(list_sum(list_transform({0}, lambda w: length(w))), 0)"


def _reason(line: str) -> str:
    w = _WORDS.format(line)
    return rf"""CASE WHEN length({line}) < 3 THEN 'curta'
 WHEN regexp_matches({line}, '{Q.EMAIL}') THEN 'email'
 WHEN regexp_matches({line}, '(?i){Q.URL}') THEN 'url'
 WHEN regexp_matches({line}, '^[0-9]') AND len(translate({line}, '0123456789 .,:/%–—-' || chr(9), '')) = 0 THEN 'numerica'
 WHEN length({line}) <= 60 AND regexp_matches({line}, '(?i){Q.HEADER}') THEN 'cabecalho'
 WHEN regexp_matches({line}, '[\x01-\x08\x0b\x0c\x0e-\x1f]') THEN 'controle'
 WHEN {_RATIO.format(line)} < 0.70 THEN 'simbolos'
 WHEN len({w}) = 0 OR {_SUM.format(w)} > len({w}) * 20 OR (len({w}) >= 5 AND {_SUM.format(w)} < len({w}) * 3) THEN 'espacamento' END"""


_SQUEEZE = r"regexp_replace({0}, '[\s\x0b]+', ' ', 'g')"
_SCAN = _SQUEEZE.format("regexp_replace(" + fold_sql("{0}") + ", '[-­][\\s\\x0b]*', '', 'g')")
_UNACCENT = "strip_accents({0})"
_HALF = "(length(strip_accents(pergunta)) // 2)"
_ABSTAIN = r"({0} LIKE '%nao sei%' OR regexp_matches({0}, '\bnao (ha|tenho|existem?) informa'))".format(_SQUEEZE.format("translate(" + fold_sql("resposta") + ", '_-', '  ')"))
_Q = "(SELECT DISTINCT id, pergunta FROM perguntas_v05b)"
_A = "(SELECT resposta_id, any_value(resposta) AS resposta, any_value(abstencao) AS abstencao, any_value(referencias) AS referencias FROM chatresponse GROUP BY resposta_id)"
_SLUG = "regexp_replace(substring(regexp_replace(regexp_replace(" + fold_sql("{0}") + ", '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60), '_+$', '')"
_STEM = r"regexp_replace(arquivo, '\.[A-Za-z0-9]+$', '')"
_BODY = r"array_to_string(list_filter(string_split(resposta, chr(10)), lambda l: NOT regexp_matches(trim(l), '^\[\d+\]\s+[A-Za-z0-9_.-]*\.(pdf)\b')), chr(10))"
_READ = "array_to_string(list_filter(string_split(resposta, chr(10)), lambda l: NOT regexp_matches(trim(l), '^\\[\\d+\\]\\s+[A-Za-z0-9_.-]*\\.pdf\\b')), ' ')"
_SPOKEN = "regexp_replace(trim(" + _SQUEEZE.format(f"regexp_replace({_READ}, '{'|'.join(X.UNSPOKEN)}', ' ', 'g')") + r"), '\s([.,;:!?])', '\1', 'g')"
_COURSE = "(?i)^(?:" + "|".join(X.COURSES) + ")+"
_COPY = "(?i)^(?:" + "|".join(X.COPY_MARKS) + r")\s+"

ORACLES = {
    "page_clean": f"SELECT doc_id, array_to_string(list_filter({_LINES}, lambda l: ({_reason('l')}) IS NULL), chr(10)) AS limpo FROM documents WHERE text IS NOT NULL",
    "line_reject_reasons": f"SELECT coalesce({_reason('linha')}, 'mantida') AS motivo, count(*) AS linhas FROM (SELECT unnest({_LINES}) AS linha FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "letter_spaced_pages": f"""SELECT coalesce(tipo, '') AS tipo, count(*) AS chunks, count(*) FILTER (WHERE len(w) > 0 AND len(list_filter(w, lambda x: length(x) <= 1)) * 4 > len(w)) AS espacados, round(avg(r), 6) AS razao_media
FROM (SELECT tipo, {_WORDS.format('texto')} AS w, {_RATIO.format('texto')} AS r FROM chunks WHERE texto IS NOT NULL) GROUP BY 1""",
    "doc_titles": f"""SELECT id, t AS titulo_achado FROM (SELECT id, list_filter(list_filter({_LINES.replace('text,', 'texto,')}, lambda l: l <> '')[1:5], lambda l: length(l) > 3 AND regexp_matches(l, '\\p{{Lu}}') AND NOT regexp_matches(l, '\\p{{Ll}}'))[1] AS t FROM chunks) WHERE t IS NOT NULL""",
    "token_counts": f"SELECT id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distintos FROM (SELECT id, {tokens_sql('texto')} AS t FROM chunks WHERE texto IS NOT NULL)",
    "term_frequencies": f"SELECT termo, count(*) AS tf, count(DISTINCT id) AS df FROM (SELECT id, unnest({tokens_sql('texto')}) AS termo FROM chunks WHERE texto IS NOT NULL) GROUP BY 1",
    "query_tokens": f"SELECT id, array_to_string(list_filter({tokens_sql('pergunta')}, lambda t: NOT list_contains({STOP_SQL}, t)), ' ') AS termos FROM {_Q}",
    "question_keys": f"""SELECT id, trim({_SQUEEZE.format(fold_sql('pergunta'))}) AS roteador, {_SCAN.format('pergunta')} AS digitalizado, regexp_replace(lower(pergunta), '[^a-z0-9]', '', 'g') AS duplicata,
 array_to_string(list_sort(list_distinct(regexp_extract_all(lower(pergunta), '[a-z0-9]{{3,}}'))), ' ') AS palavras,
 array_to_string(list_transform(regexp_extract_all({_SCAN.format('pergunta')}, '[a-z0-9]{{2,}}'), lambda t: regexp_replace(t, '^(.{{3,}})s$', '\\1')), ' ') AS lemas FROM {_Q}""",
    "slugify": f"""WITH s AS (SELECT arquivo, {_STEM} AS stem FROM manifesto_corpus), c AS (SELECT arquivo, stem, ltrim(regexp_replace(trim(regexp_replace(stem, '{X.VERSION}', '')), '{_COURSE}', '')) AS t FROM s)
SELECT arquivo, coalesce(nullif({_SLUG.format("ltrim(regexp_replace(t, '" + _COPY + "', ''))")}, ''), {_SLUG.format('stem')}) AS slug FROM c""",
    "typo_variants": f"""SELECT id, t AS sem_acento, replace(t, 'para que serve', 'pra que serve') AS coloquial, t[:h] || t[h + 2:] AS sem_meio, CASE WHEN h + 1 >= length(t) THEN t[:h] || t[h + 2:] ELSE t[:h] || t[h + 2:h + 2] || t[h + 1:h + 1] || t[h + 3:] END AS meio_trocado
FROM (SELECT id, strip_accents(pergunta) AS t, {_HALF} AS h FROM {_Q})""",
    "question_filter": f"SELECT id, length(pergunta) BETWEEN 12 AND 240 AND contains(pergunta, '?') AS valida, regexp_matches({_SCAN.format('pergunta')}, '\\bnao\\b') AS negativa FROM {_Q}",
    "options": r"""SELECT id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(trim(list_extract(string_split(pergunta, ':'), -1)), '\?+$', ''), '\s+ou\s+|\s*,\s*'), lambda p: trim(p)), lambda p: length(p) >= 3), '|') AS opcoes FROM dataset_sintetico_v05b WHERE contains(pergunta, ':')""",
    "fingerprints": f"SELECT id, sha256(pergunta)[:8] AS digital FROM {_Q}",
    "abstention_flags": f"""SELECT coalesce(abstencao, false) AS registrada, coalesce({_ABSTAIN}, false) AS qualquer, coalesce(regexp_matches({fold_sql('trim(resposta)')}, '^(nao_sei|nao sei)') OR contains(substring({fold_sql('trim(resposta)')}, 1, 60), 'nao ha informacoes'), false) AS inicio,
 coalesce(contains(upper(resposta), 'NAO_SEI'), false) AS marca, count(*) AS respostas FROM {_A} GROUP BY 1, 2, 3, 4""",
    "citation_extract": f"SELECT resposta_id, len(c) AS marcas, len(list_distinct(c)) AS distintas, list_max(c) AS maior FROM (SELECT resposta_id, list_transform(regexp_extract_all(resposta, '\\[(\\d{{1,9}})\\]', 1), lambda n: n::INT) AS c FROM {_A}) WHERE len(c) > 0",
    "tts_normalize": f"SELECT resposta_id, CASE WHEN " + _SQUEEZE.format("translate(" + fold_sql("trim(resposta)") + ", '_-', '  ')") + f" IN ('nao sei', 'nao sei.', 'nao sei!') THEN '{X.NO_ANSWER}' ELSE {_SPOKEN} END AS falada FROM {_A} WHERE resposta IS NOT NULL",
    "citation_renumber": rf"""
WITH a AS (SELECT resposta_id, {_BODY} AS corpo, coalesce(len(referencias), 0) AS n FROM {_A} WHERE resposta IS NOT NULL),
m AS (SELECT resposta_id, corpo, list_filter(list_transform(regexp_extract_all(corpo, '\[(\d{{1,9}})\]', 1), lambda x: x::INT), lambda x: x BETWEEN 1 AND n) AS marcas FROM a),
o AS (SELECT resposta_id, corpo, list_filter(marcas, lambda x, i: list_position(marcas, x) = i) AS marcas FROM m),
p AS (SELECT resposta_id, marcas, list_reduce(list_prepend(regexp_replace(corpo, '\[(\d{{1,9}})\]', chr(1) || '\1' || chr(2), 'g'), list_transform(marcas, lambda x: x::VARCHAR)), lambda t, x: replace(t, chr(1) || x || chr(2), '[' || list_position(marcas, x::INT)::VARCHAR || ']')) AS t FROM o)
SELECT resposta_id, trim(regexp_replace(regexp_replace(t, chr(1) || '\d+' || chr(2), '', 'g'), '[ \t]{{2,}}', ' ', 'g')) AS texto, array_to_string(marcas, ',') AS marcas FROM p""",
    "verdict_parse": """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN k % 5 + 1 END AS nota, CASE WHEN event_id % 7 <> 0 THEN k % 2 = 0 END AS correta, CASE WHEN event_id % 7 <> 0 THEN k % 10 = 0 END AS alucinou,
 CASE WHEN event_id % 7 <> 0 THEN '{' || event_type || '} diz' END AS justificativa FROM (SELECT event_id, event_type, (props::JSON->>'k')::INT AS k FROM events)""",
    "greedy_parse": "SELECT event_id % 7 = 1 AS lido, count(*) AS textos FROM events GROUP BY 1",
    "array_parse": "SELECT origem, count(*) AS pares, sum(length(pergunta))::BIGINT AS caracteres FROM dataset_sintetico_v05b WHERE pergunta IS NOT NULL GROUP BY 1",
}
