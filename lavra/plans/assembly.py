"""Figures, corpora and question sets put together from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions import text as X
from lavra.operators import chunking as C
from lavra.operators import metrics as M
from lavra.operators.curation import order_key
from lavra.plans.curation import _KEY, _SCAN, _SLUG_ANY, _STR, _questions, _stratum
from lavra.plans.metrics import _answers, _kinds
from lavra.plans.text import _BODY, fold_sql
from lavra.sources.tables import table

# Marks of a slide without content, folded, and its length; forms of a negative question.
BOILERPLATE, BOILERPLATE_LENGTH = "transformando dados em p", 260
NEGATIVE_FORMS = ("destes (itens|termos)", "nao esta relacionado", "nao e (um |uma )?conceito", "fora do dominio")


def numbered(rows: DataFrame, first: Column, id: str, bucket: int = 65_536) -> DataFrame:
    """``rows`` with a dense ``numero`` from 1 on, by ``first`` and then by the whole-number ``id``.

    Rows are ranked inside buckets of the id, and a bucket begins where those
    before it end, so that no task numbers all rows.
    """
    keyed = rows.withColumn("_parte", first).withColumn("_balde", F.floor(F.col(id) / bucket))
    sizes = keyed.groupBy("_parte", "_balde").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_parte", "_balde").rowsBetween(Window.unboundedPreceding, -1)
    # One row a bucket: this is what a single task sums up.
    starts = sizes.select("_parte", "_balde", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_antes"))
    inside = F.row_number().over(Window.partitionBy("_parte", "_balde").orderBy(id))
    return keyed.withColumn("_dentro", inside).join(starts, ["_parte", "_balde"]).withColumn("numero", F.col("_dentro") + F.col("_antes")).drop("_parte", "_balde", "_dentro", "_antes")


# Figures and chunks -----------------------------------------------------------------


def figure_lines(spark, d):
    """Lines kept of every figure: no control characters, a letter or figure, and each but once whatever its case."""
    lines = F.filter(F.transform(F.split("texto", "\n"), lambda x: F.trim(x)), lambda x: x.rlike("[a-zA-Z0-9áéíóúâêôãõçÁÉÍÓÚÂÊÔÃÕÇ]") & ~x.rlike("[\\x00-\\x08\\x0a-\\x1f]"))
    rows = _kinds(spark, d).where("tipo = 'imagem'").select("id", lines.alias("l")).withColumn("k", F.transform("l", lambda x: F.lower(x)))
    kept = F.filter("l", lambda x, i: F.array_position("k", F.lower(x)) == i + 1)
    return rows.select("id", F.size("l").alias("lidas"), F.size(kept).alias("mantidas"), F.md5(F.array_join(kept, "\n")).alias("texto"))


def figure_chunks(spark, d):
    """Figures as chunks: the leading lines of their page, and their own text."""
    rows = _kinds(spark, d)
    page = rows.where("tipo <> 'imagem'").groupBy("doc_id", "pagina").agg(F.min_by("texto", "id").alias("t"))
    both = rows.where("tipo = 'imagem'").select("id", "doc_id", "pagina", "texto").join(page, ["doc_id", "pagina"], "left")
    text = F.concat(F.coalesce(C.slide_prefix(F.col("t")), F.lit("")), F.lit(" | FIGURA: "), F.col("texto"))
    return both.select("id", F.length(text).alias("caracteres"), F.md5(text).alias("texto"))


def figure_order(spark, d):
    """Figures of every page in reading order: rows of eight points of height, then width, then number."""
    r = _kinds(spark, d).where("tipo = 'imagem' AND imagem IS NOT NULL").select("id", F.coalesce("doc_id", F.lit("")).alias("doc_id"), F.coalesce("pagina", F.lit(0)).alias("pagina"), F.coalesce("imagem.h", F.lit(0)).alias("h"), F.coalesce("imagem.w", F.lit(0)).alias("w"))
    order = Window.partitionBy("doc_id", "pagina").orderBy(F.floor(F.col("h") / 8), "w", "id")
    return r.select("id", "doc_id", "pagina", F.row_number().over(order).alias("ordem"))


def title_chunks(spark, d):
    """A chunk of its own for the title of every document: its first chunk's title and the name of the file."""
    t = table(spark, d, "chunks").where("doc_id IS NOT NULL AND titulo IS NOT NULL").groupBy("doc_id").agg(F.min_by("titulo", "id").alias("titulo"))
    return t.select("doc_id", F.lit(0).alias("pagina"), F.concat("titulo", F.lit(" "), F.regexp_replace("doc_id", r"\.[A-Za-z0-9]+$", "")).alias("texto"))


def boilerplate_chunks(spark, d):
    """Chunks by whether they are short and hold the mark of an empty slide; the titles of files stand for the marks that a corpus has of its own."""
    t = X.scan_key(F.col("texto"))
    rows = table(spark, d, "chunks").where("texto IS NOT NULL")
    marked = t.contains(BOILERPLATE) | t.contains(X.scan_key(F.coalesce("titulo", F.lit("\u0001"))))
    return rows.groupBy((marked & (F.length(t) < BOILERPLATE_LENGTH)).alias("mobilia")).agg(F.count("*").alias("chunks"))


def corpus_rows(spark, d):
    """The combined corpus: text chunks first, admitted figures after them, numbered anew."""
    r = _kinds(spark, d)
    ok = (F.col("tipo") != "imagem") | ((F.length("texto") >= 30) & (F.coalesce("novo_ratio", F.lit(0.0)) >= 0.45) & (F.coalesce("sinal_dominio", F.lit(0.0)) >= 0.40))
    return numbered(r.where(ok).select("id", "doc_id", "tipo"), F.col("tipo") == "imagem", "id").select("numero", "id", "doc_id", "tipo")


def sampled_windows(spark, d):
    """Three windows of a thousand characters of every document, in seeded order."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(C.fixed_windows(F.col("text"))).alias("n", "janela"))
    order = Window.partitionBy("doc_id").orderBy(F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("n").cast("string"))), "n")
    return rows.withColumn("posto", F.row_number().over(order)).where("posto <= 3").select("doc_id", "posto", "n", F.md5("janela").alias("resumo"))


# Files and answers --------------------------------------------------------------------


def manifest_copies(spark, d):
    """Files whose content another file has too, with the first of them."""
    m = table(spark, d, "manifesto_corpus").where("sha1 IS NOT NULL")
    first = m.groupBy("sha1").agg(F.min("arquivo").alias("principal"))
    return m.join(first, "sha1").where("arquivo <> principal").select("arquivo", "principal")


def destination_names(spark, d):
    """Name of every file in the corpus: course, lesson and file, no part said twice, and a number where names collide."""
    part = lambda c: F.coalesce(F.nullif(X.slug(F.coalesce(c, F.lit(""))), F.lit("")), F.lit("geral"))
    m = table(spark, d, "manifesto_corpus").select("arquivo", part(F.col("disciplina")).alias("c"), part(F.col("aula")).alias("l"), part(F.regexp_replace("arquivo", r"\.[A-Za-z0-9]+$", "")).alias("f"), F.lower("extensao").alias("e"))
    name = F.concat_ws("_", F.when(~F.col("f").startswith(F.col("c")), F.col("c")), F.when(~F.contains("f", "l"), F.col("l")), F.col("f"))
    named = m.withColumn("nome", name).withColumn("vez", F.row_number().over(Window.partitionBy("nome", "e").orderBy("arquivo")))
    return named.select("arquivo", F.concat("nome", F.when(F.col("vez") > 1, F.concat(F.lit("_"), F.col("vez").cast("string"))).otherwise(""), F.coalesce("e", F.lit(""))).alias("destino"))


def citation_footer(spark, d):
    """Answers with their marks numbered anew, and the reference list of those marks."""
    rows = _answers(spark, d).where("resposta IS NOT NULL").withColumn("r", X.renumbered(F.col("resposta"), F.coalesce(F.size("referencias"), F.lit(0)))).withColumn("docs", F.col("referencias.doc_id"))
    footer = F.array_join(F.transform("r.marcas", lambda n, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(F.get(F.col("docs"), n - 1), F.lit("?")))), "\n")
    return rows.select("resposta_id", F.size("r.marcas").alias("referencias"), footer.alias("rodape"))


def audio_encoded(spark, d):
    """Answers as base64, as an interface sends them: length and digest."""
    code = F.regexp_replace(F.base64(F.encode("resposta", "UTF-8")), "[\r\n]", "")
    return _answers(spark, d).where("resposta IS NOT NULL").select("resposta_id", F.length(code).alias("tamanho"), F.md5(code).alias("resumo"))


def audit_reasons(spark, d):
    """Reasons of the audit, cut to forty characters, by stratum."""
    why = F.left(F.coalesce("_auditoria.motivo", F.lit("sem motivo")), F.lit(40))
    return _questions(spark, d).groupBy(_stratum().alias("estrato"), why.alias("motivo")).agg(F.count("*").alias("perguntas"))


def wer_report(spark, d):
    """Mean word error rates of two readings of every question, and what the second gains."""
    q = table(spark, d, "perguntas_v05b").select("id", "pergunta").distinct().where("pergunta IS NOT NULL")
    rate = lambda other: M.wer(X.all_tokens(F.col("pergunta")), X.all_tokens(other(F.col("pergunta"))))
    return q.agg(F.count("*").alias("frases"), F.round(F.avg(rate(X.swap_middle)), 6).alias("base"), F.round(F.avg(rate(X.drop_middle)), 6).alias("com_prompt"), F.round(F.avg(rate(X.swap_middle)) - F.avg(rate(X.drop_middle)), 6).alias("ganho"))


# Question sets --------------------------------------------------------------------------


def question_templates(spark, d):
    """Questions by stratum and form: a negative form, any denial, none."""
    key = X.scan_key(F.col("pergunta"))
    form = F.when(key.contains("nao") & key.rlike("|".join(NEGATIVE_FORMS)), "negativa").when(key.rlike(r"\bnao\b"), "nega").otherwise("outra")
    return _questions(spark, d).where("pergunta IS NOT NULL").groupBy(_stratum().alias("estrato"), form.alias("forma")).agg(F.count("*").alias("perguntas"))


def frozen_pairs(spark, d):
    """Training pairs, and those left when every question that also stands in a held-out partition is taken out, by origin."""
    rows = table(spark, d, "dataset_sintetico_v05b").select("origem", "particao", X.duplicate_key(F.col("pergunta")).alias("k"))
    held = rows.where("particao <> 'treino' AND k <> ''").select("k").distinct().withColumn("fora", F.lit(True))
    return rows.where("particao = 'treino'").join(held, "k", "left").groupBy("origem").agg(F.count("*").alias("pares"), F.count_if(F.col("fora").isNull()).alias("mantidos"))


def replaced_stratum(spark, d):
    """The golden set with its adversarial questions replaced by the abstentions of the curated test partition, by stratum and side."""
    kept = _questions(spark, d).select(F.col("id").cast("bigint").alias("id"), _stratum().alias("estrato")).where("estrato <> 'adversarial'").withColumn("lado", F.lit("base"))
    new = table(spark, d, "dataset_sintetico_v05b").where("particao = 'teste' AND tipo = 'abstencao'").select("id", F.lit("adversarial").alias("estrato"), F.lit("novo").alias("lado"))
    return kept.unionByName(new).groupBy("estrato", "lado").agg(F.count("*").alias("perguntas"))


def router_dataset(spark, d):
    """Twenty questions of every stratum, and of the first fourteen a misspelling of a kind that the rank tells."""
    q = _questions(spark, d).where("pergunta IS NOT NULL").select("id", _stratum().alias("estrato"), F.col("pergunta").alias("p"))
    first = q.withColumn("posto", F.row_number().over(Window.partitionBy("estrato").orderBy(order_key(F.col("id")), "id"))).where("posto <= 20")
    p, kind = F.col("p"), F.col("posto") % 4
    typo = F.when(kind == 0, X.unaccent(p)).when(kind == 1, X.colloquial(p)).when(kind == 2, X.drop_middle(p)).otherwise(X.swap_middle(p))
    rows = first.select("id", "estrato", "posto", F.posexplode(F.when(F.col("posto") <= 14, F.array(p, typo)).otherwise(F.array(p))).alias("variante", "texto"))
    return rows.select("id", "estrato", "posto", "variante", F.md5("texto").alias("resumo"))


def consolidated_golden(spark, d):
    """New golden questions: valid ones of the validation partition that the golden set lacks, each key once, numbered after the set's last id."""
    golden = _questions(spark, d)
    q = F.col("pergunta")
    rows = table(spark, d, "dataset_sintetico_v05b").where((F.col("particao") == "validacao") & F.length(q).between(12, 240) & q.contains("?")).select("id", X.duplicate_key(q).alias("k")).where("k <> ''")
    fresh = rows.groupBy("k").agg(F.min("id").alias("origem_id")).join(golden.select(X.duplicate_key(q).alias("k")).where("k <> ''").distinct(), "k", "left_anti")
    last = golden.agg(F.max("id").alias("ultimo"))
    return numbered(fresh, F.lit(0), "origem_id").join(F.broadcast(last)).select((F.col("numero") + F.col("ultimo")).alias("id"), "origem_id")


def distillation_set(spark, d):
    """Training pairs with a target, and golden questions with an expected answer, by source and route label; abstentions have no target."""
    a = table(spark, d, "dataset_sintetico_v05b").where((F.col("particao") == "treino") & (F.coalesce(F.trim("resposta"), F.lit("")) != "") & ~X.abstains(F.col("resposta"))).select(F.lit("curado").alias("fonte"), F.when(F.col("tipo") == "composta", "COMPLEXA").otherwise("SIMPLES").alias("rotulo"), F.length("resposta").alias("n"))
    b = _questions(spark, d).where("_auditoria.resposta_esperada IS NOT NULL").select(F.lit("golden").alias("fonte"), F.when(_stratum() == "composta", "COMPLEXA").otherwise("SIMPLES").alias("rotulo"), F.length("_auditoria.resposta_esperada").alias("n"))
    return a.unionByName(b).groupBy("fonte", "rotulo").agg(F.count("*").alias("pares"), F.sum("n").alias("caracteres"))


QUERIES = {
    "figure_lines": figure_lines, "figure_chunks": figure_chunks, "figure_order": figure_order, "title_chunks": title_chunks, "boilerplate_chunks": boilerplate_chunks, "corpus_rows": corpus_rows, "sampled_windows": sampled_windows,
    "manifest_copies": manifest_copies, "destination_names": destination_names, "citation_footer": citation_footer, "audio_encoded": audio_encoded, "audit_reasons": audit_reasons, "wer_report": wer_report,
    "question_templates": question_templates, "frozen_pairs": frozen_pairs, "replaced_stratum": replaced_stratum, "router_dataset": router_dataset, "consolidated_golden": consolidated_golden, "distillation_set": distillation_set,
}

_K = "k AS (SELECT id, doc_id, pagina, coalesce(lower(trim(tipo)), 'texto') AS tipo, texto, imagem, novo_ratio, sinal_dominio FROM chunks WHERE texto IS NOT NULL)"
_A = "a AS (SELECT DISTINCT ON (resposta_id) * FROM chatresponse)"
_GOLD = f"q AS (SELECT DISTINCT ON (id) *, {_STR} AS e FROM perguntas_v05b)"
_PREFIX = "substring(coalesce(list_reduce(list_prepend('', list_filter(list_transform(string_split(t, chr(10)), lambda l: trim(l)), lambda l: l <> '')), lambda s, l: CASE WHEN length(s) >= 160 THEN s ELSE trim(s || ' ' || l) END), ''), 1, 160)"
_WORDS2 = "regexp_extract_all(strip_accents(lower({0})), '[a-z0-9]+')"
_DROP, _SWAP = "t[:h] || t[h + 2:]", "CASE WHEN h + 1 >= length(t) THEN t[:h] || t[h + 2:] ELSE t[:h] || t[h + 2:h + 2] || t[h + 1:h + 1] || t[h + 3:] END"
_WER = "levenshtein(array_to_string(list_transform(x, lambda ww: chr(33 + list_position(list_concat(x, {0}), ww)::INT)), ''), array_to_string(list_transform({0}, lambda ww: chr(33 + list_position(list_concat(x, {0}), ww)::INT)), '')) / greatest(len(x), 1)"

ORACLES = {
    "figure_lines": f"WITH {_K}, l AS (SELECT id, list_filter(list_transform(string_split(texto, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '[a-zA-Z0-9áéíóúâêôãõçÁÉÍÓÚÂÊÔÃÕÇ]') AND NOT regexp_matches(x, '[\\x01-\\x08\\x0a-\\x1f]')) AS l FROM k WHERE tipo = 'imagem'), m AS (SELECT id, l, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i) AS m FROM l) SELECT id, len(l) AS lidas, len(m) AS mantidas, md5(array_to_string(m, chr(10))) AS texto FROM m",
    "figure_chunks": f"WITH {_K}, p AS (SELECT doc_id, pagina, min_by(texto, id) AS t FROM k WHERE tipo <> 'imagem' GROUP BY 1, 2), x AS (SELECT k.id, coalesce({_PREFIX}, '') || ' | FIGURA: ' || texto AS x FROM k LEFT JOIN p ON p.doc_id = k.doc_id AND p.pagina = k.pagina WHERE tipo = 'imagem') SELECT id, length(x) AS caracteres, md5(x) AS texto FROM x",
    "figure_order": f"WITH {_K}, f AS (SELECT id, coalesce(doc_id, '') AS doc_id, coalesce(pagina, 0) AS pagina, coalesce(imagem.h, 0) AS h, coalesce(imagem.w, 0) AS w FROM k WHERE tipo = 'imagem' AND imagem IS NOT NULL) SELECT id, doc_id, pagina, row_number() OVER (PARTITION BY doc_id, pagina ORDER BY h // 8, w, id) AS ordem FROM f",
    "title_chunks": "SELECT doc_id, 0 AS pagina, min_by(titulo, id) || ' ' || regexp_replace(doc_id, '\\.[A-Za-z0-9]+$', '') AS texto FROM chunks WHERE doc_id IS NOT NULL AND titulo IS NOT NULL GROUP BY doc_id",
    "boilerplate_chunks": f"SELECT (contains({_SCAN.format('texto')}, '{BOILERPLATE}') OR coalesce(contains({_SCAN.format('texto')}, {_SCAN.format('titulo')}), false)) AND length({_SCAN.format('texto')}) < {BOILERPLATE_LENGTH} AS mobilia, count(*) AS chunks FROM chunks WHERE texto IS NOT NULL GROUP BY 1",
    "corpus_rows": f"WITH {_K} SELECT row_number() OVER (ORDER BY tipo = 'imagem', id) AS numero, id, doc_id, tipo FROM k WHERE tipo <> 'imagem' OR (length(texto) >= 30 AND coalesce(novo_ratio, 0) >= 0.45 AND coalesce(sinal_dominio, 0) >= 0.40)",
    "sampled_windows": "WITH w AS (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 1000)) AS n FROM documents WHERE length(text) > 0), r AS (SELECT doc_id, n, substring(text, n * 1000 + 1, 1000) AS j, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || '-' || n), n) AS posto FROM w) SELECT doc_id, posto, n, md5(j) AS resumo FROM r WHERE posto <= 3",
    "manifest_copies": "SELECT arquivo, principal FROM (SELECT arquivo, min(arquivo) OVER (PARTITION BY sha1) AS principal FROM manifesto_corpus WHERE sha1 IS NOT NULL) WHERE arquivo <> principal",
    "destination_names": f"""WITH m AS (SELECT arquivo, coalesce(nullif({_SLUG_ANY.format("coalesce(disciplina, '')")}, ''), 'geral') AS c, coalesce(nullif({_SLUG_ANY.format("coalesce(aula, '')")}, ''), 'geral') AS l, coalesce(nullif({_SLUG_ANY.format("regexp_replace(arquivo, '[.][A-Za-z0-9]+$', '')")}, ''), 'geral') AS f, lower(extensao) AS e FROM manifesto_corpus),
n AS (SELECT arquivo, e, concat_ws('_', CASE WHEN NOT starts_with(f, c) THEN c END, CASE WHEN NOT contains(f, l) THEN l END, f) AS nome FROM m), v AS (SELECT *, row_number() OVER (PARTITION BY nome, e ORDER BY arquivo) AS vez FROM n)
SELECT arquivo, nome || CASE WHEN vez > 1 THEN '_' || vez ELSE '' END || coalesce(e, '') AS destino FROM v""",
    "citation_footer": f"""WITH {_A}, b AS (SELECT resposta_id, {_BODY} AS corpo, coalesce(len(referencias), 0) AS n, list_transform(referencias, lambda x: x.doc_id) AS docs FROM a WHERE resposta IS NOT NULL),
m AS (SELECT resposta_id, docs, list_filter(list_transform(regexp_extract_all(corpo, '\\[(\\d{{1,9}})\\]', 1), lambda x: x::INT), lambda x: x BETWEEN 1 AND n) AS m FROM b), o AS (SELECT resposta_id, docs, list_filter(m, lambda x, i: list_position(m, x) = i) AS m FROM m)
SELECT resposta_id, len(m) AS referencias, array_to_string(list_transform(m, lambda x, i: '[' || i || '] ' || coalesce(docs[x], '?')), chr(10)) AS rodape FROM o""",
    "audio_encoded": f"WITH {_A}, c AS (SELECT resposta_id, to_base64(encode(resposta)) AS c FROM a WHERE resposta IS NOT NULL) SELECT resposta_id, length(c) AS tamanho, md5(c) AS resumo FROM c",
    "audit_reasons": f"WITH {_GOLD} SELECT e AS estrato, left(coalesce(_auditoria.motivo, 'sem motivo'), 40) AS motivo, count(*) AS perguntas FROM q GROUP BY 1, 2",
    "wer_report": f"""WITH q AS (SELECT DISTINCT id, pergunta, strip_accents(pergunta) AS t, length(strip_accents(pergunta)) // 2 AS h FROM perguntas_v05b WHERE pergunta IS NOT NULL), v AS (SELECT {_WORDS2.format('pergunta')} AS x, {_WORDS2.format(_SWAP)} AS y, {_WORDS2.format(_DROP)} AS z FROM q), w AS (SELECT {_WER.format('y')} AS a, {_WER.format('z')} AS b FROM v)
SELECT count(*) AS frases, round(avg(a), 6) AS base, round(avg(b), 6) AS com_prompt, round(avg(a) - avg(b), 6) AS ganho FROM w""",
    "question_templates": f"WITH {_GOLD}, k AS (SELECT e, {_SCAN.format('pergunta')} AS k FROM q WHERE pergunta IS NOT NULL) SELECT e AS estrato, CASE WHEN contains(k, 'nao') AND regexp_matches(k, '{'|'.join(NEGATIVE_FORMS)}') THEN 'negativa' WHEN regexp_matches(k, '\\bnao\\b') THEN 'nega' ELSE 'outra' END AS forma, count(*) AS perguntas FROM k GROUP BY 1, 2",
    "frozen_pairs": f"WITH r AS (SELECT origem, particao, {_KEY.format('pergunta')} AS k FROM dataset_sintetico_v05b), h AS (SELECT DISTINCT k FROM r WHERE particao <> 'treino' AND k <> '') SELECT origem, count(*) AS pares, count(*) FILTER (WHERE h.k IS NULL) AS mantidos FROM r LEFT JOIN h ON h.k = r.k WHERE particao = 'treino' GROUP BY 1",
    "replaced_stratum": f"WITH {_GOLD} SELECT estrato, lado, count(*) AS perguntas FROM (SELECT e AS estrato, 'base' AS lado FROM q WHERE e <> 'adversarial' UNION ALL SELECT 'adversarial', 'novo' FROM dataset_sintetico_v05b WHERE particao = 'teste' AND tipo = 'abstencao') GROUP BY 1, 2",
    "router_dataset": f"""WITH {_GOLD}, r AS (SELECT id, e, pergunta, row_number() OVER (PARTITION BY e ORDER BY md5(id::VARCHAR || '-42'), id) AS posto FROM q WHERE pergunta IS NOT NULL), f AS (SELECT *, strip_accents(pergunta) AS t, length(strip_accents(pergunta)) // 2 AS h FROM r WHERE posto <= 20)
SELECT id, e AS estrato, posto, 0 AS variante, md5(pergunta) AS resumo FROM f UNION ALL SELECT id, e, posto, 1, md5(CASE posto % 4 WHEN 0 THEN t WHEN 1 THEN replace(t, 'para que serve', 'pra que serve') WHEN 2 THEN {_DROP} ELSE {_SWAP} END) FROM f WHERE posto <= 14""",
    "consolidated_golden": f"WITH {_GOLD}, c AS (SELECT {_KEY.format('pergunta')} AS k, min(id) AS o FROM dataset_sintetico_v05b WHERE particao = 'validacao' AND length(pergunta) BETWEEN 12 AND 240 AND contains(pergunta, '?') GROUP BY 1) SELECT (SELECT max(id) FROM q) + row_number() OVER (ORDER BY o) AS id, o AS origem_id FROM c WHERE k <> '' AND k NOT IN (SELECT {_KEY.format('pergunta')} FROM q WHERE pergunta IS NOT NULL)",
    "distillation_set": f"""WITH {_GOLD}, d AS (SELECT *, regexp_replace(translate({fold_sql('resposta')}, '_-', '  '), '[\\s\\x0b]+', ' ', 'g') AS t FROM dataset_sintetico_v05b)
SELECT fonte, rotulo, count(*) AS pares, sum(n)::BIGINT AS caracteres FROM (SELECT 'curado' AS fonte, CASE WHEN tipo = 'composta' THEN 'COMPLEXA' ELSE 'SIMPLES' END AS rotulo, length(resposta) AS n FROM d WHERE particao = 'treino' AND coalesce(trim(resposta), '') <> '' AND NOT (t LIKE '%nao sei%' OR regexp_matches(t, '\\bnao (ha|tenho|existem?) informa'))
UNION ALL SELECT 'golden', CASE WHEN e = 'composta' THEN 'COMPLEXA' ELSE 'SIMPLES' END, length(_auditoria.resposta_esperada) FROM q WHERE _auditoria.resposta_esperada IS NOT NULL) GROUP BY 1, 2""",
}
