"""Question sets, corpus manifest, rules for negative questions and the request limiter."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lavra.functions import text as X
from lavra.operators import curation as C
from lavra.operators import retrieval as R
from lavra.plans.retrieval import _LEX
from lavra.plans.text import fold_sql
from lavra.sources.tables import table
from lavra.streaming.limiter import limit


def _questions(spark, d):
    return table(spark, d, "perguntas_v05b").dropDuplicates(["id"])


def _stratum():
    return F.regexp_replace(F.lower(F.coalesce("estrato", F.lit(""))), r"[\s_]+", "")


# Corpus ------------------------------------------------------------------------


def manifest_dedup(spark, d):
    """Files of equal content: the first name, the size and the others."""
    m = table(spark, d, "manifesto_corpus").where("sha1 IS NOT NULL")
    return m.groupBy("sha1").agg(F.min("arquivo").alias("arquivo"), F.count("*").alias("copias"), F.max("tamanho").alias("tamanho"))


def manifest_by_course(spark, d):
    """Files and bytes by course and extension, spellings of a course as one."""
    course = F.coalesce(F.nullif(X.slug(F.col("disciplina")), F.lit("")), F.lit("sem disciplina"))
    return table(spark, d, "manifesto_corpus").groupBy(course.alias("disciplina"), F.lower("extensao").alias("extensao")).agg(F.count("*").alias("arquivos"), F.sum("tamanho").alias("bytes"))


def exact_dup_classes(spark, d):
    """Class of equal texts of every document, whatever the case, accents and spacing, and its size."""
    return C.exact_classes(table(spark, d, "documents"), "doc_id", X.router_key(F.col("text"))).withColumnsRenamed({"id": "doc_id"})


def fuzzy_vs_golden(spark, d):
    """Pairs of the curated set whose question is more than 0.8 alike to golden questions, by word sets."""
    pairs = table(spark, d, "dataset_sintetico_v05b").where("pergunta IS NOT NULL").select("id", X.word_set(F.col("pergunta")).alias("palavras"))
    golden = _questions(spark, d).where("pergunta IS NOT NULL").select("id", X.word_set(F.col("pergunta")).alias("palavras"))
    return C.set_links(pairs, golden).select("id", "ligacoes", F.round("maior", 6).alias("maior"))


def exact_vs_golden(spark, d):
    """Curated pairs whose question's key stands in the golden set, by origin."""
    golden = _questions(spark, d).select(X.duplicate_key(F.col("pergunta")).alias("chave")).where("chave <> ''").distinct()
    pairs = table(spark, d, "dataset_sintetico_v05b").select("origem", X.duplicate_key(F.col("pergunta")).alias("chave"))
    return pairs.join(golden, "chave", "left_semi").groupBy("origem").agg(F.count("*").alias("pares"))


def pending_questions(spark, d):
    """Golden questions that no chat has asked yet, by stratum."""
    asked = table(spark, d, "chatresponse").select(X.duplicate_key(F.col("texto")).alias("chave")).where("chave IS NOT NULL").distinct()
    rows = _questions(spark, d).select(_stratum().alias("estrato"), X.duplicate_key(F.col("pergunta")).alias("chave"))
    return rows.join(asked, "chave", "left_anti").groupBy("estrato").agg(F.count("*").alias("perguntas"))


# Question sets -------------------------------------------------------------------


def integrity_checks(spark, d):
    """Violations of the golden set's rules."""
    q = _questions(spark, d)
    files = table(spark, d, "manifesto_corpus").select(F.col("arquivo").alias("doc")).distinct()
    unknown = q.select("id", F.explode("docs_esperados").alias("doc")).join(files, "doc", "left_anti").select(F.countDistinct("id").alias("n")).select(F.lit("documento desconhecido").alias("regra"), "n")
    adversarial = _stratum() == "adversarial"
    rules = q.agg(
        F.count_if(adversarial & ~F.coalesce("deve_abster", F.lit(False))).alias("adversarial sem abster"), F.count_if(adversarial & (F.coalesce(F.size("docs_esperados"), F.lit(0)) > 0)).alias("adversarial com documento"),
        F.count_if(F.col("deve_abster").isNull()).alias("abster nulo"), F.count_if(F.coalesce(F.trim("pergunta"), F.lit("")) == "").alias("pergunta vazia"))
    names = ["adversarial sem abster", "adversarial com documento", "abster nulo", "pergunta vazia"]
    listed = rules.select(F.explode(F.array(*[F.struct(F.lit(n).alias("regra"), F.col(f"`{n}`").alias("n")) for n in names])).alias("r")).select("r.*")
    repeated = q.groupBy(X.duplicate_key(F.col("pergunta")).alias("k")).agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n")).select(F.lit("pergunta repetida").alias("regra"), "n")
    return unknown.unionByName(listed).unionByName(repeated)


def reachable_questions(spark, d):
    """Questions by stratum and whether an expected document is among the 60 best chunks; without expected ones they are."""
    q = _questions(spark, d).select("id", "pergunta", _stratum().alias("estrato"), "docs_esperados")
    best = R.bm25_best(q, table(spark, d, "chunks"), 60).select(F.col("q"), "id").join(table(spark, d, "chunks").select("id", F.col("doc_id").alias("doc")), "id").select("q", "doc")
    wanted = q.select(F.col("id").alias("q"), F.explode("docs_esperados").alias("doc"))
    hit = wanted.join(best, ["q", "doc"], "left_semi").select("q").distinct().withColumn("ha", F.lit(True))
    rows = q.join(hit, q.id == hit.q, "left")
    ok = (F.coalesce(F.size("docs_esperados"), F.lit(0)) == 0) | F.coalesce("ha", F.lit(False))
    return rows.groupBy("estrato", ok.alias("alcancavel")).agg(F.count("*").alias("perguntas"))


def qa_curate(spark, d):
    """Curated pairs by the first length rule they break, and by kind of question."""
    q, a = F.col("pergunta"), F.col("resposta")
    why = F.when(q.isNull() | ~F.length(q).between(5, 220), "pergunta").when(a.isNull() | ~F.length(a).between(10, 600), "resposta").when(~q.contains("?"), "sem interrogacao").when(~q.rlike(r"\p{L}"), "sem letra").otherwise("aceita")
    kind = F.when(F.coalesce(F.lower(q).rlike(" e | ou |diferença"), F.lit(False)), "composta").otherwise("simples")
    return table(spark, d, "dataset_sintetico_v05b").groupBy(why.alias("regra"), kind.alias("forma")).agg(F.count("*").alias("pares"))


def stratified_sample(spark, d):
    """Eight questions of every stratum in seeded order."""
    return C.stratified(_questions(spark, d), "id", _stratum(), 8).select(F.col("estrato_").alias("estrato"), F.col("posto_").alias("posto"), "id")


def train_test_split(spark, d):
    """Pairs by side of a seeded split with a tenth held out, and kind."""
    return table(spark, d, "dataset_sintetico_v05b").groupBy(C.split(F.col("id"), 0.1).alias("lado"), "tipo").agg(F.count("*").alias("pares"))


def typo_augment(spark, d):
    """Pairs of the training side with a misspelt copy of a fifth of them."""
    rows = table(spark, d, "dataset_sintetico_v05b").where((C.split(F.col("id"), 0.1) == "treino") & F.col("pergunta").isNotNull()).select("id", "pergunta")
    chosen = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit("-typo"))), 1, 4), 16, 10).cast("int") < 13107
    both = F.when(chosen, F.array(F.col("pergunta"), X.drop_middle(F.col("pergunta")))).otherwise(F.array("pergunta"))
    return rows.select("id", F.posexplode(both).alias("variante", "texto")).select("id", "variante", F.md5("texto").alias("resumo"))


# Negative questions -----------------------------------------------------------------


# What an option of a negative question may be called in the texts.
SYNONYMS = {"criar tabela": ("create table", "criar tabela", "crie a tabela"), "alterar tipo de coluna": ("alter column", "alterar tipo", "altere o tipo", "alter type"), "apagar coluna": ("drop column", "apagar coluna", "apague a coluna")}
_PLAIN = "[^a-z0-9]+"


def _negative(spark, d):
    """(q, doc) of the negative questions."""
    return _questions(spark, d).where(_stratum() == "negativa").select(F.col("id").alias("q"), F.explode(F.array_distinct("docs_esperados")).alias("doc"))


def _title_options(spark, d, q):
    """(q, opcao, alvo): every title of a question's documents, and its words with two spaces between them."""
    plain = F.trim(F.regexp_replace(X.scan_key(F.col("titulo")), _PLAIN, "  "))
    titles = table(spark, d, "chunks").where("titulo IS NOT NULL").select(F.col("doc_id").alias("doc"), X.scan_key(F.col("titulo")).alias("opcao"), plain.alias("alvo")).where("alvo <> ''").distinct()
    return q.join(titles, "doc").select("q", "opcao", "alvo").distinct()


def _counted(spark, d, wanted):
    """(doc, alvo, n): how often the words of ``wanted`` (doc, alvo) stand in a row in the chunks of the document."""
    plain = F.trim(F.regexp_replace(X.scan_key(F.col("texto")), _PLAIN, "  "))
    chunks = table(spark, d, "chunks").where("texto IS NOT NULL").select(F.col("doc_id").alias("doc"), plain.alias("t")).join(wanted.select("doc").distinct(), "doc", "left_semi")
    return C.by_document(chunks, wanted.select("doc", "alvo"), C.count_runs, "doc string, alvo string, n bigint").groupBy("doc", "alvo").agg(F.sum("n").alias("n")).where("n > 0")


def _rules(by_question):
    """Answers of the absence rule and of its fallback to the rarest option, from (q, opcao, n). Aggregates, not lists: a question may have any number of options."""
    least = by_question.groupBy("q").agg(F.min(F.struct("n", "opcao")).alias("menor"), F.count("*").alias("opcoes"), F.count_if(F.col("n") == 0).alias("ausentes"))
    ties = by_question.join(least, "q").where(F.col("n") == F.col("menor.n")).groupBy("q").agg(F.count("*").alias("iguais"))
    first = F.when(F.col("ausentes") == 1, F.col("menor.opcao"))
    third = F.when(F.col("ausentes") > 0, first).when(F.col("iguais") < F.col("opcoes"), F.col("menor.opcao"))
    why = F.when(F.col("ausentes") == 1, "ausente unica").when(F.col("ausentes") > 1, "ambigua").otherwise("todas presentes")
    return least.join(ties, "q").select(F.col("q").alias("pergunta_id"), first.alias("regra_1"), third.alias("regra_3"), why.alias("motivo"), "opcoes", "ausentes")


def negative_rule_all(spark, d):
    """Answer of the absence rule and of its fallback to the rarest option, for every negative question; its options are all titles of its documents.

    A title counts where its words stand in a row; one without a letter or digit is no option.
    """
    q = _negative(spark, d)
    options = _title_options(spark, d, q)
    counted = _counted(spark, d, options.join(q, "q").select("doc", "alvo").distinct())
    return _rules(options.join(q, "q").join(counted, ["doc", "alvo"], "left").groupBy("q", "opcao").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def negative_v5(spark, d):
    """The absence rule with three ways of being present: in these words, in a synonym's, or all lemmas within 14 words in a document; options by way and answer for every question."""
    q = _negative(spark, d)
    options = _title_options(spark, d, q)
    names = F.create_map(*[F.lit(x) for k, v in SYNONYMS.items() for x in (k, "|".join(v))])
    synonyms = options.select("opcao", F.explode(F.split(names[F.col("opcao")], r"\|")).alias("nome")).distinct().withColumn("sinonimo", F.regexp_replace("nome", " ", "  "))
    both = options.select("q", "opcao", "alvo").unionByName(options.select("q", "opcao").join(synonyms, "opcao").select("q", "opcao", F.col("sinonimo").alias("alvo")))
    counted = _counted(spark, d, both.join(q, "q").select("doc", "alvo").distinct())
    held = lambda rows, name: rows.join(q, "q").join(counted, ["doc", "alvo"]).where("n > 0").select("q", "opcao").distinct().withColumn(name, F.lit(True))
    windows = window_cooccurrence_all(spark, d).where("presentes > 0").select(F.col("doc_id").alias("doc"), "lemas")
    near = options.withColumn("lemas", F.array_join(_content(F.col("opcao")), " ")).join(q, "q").join(windows, ["doc", "lemas"]).select("q", "opcao").distinct().withColumn("janela", F.lit(True))
    rows = options.select("q", "opcao").distinct().join(held(options, "literal"), ["q", "opcao"], "left").join(held(options.select("q", "opcao").join(synonyms, "opcao").select("q", "opcao", F.col("sinonimo").alias("alvo")), "outro"), ["q", "opcao"], "left").join(near, ["q", "opcao"], "left")
    way = F.when(F.col("literal"), "literal").when(F.col("outro"), "sinonimo").when(F.col("janela"), "janela").otherwise("ausente")
    out = rows.withColumn("via", way).groupBy("q").agg(*[F.count_if(F.col("via") == v).alias(v) for v in ("literal", "sinonimo", "janela", "ausente")], F.min(F.when(F.col("via") == "ausente", F.col("opcao"))).alias("menor"))
    return out.select(F.col("q").alias("pergunta_id"), F.when(F.col("ausente") == 1, F.col("menor")).alias("regra_5"), "literal", "sinonimo", "janela", "ausente")


def _content(text):
    """Sorted distinct lemmas of a title without the words that join them."""
    return F.array_sort(F.array_distinct(F.filter(X.lemmas(text), lambda w: ~w.isin("de", "do", "da", "com"))))


def window_cooccurrence_all(spark, d):
    """For every title of two lemmas or more of every document: its chunks with any of the lemmas, and with all within 14 words, in any order."""
    t = table(spark, d, "chunks")
    titles = t.where("titulo IS NOT NULL").select(F.col("doc_id").alias("doc"), _content(F.col("titulo")).alias("l")).where(F.size("l") >= 2).distinct()
    texts = t.where("texto IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), F.array_join(X.lemmas(F.col("texto")), " ").alias("t"))
    counted = C.by_document(texts, titles.select("doc", F.array_join("l", " ").alias("lemas")), C.count_windows, "doc string, lemas string, chunks bigint, presentes bigint")
    return counted.groupBy(F.col("doc").alias("doc_id"), "lemas").agg(F.sum("chunks").alias("chunks"), F.sum("presentes").alias("presentes"))


# Requests ---------------------------------------------------------------------------


def rate_limit(spark, d):
    """Requests admitted and denied by user at two in six hours."""
    events = table(spark, d, "events")
    verdicts = limit(events, id="event_id", key="user_id", time="ts", quantity=2, period=6 * 3600.0)
    return verdicts.join(events.select(F.col("event_id").alias("id"), "user_id"), "id").groupBy("user_id").agg(F.count_if("admitida").alias("admitidas"), F.count_if(~F.col("admitida")).alias("negadas"), F.round(F.max("espera"), 3).alias("maior_espera"))


def router_train_predict(spark, d):
    """A router trained on the curated set's training side (simple against composite questions), scored on every golden question: labels with a reject zone, by stratum."""
    from lavra.operators import router
    from lavra.operators.routing import decided

    pairs = table(spark, d, "dataset_sintetico_v05b").where("particao = 'treino' AND tipo IN ('ancorado', 'composta')")
    model = router.train(pairs, "pergunta", F.when(F.col("tipo") == "ancorado", 1.0).otherwise(0.0))
    scored = router.predict(model, _questions(spark, d).select("pergunta", _stratum().alias("estrato")), "pergunta")
    return scored.groupBy("estrato", decided(F.col("probabilidade"), 0.6).alias("rotulo")).agg(F.count("*").alias("perguntas"), F.round(F.avg("probabilidade"), 4).alias("media"))


QUERIES = {
    "router_train_predict": router_train_predict,
    "manifest_dedup": manifest_dedup, "manifest_by_course": manifest_by_course, "exact_dup_classes": exact_dup_classes, "fuzzy_vs_golden": fuzzy_vs_golden, "exact_vs_golden": exact_vs_golden, "pending_questions": pending_questions,
    "integrity_checks": integrity_checks, "reachable_questions": reachable_questions, "qa_curate": qa_curate, "stratified_sample": stratified_sample, "train_test_split": train_test_split, "typo_augment": typo_augment,
    "negative_rule": negative_rule_all, "window_cooccurrence": window_cooccurrence_all, "negative_v5": negative_v5, "rate_limit": rate_limit,
}

_SLUG_ANY = "regexp_replace(substring(regexp_replace(regexp_replace(" + fold_sql("{0}") + ", '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60), '_+$', '')"
_KEY = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_STR = r"regexp_replace(lower(coalesce(estrato, '')), '[\s_]+', '', 'g')"
_G = "g AS (SELECT DISTINCT ON (id) * FROM perguntas_v05b)"
_SQ = r"regexp_replace({0}, '[\s\x0b]+', ' ', 'g')"
_SCAN = _SQ.format("regexp_replace(" + fold_sql("{0}") + ", '[-­][\\s\\x0b]*', '', 'g')")
_SET = "list_distinct(regexp_extract_all(lower(pergunta), '[a-z0-9]{3,}'))"
_SIDE = "CASE WHEN ('0x' || substring(md5(id::VARCHAR || '-42'), 1, 6))::BIGINT < floor(0.1 * 16777216) THEN 'teste' ELSE 'treino' END"
_LEM = "list_transform(regexp_extract_all({0}, '[a-z0-9]{{2,}}'), lambda t: regexp_replace(t, '^(.{{3,}})s$', '\\1'))"
_NEG = f"""WITH {_G}, n AS (SELECT DISTINCT id AS q, unnest(docs_esperados) AS doc FROM g WHERE {_STR} = 'negativa'),
ti AS (SELECT DISTINCT doc_id AS doc, {_SCAN.format('titulo')} AS opcao, trim(regexp_replace({_SCAN.format('titulo')}, '[^a-z0-9]+', '  ', 'g')) AS alvo FROM chunks WHERE titulo IS NOT NULL),
op AS (SELECT DISTINCT q, opcao, alvo FROM n JOIN ti USING (doc) WHERE alvo <> ''),
tx AS (SELECT doc_id AS doc, ' ' || trim(regexp_replace({_SCAN.format('texto')}, '[^a-z0-9]+', '  ', 'g')) || ' ' AS t FROM chunks WHERE texto IS NOT NULL),
da AS (SELECT DISTINCT doc, alvo FROM op JOIN n USING (q)),
ca AS (SELECT doc, alvo, sum((length(t) - length(replace(t, ' ' || alvo || ' ', ''))) // (length(alvo) + 2)) AS k FROM da JOIN tx USING (doc) GROUP BY 1, 2),
oc AS (SELECT op.q, op.opcao, coalesce(sum(k), 0)::BIGINT AS n FROM op JOIN n USING (q) LEFT JOIN ca ON ca.doc = n.doc AND ca.alvo = op.alvo GROUP BY 1, 2)"""
_CONTENT = "list_sort(list_distinct(list_filter(" + _LEM + ", lambda w: w NOT IN ('de', 'do', 'da', 'com'))))"
_WIN = f"""tl AS (SELECT DISTINCT doc_id AS doc, {_CONTENT.format(_SCAN.format('titulo'))} AS l FROM chunks WHERE titulo IS NOT NULL),
es AS (SELECT doc, array_to_string(l, ' ') AS lemas, l FROM tl WHERE len(l) >= 2),
wo AS (SELECT id, doc, unnest(w) AS w, unnest(generate_series(1, len(w))) AS pos FROM (SELECT id, doc_id AS doc, {_LEM.format(_SCAN.format('texto'))} AS w FROM chunks WHERE texto IS NOT NULL)),
hi AS (SELECT wo.id, wo.doc, es.lemas, wo.pos, wo.w, len(es.l) AS n FROM wo JOIN (SELECT doc, lemas, l, unnest(l) AS w FROM es) es ON es.doc = wo.doc AND es.w = wo.w),
ju AS (SELECT doc, lemas, id, len(list_distinct(list(w) OVER (PARTITION BY doc, id, lemas ORDER BY pos RANGE BETWEEN CURRENT ROW AND 14 FOLLOWING))) = n AS junto FROM hi),
fu AS (SELECT doc, lemas, id, bool_or(junto) AS presente FROM ju GROUP BY 1, 2, 3)"""

ORACLES = {
    "manifest_dedup": "SELECT sha1, min(arquivo) AS arquivo, count(*) AS copias, max(tamanho) AS tamanho FROM manifesto_corpus WHERE sha1 IS NOT NULL GROUP BY 1",
    "manifest_by_course": f"SELECT coalesce(nullif(regexp_replace(substring(regexp_replace(regexp_replace({fold_sql('disciplina')}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60), '_+$', ''), ''), 'sem disciplina') AS disciplina, lower(extensao) AS extensao, count(*) AS arquivos, sum(tamanho)::BIGINT AS bytes FROM manifesto_corpus GROUP BY 1, 2",
    "exact_dup_classes": f"WITH k AS (SELECT doc_id, coalesce(md5(trim({_SQ.format(fold_sql('text'))})), 'null-' || doc_id) AS chave FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY chave) AS classe, count(*) OVER (PARTITION BY chave) AS copias FROM k",
    "fuzzy_vs_golden": f"WITH {_G}, a AS (SELECT id, {_SET} AS s FROM dataset_sintetico_v05b WHERE pergunta IS NOT NULL), b AS (SELECT id, {_SET} AS s FROM g WHERE pergunta IS NOT NULL), p AS (SELECT a.id, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS j FROM a, b WHERE len(a.s) > 0 AND len(b.s) > 0) SELECT id, count(*) AS ligacoes, round(max(j), 6) AS maior FROM p WHERE j > 0.8 GROUP BY 1",
    "exact_vs_golden": f"WITH {_G} SELECT origem, count(*) AS pares FROM dataset_sintetico_v05b WHERE {_KEY.format('pergunta')} IN (SELECT {_KEY.format('pergunta')} FROM g WHERE {_KEY.format('pergunta')} <> '') GROUP BY 1",
    "pending_questions": f"WITH {_G} SELECT {_STR} AS estrato, count(*) AS perguntas FROM g WHERE NOT EXISTS (SELECT 1 FROM chatresponse c WHERE {_KEY.format('c.texto')} = {_KEY.format('g.pergunta')}) GROUP BY 1",
    "integrity_checks": f"""WITH {_G} SELECT 'documento desconhecido' AS regra, count(DISTINCT id) AS n FROM (SELECT id, unnest(docs_esperados) AS doc FROM g) WHERE doc NOT IN (SELECT arquivo FROM manifesto_corpus)
UNION ALL SELECT 'adversarial sem abster', count(*) FILTER (WHERE {_STR} = 'adversarial' AND NOT coalesce(deve_abster, false)) FROM g
UNION ALL SELECT 'adversarial com documento', count(*) FILTER (WHERE {_STR} = 'adversarial' AND coalesce(len(docs_esperados), 0) > 0) FROM g
UNION ALL SELECT 'abster nulo', count(*) FILTER (WHERE deve_abster IS NULL) FROM g
UNION ALL SELECT 'pergunta vazia', count(*) FILTER (WHERE coalesce(trim(pergunta), '') = '') FROM g
UNION ALL SELECT 'pergunta repetida', count(*) FROM (SELECT 1 FROM g GROUP BY {_KEY.format('pergunta')} HAVING count(*) > 1)""",
    "reachable_questions": _LEX + r""", h AS (SELECT DISTINCT rk.q FROM rk JOIN chunks c ON c.id = rk.id JOIN (SELECT q, unnest(docs) AS doc FROM qs) w ON w.q = rk.q AND w.doc = c.doc_id WHERE posto <= 60)
SELECT regexp_replace(lower(coalesce(estrato, '')), '[\s_]+', '', 'g') AS estrato, coalesce(len(docs), 0) = 0 OR q IN (SELECT q FROM h) AS alcancavel, count(*) AS perguntas FROM qs GROUP BY 1, 2""",
    "qa_curate": r"SELECT CASE WHEN pergunta IS NULL OR length(pergunta) NOT BETWEEN 5 AND 220 THEN 'pergunta' WHEN resposta IS NULL OR length(resposta) NOT BETWEEN 10 AND 600 THEN 'resposta' WHEN NOT contains(pergunta, '?') THEN 'sem interrogacao' WHEN NOT regexp_matches(pergunta, '\p{L}') THEN 'sem letra' ELSE 'aceita' END AS regra, CASE WHEN coalesce(regexp_matches(lower(pergunta), ' e | ou |diferença'), false) THEN 'composta' ELSE 'simples' END AS forma, count(*) AS pares FROM dataset_sintetico_v05b GROUP BY 1, 2",
    "stratified_sample": f"WITH {_G} SELECT estrato, posto, id FROM (SELECT {_STR} AS estrato, id, row_number() OVER (PARTITION BY {_STR} ORDER BY md5(id::VARCHAR || '-42'), id) AS posto FROM g) WHERE posto <= 8",
    "train_test_split": f"SELECT {_SIDE} AS lado, tipo, count(*) AS pares FROM dataset_sintetico_v05b GROUP BY 1, 2",
    "typo_augment": f"""WITH r AS (SELECT id, pergunta, strip_accents(pergunta) AS t, length(strip_accents(pergunta)) // 2 AS h, ('0x' || substring(md5(id::VARCHAR || '-typo'), 1, 4))::INT < 13107 AS c FROM dataset_sintetico_v05b WHERE {_SIDE} = 'treino' AND pergunta IS NOT NULL)
SELECT id, 0 AS variante, md5(pergunta) AS resumo FROM r UNION ALL SELECT id, 1, md5(t[:h] || t[h + 2:]) FROM r WHERE c""",
    "negative_rule": _NEG + """, l AS (SELECT q, list({'n': n, 'opcao': opcao} ORDER BY n, opcao) AS o FROM oc GROUP BY q), m AS (SELECT q, o, list_filter(o, lambda x: x.n = 0) AS z, list_filter(o, lambda x: x.n = o[1].n) AS r FROM l)
SELECT q AS pergunta_id, CASE WHEN len(z) = 1 THEN z[1].opcao END AS regra_1, CASE WHEN len(z) > 0 THEN CASE WHEN len(z) = 1 THEN z[1].opcao END WHEN len(r) < len(o) THEN o[1].opcao END AS regra_3, CASE WHEN len(z) = 1 THEN 'ausente unica' WHEN len(z) > 1 THEN 'ambigua' ELSE 'todas presentes' END AS motivo, len(o) AS opcoes, len(z) AS ausentes FROM m""",
    "window_cooccurrence": "WITH " + _WIN + " SELECT es.doc AS doc_id, es.lemas, count(fu.id) AS chunks, count(*) FILTER (WHERE presente) AS presentes FROM es LEFT JOIN fu ON fu.doc = es.doc AND fu.lemas = es.lemas GROUP BY 1, 2",
    "negative_v5": _NEG + ", " + _WIN + f""", va AS (SELECT op.q, op.opcao, CASE WHEN any_value(oc.n) > 0 THEN 'literal' WHEN bool_or(fu.presente) THEN 'janela' ELSE 'ausente' END AS via
 FROM op JOIN oc ON oc.q = op.q AND oc.opcao = op.opcao JOIN n ON n.q = op.q LEFT JOIN fu ON fu.doc = n.doc AND fu.lemas = array_to_string({_CONTENT.format('op.opcao')}, ' ') GROUP BY 1, 2)
 SELECT q AS pergunta_id, CASE WHEN count(*) FILTER (WHERE via = 'ausente') = 1 THEN min(opcao) FILTER (WHERE via = 'ausente') END AS regra_5, count(*) FILTER (WHERE via = 'literal') AS literal, 0::BIGINT AS sinonimo, count(*) FILTER (WHERE via = 'janela') AS janela, count(*) FILTER (WHERE via = 'ausente') AS ausente FROM va GROUP BY 1""",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
f AS (SELECT user_id, 0::BIGINT AS n, []::DOUBLE[] AS log, false AS ok, 0.0::DOUBLE AS espera FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT f.user_id, e.n, CASE WHEN len(l) < 2 THEN list_append(l, e.t) ELSE l END, len(l) < 2, CASE WHEN len(l) < 2 THEN 0.0 ELSE 21600 - (e.t - l[1]) END
  FROM (SELECT f.user_id, f.n, f.log FROM f) f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1, LATERAL (SELECT list_filter(f.log, lambda x: e.t - x < 21600) AS l) s)
SELECT user_id, count(*) FILTER (WHERE ok) AS admitidas, count(*) FILTER (WHERE NOT ok) AS negadas, round(max(espera), 3) AS maior_espera FROM f WHERE n > 0 GROUP BY 1""",
}
