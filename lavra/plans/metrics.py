"""Evaluation of answers, routers and judges over chatresponse, events and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavra.functions.text import abstains, all_tokens, citations, swap_middle, tokens
from lavra.operators import metrics as M
from lavra.operators.routing import cost, decided, with_fallback
from lavra.plans.text import fold_sql, tokens_sql
from lavra.sources.tables import table

THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9]


def _answers(spark, d):
    """One row per answer: records delivered again count once."""
    return table(spark, d, "chatresponse").dropDuplicates(["resposta_id"])


def route_cube(spark, d):
    """Answers in all, by route, by agent, by kind of input, and by route and kind: counts, rates and mean latency."""
    r = _answers(spark, d).select(
        F.coalesce("multiagente.rota", F.lit("sem rota")).alias("rota"), F.coalesce("multiagente.agente", F.lit("sem agente")).alias("agente"), F.coalesce("tipo_entrada", F.lit("")).alias("entrada"),
        F.coalesce("multiagente.fallback", F.lit(False)).alias("reserva"), F.coalesce("abstencao", F.lit(False)).alias("absteve"), (F.coalesce(F.trim("resposta"), F.lit("")) != "").alias("respondida"), F.col("latencia.llm").alias("llm"))
    sets = r.groupingSets([[], ["rota"], ["agente"], ["entrada"], ["rota", "entrada"]], "rota", "agente", "entrada")
    return sets.agg(F.count("*").alias("n"), F.count_if("reserva").alias("reservas"), F.count_if("absteve").alias("abstencoes"), F.round(F.avg(F.col("respondida").cast("double")), 6).alias("taxa_respondida"), F.round(F.avg("llm"), 6).alias("latencia_llm"))


def latency_by_channel(spark, d):
    """Mean and median latency of the whole answer by channel."""
    whole = F.coalesce("latencia.entrada", F.lit(0.0)) + F.coalesce("latencia.llm", F.lit(0.0)) + F.coalesce("latencia.tts", F.lit(0.0))
    return _answers(spark, d).groupBy(F.coalesce("canal", F.lit("")).alias("canal")).agg(F.count("*").alias("n"), F.round(F.avg(whole), 6).alias("media"), F.round(F.percentile(whole, 0.5), 6).alias("mediana"))


def citation_audit(spark, d):
    """Answers that did not abstain by their citations: all in the corpus, some outside, marks beyond the references."""
    rows = _answers(spark, d).where(~F.coalesce("abstencao", F.lit(False)) & F.col("resposta").isNotNull()).select("resposta_id", citations(F.col("resposta")).alias("marcas"), F.coalesce(F.size("referencias"), F.lit(0)).alias("n"), F.col("referencias.doc_id").alias("docs"))
    known = table(spark, d, "manifesto_corpus").select(F.col("arquivo").alias("doc")).distinct().withColumn("ha", F.lit(True))
    outside = rows.select("resposta_id", F.explode("docs").alias("doc")).join(known, "doc", "left").groupBy("resposta_id").agg(F.count_if(F.col("ha").isNull()).alias("fora"))
    phantom = F.exists("marcas", lambda m: m > F.col("n"))
    kind = F.when(F.size("marcas") == 0, "sem citacao").when(phantom, "fantasma").when(F.coalesce("fora", F.lit(0)) > 0, "fora").otherwise("fiel")
    return rows.join(outside, "resposta_id", "left").select(kind.alias("citacao")).groupBy("citacao").agg(F.count("*").alias("respostas"))


def failure_causes(spark, d):
    """Answers with any cause of failure, by their causes."""
    r = F.col("resposta")
    causes = F.array_compact(F.array(
        F.when(F.coalesce(F.trim(r), F.lit("")) == "", F.lit("vazia")), F.when(abstains(r), F.lit("abstencao")), F.when(F.coalesce("multiagente.fallback", F.lit(False)), F.lit("reserva")),
        F.when(F.col("latencia.llm") > 30, F.lit("lenta")), F.when(F.coalesce(F.size("referencias"), F.lit(0)) == 0, F.lit("sem referencia"))))
    return _answers(spark, d).select(causes.alias("c")).where(F.size("c") > 0).groupBy(F.array_join("c", "+").alias("causas")).agg(F.count("*").alias("respostas"))


def fallback_orchestration(spark, d):
    """Answers with the reserve's taken where the recorded one is blank, by outcome; the reserve is the expected text of the reference list."""
    backup = F.when(F.size("referencias") > 0, F.concat(F.lit("Ver "), F.col("referencias")[0]["doc_id"]))
    rows = _answers(spark, d).withColumn("f", with_fallback(F.col("resposta"), backup))
    return rows.groupBy(F.col("f.fallback").alias("reserva"), F.array_join("f.erros", "; ").alias("erros"), (F.col("f.resposta") == "NAO_SEI").alias("sem_resposta")).agg(F.count("*").alias("respostas"))


def _routed(spark, d):
    """Events as router rows: k of the properties gives confidence and prediction, the user the truth."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select(
        "event_id", "event_type", "k", "value", (F.col("k") / 100.0).alias("confianca"), F.when(F.col("k") % 2 == 0, "COMPLEXA").otherwise("SIMPLES").alias("previsto"), F.when(F.col("user_id") % 2 == 0, "COMPLEXA").otherwise("SIMPLES").alias("esperado"),
        F.when(F.col("event_id") % 2 == 0, "COMPLEXA").otherwise("SIMPLES").alias("segundo"), F.col("value").alias("latencia"), (F.col("value") * 10).alias("latencia_segundo"))


def router_confusion(spark, d):
    return M.confusion(_routed(spark, d), F.col("event_type"))


def threshold_sweep(spark, d):
    return M.sweep(_routed(spark, d), THRESHOLDS)


def cascade_simulation(spark, d):
    return M.cascade(_routed(spark, d), THRESHOLDS)


def calibration_bins(spark, d):
    bins = M.calibration(_routed(spark, d))
    return bins.select("faixa", "n", F.round("acuracia", 6).alias("acuracia"), F.round("confianca", 6).alias("confianca"))


def calibration_ece(spark, d):
    return M.ece_brier(M.calibration(_routed(spark, d)))


def reject_zone(spark, d):
    """Labels with a reject zone at 0.6."""
    return _routed(spark, d).groupBy(decided(F.col("confianca"), 0.6).alias("rotulo")).agg(F.count("*").alias("n"))


def judge_agreement(spark, d):
    """Agreement of two judges by event type: share, cells, share among the sure, mean score gap."""
    r = _routed(spark, d).select("event_type", (F.col("previsto") == "COMPLEXA").alias("a"), (F.col("segundo") == "COMPLEXA").alias("b"), "confianca", (F.col("k") % 5).alias("na"), (F.col("event_id") % 5).alias("nb"))
    same = F.col("a") == F.col("b")
    return r.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(same.cast("double")), 6).alias("concordancia"), F.count_if(F.col("a") & F.col("b")).alias("vp"), F.count_if(~F.col("a") & ~F.col("b")).alias("vn"), F.count_if(F.col("a") & ~F.col("b")).alias("fp"), F.count_if(~F.col("a") & F.col("b")).alias("fn"), F.round(F.avg(F.when(F.col("confianca") >= 0.7, same.cast("double"))), 6).alias("concordancia_certa"), F.round(F.avg(F.abs(F.col("na") - F.col("nb"))), 6).alias("mae"))


def cost_rollup(spark, d):
    """Tokens and dollars by event type; only complex routes are billed."""
    r = _routed(spark, d).where("k >= 60").select("event_type", F.floor(F.col("value") * 10).cast("bigint").alias("p"), (F.col("k") * 5).cast("bigint").alias("c"))
    return r.rollup("event_type").agg(F.sum("p").alias("prompt"), F.sum("c").alias("resposta"), F.round(F.sum(cost(F.col("p"), F.col("c"))), 6).alias("custo"))


def wer(spark, d):
    """Word error rate of every question with its middle swapped against the question."""
    q = table(spark, d, "perguntas_v05b").select("id", "pergunta").distinct()
    return q.select("id", F.round(M.wer(all_tokens(F.col("pergunta")), all_tokens(swap_middle(F.col("pergunta")))), 6).alias("wer"))


# Figures ---------------------------------------------------------------------


def _kinds(spark, d):
    return table(spark, d, "chunks").where("texto IS NOT NULL").select("id", "doc_id", "pagina", F.coalesce(F.lower(F.trim("tipo")), F.lit("texto")).alias("tipo"), "texto", "imagem", "novo_ratio", "sinal_dominio")


def novelty_ratio(spark, d):
    """Share of a figure's tokens that its page lacks, and that its document's text has."""
    rows = _kinds(spark, d)
    figure = rows.where("tipo = 'imagem'").select("id", "doc_id", "pagina", F.explode(tokens(F.col("texto"))).alias("termo"))
    other = rows.where("tipo <> 'imagem'").select("doc_id", "pagina", F.explode(tokens(F.col("texto"))).alias("termo"))
    page = M.set_shares(figure, other, ["doc_id", "pagina"]).select("id", F.round(1 - F.col("dentro") / F.col("termos"), 3).alias("novidade"))
    document = M.set_shares(figure.drop("pagina"), other, ["doc_id"]).select("id", F.round(F.col("dentro") / F.col("termos"), 3).alias("dominio"))
    return page.join(document, "id")


def image_admission(spark, d):
    """Figures by the first reason against admitting them."""
    r = _kinds(spark, d).where("tipo = 'imagem'")
    why = F.when(F.trim("texto") == "", "vazia").when(F.length("texto") < 30, "curta").when(F.coalesce("novo_ratio", F.lit(0.0)) < 0.45, "pouca novidade").when(F.coalesce("sinal_dominio", F.lit(0.0)) < 0.40, "fora do dominio").otherwise("admitida")
    return r.groupBy(why.alias("motivo")).agg(F.count("*").alias("figuras"))


def image_registry(spark, d):
    """Distinct images with their occurrences and the first of them."""
    r = table(spark, d, "chunks").where("imagem IS NOT NULL AND imagem.sha1 IS NOT NULL").select(F.col("imagem.sha1").alias("sha1"), F.struct(F.coalesce("doc_id", F.lit("")).alias("doc_id"), F.coalesce("pagina", F.lit(0)).alias("pagina"), F.coalesce("imagem.indice", F.lit(0)).alias("indice")).alias("o")).distinct()
    return r.groupBy("sha1").agg(F.count("*").alias("ocorrencias"), F.min("o").alias("p")).select("sha1", "ocorrencias", F.col("p.doc_id").alias("doc_id"), F.col("p.pagina").alias("pagina"), F.col("p.indice").alias("indice"))


def combined_corpus(spark, d):
    """Text chunks and admitted figures as one corpus, by document: chunks, figures, characters."""
    r = _kinds(spark, d)
    ok = (F.col("tipo") != "imagem") | ((F.length("texto") >= 30) & (F.coalesce("novo_ratio", F.lit(0.0)) >= 0.45) & (F.coalesce("sinal_dominio", F.lit(0.0)) >= 0.40))
    return r.where(ok).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("tipo") == "imagem").alias("figuras"), F.sum(F.length("texto")).alias("caracteres"))


QUERIES = {
    "route_cube": route_cube, "latency_by_channel": latency_by_channel, "citation_audit": citation_audit, "failure_causes": failure_causes, "fallback_orchestration": fallback_orchestration,
    "router_confusion": router_confusion, "threshold_sweep": threshold_sweep, "cascade_simulation": cascade_simulation, "calibration_bins": calibration_bins, "calibration_ece": calibration_ece, "reject_zone": reject_zone, "judge_agreement": judge_agreement, "cost_rollup": cost_rollup, "wer": wer,
    "novelty_ratio": novelty_ratio, "image_admission": image_admission, "image_registry": image_registry, "combined_corpus": combined_corpus,
}

_A = "a AS (SELECT DISTINCT ON (resposta_id) * FROM chatresponse)"
_R = """r AS (SELECT event_id, event_type, k, value, k / 100.0::DOUBLE AS confianca, CASE WHEN k % 2 = 0 THEN 'COMPLEXA' ELSE 'SIMPLES' END AS previsto, CASE WHEN user_id % 2 = 0 THEN 'COMPLEXA' ELSE 'SIMPLES' END AS esperado, CASE WHEN event_id % 2 = 0 THEN 'COMPLEXA' ELSE 'SIMPLES' END AS segundo FROM (SELECT *, (props::JSON->>'k')::INT AS k FROM events))"""
_T = "(SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS limiar)"
_K = "k AS (SELECT id, doc_id, pagina, coalesce(lower(trim(tipo)), 'texto') AS tipo, texto, imagem, novo_ratio, sinal_dominio FROM chunks WHERE texto IS NOT NULL)"
_ABST = r"coalesce({0} LIKE '%nao sei%' OR regexp_matches({0}, '\bnao (ha|tenho|existem?) informa'), false)".replace("{0}", r"regexp_replace(translate(" + fold_sql("resposta") + r", '_-', '  '), '[\s\x0b]+', ' ', 'g')")
_BLANK = "coalesce(trim(resposta), '') = ''"

ORACLES = {
    "route_cube": f"""WITH {_A}, r AS (SELECT coalesce(multiagente.rota, 'sem rota') AS rota, coalesce(multiagente.agente, 'sem agente') AS agente, coalesce(tipo_entrada, '') AS entrada, coalesce(multiagente.fallback, false) AS reserva, coalesce(abstencao, false) AS absteve, NOT ({_BLANK}) AS respondida, latencia.llm AS llm FROM a)
SELECT rota, agente, entrada, count(*) AS n, count(*) FILTER (WHERE reserva) AS reservas, count(*) FILTER (WHERE absteve) AS abstencoes, round(avg(respondida::INT), 6) AS taxa_respondida, round(avg(llm), 6) AS latencia_llm FROM r GROUP BY GROUPING SETS ((), (rota), (agente), (entrada), (rota, entrada))""",
    "latency_by_channel": f"WITH {_A} SELECT coalesce(canal, '') AS canal, count(*) AS n, round(avg(t), 6) AS media, round(quantile_cont(t, 0.5), 6) AS mediana FROM (SELECT canal, coalesce(latencia.entrada, 0.0) + coalesce(latencia.llm, 0.0) + coalesce(latencia.tts, 0.0) AS t FROM a) GROUP BY 1",
    "citation_audit": rf"""WITH {_A}, r AS (SELECT resposta_id, list_transform(regexp_extract_all(resposta, '\[(\d{{1,9}})\]', 1), lambda n: n::INT) AS marcas, coalesce(len(referencias), 0) AS n, list_transform(referencias, lambda x: x.doc_id) AS docs FROM a WHERE NOT coalesce(abstencao, false) AND resposta IS NOT NULL),
m AS (SELECT list(arquivo) AS todos FROM manifesto_corpus)
SELECT CASE WHEN len(marcas) = 0 THEN 'sem citacao' WHEN list_max(marcas) > n THEN 'fantasma' WHEN len(list_filter(docs, lambda x: x IS NULL OR NOT list_contains(todos, x))) > 0 THEN 'fora' ELSE 'fiel' END AS citacao, count(*) AS respostas FROM r, m GROUP BY 1""",
    "failure_causes": f"""WITH {_A} SELECT array_to_string(c, '+') AS causas, count(*) AS respostas FROM (SELECT list_filter([CASE WHEN {_BLANK} THEN 'vazia' END, CASE WHEN {_ABST} THEN 'abstencao' END, CASE WHEN coalesce(multiagente.fallback, false) THEN 'reserva' END, CASE WHEN latencia.llm > 30 THEN 'lenta' END, CASE WHEN coalesce(len(referencias), 0) = 0 THEN 'sem referencia' END], lambda x: x IS NOT NULL) AS c FROM a) WHERE len(c) > 0 GROUP BY 1""",
    "fallback_orchestration": f"""WITH {_A}, b AS (SELECT nullif(trim(resposta), '') AS p, CASE WHEN len(referencias) > 0 THEN nullif(trim('Ver ' || referencias[1].doc_id), '') END AS s FROM a)
SELECT p IS NULL AS reserva, CASE WHEN p IS NULL AND s IS NULL THEN 'principal vazio; reserva vazia' WHEN p IS NULL THEN 'principal vazio' ELSE '' END AS erros, coalesce(p, s, 'NAO_SEI') = 'NAO_SEI' AS sem_resposta, count(*) AS respostas FROM b GROUP BY 1, 2, 3""",
    "router_confusion": f"WITH {_R} SELECT event_type AS grupo, count(*) AS n, round(avg((esperado = previsto)::INT), 6) AS acuracia, count(*) FILTER (WHERE esperado = 'SIMPLES' AND previsto = 'SIMPLES') AS vp_s, count(*) FILTER (WHERE esperado = 'COMPLEXA' AND previsto = 'COMPLEXA') AS vp_c, count(*) FILTER (WHERE esperado = 'COMPLEXA' AND previsto = 'SIMPLES') AS falso_s, count(*) FILTER (WHERE esperado = 'SIMPLES' AND previsto = 'COMPLEXA') AS falso_c FROM r GROUP BY ROLLUP (event_type)",
    "threshold_sweep": f"WITH {_R} SELECT limiar, round(avg((confianca >= limiar)::INT), 6) AS decididos, round(avg((esperado = previsto)::INT) FILTER (WHERE confianca >= limiar), 6) AS acuracia, count(*) FILTER (WHERE confianca < limiar) AS escalados FROM r, {_T} GROUP BY limiar",
    "cascade_simulation": f"WITH {_R} SELECT limiar, round(avg((CASE WHEN confianca < limiar THEN segundo ELSE previsto END = esperado)::INT), 6) AS acuracia, round(avg((confianca < limiar)::INT), 6) AS escalados, round(avg(value + CASE WHEN confianca < limiar THEN value * 10 ELSE 0 END), 6) AS latencia FROM r, {_T} GROUP BY limiar",
    "calibration_bins": f"WITH {_R} SELECT least(floor(confianca * 10), 9)::INT AS faixa, count(*) AS n, round(avg((esperado = previsto)::INT), 6) AS acuracia, round(avg(confianca), 6) AS confianca FROM r GROUP BY 1",
    "calibration_ece": f"WITH {_R}, f AS (SELECT least(floor(confianca * 10), 9) AS faixa, count(*) AS n, avg((esperado = previsto)::INT) AS a, avg(confianca) AS c, sum((confianca - (esperado = previsto)::INT) ** 2) AS q FROM r GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece, round(sum(q) / sum(n), 6) AS brier FROM f",
    "reject_zone": f"WITH {_R} SELECT CASE WHEN greatest(confianca, 1 - confianca) < 0.6 THEN 'INDETERMINADO' WHEN confianca >= 0.5 THEN 'SIMPLES' ELSE 'COMPLEXA' END AS rotulo, count(*) AS n FROM r GROUP BY 1",
    "judge_agreement": f"WITH {_R}, j AS (SELECT event_type, previsto = 'COMPLEXA' AS a, segundo = 'COMPLEXA' AS b, confianca, k % 5 AS na, event_id % 5 AS nb FROM r) SELECT event_type, count(*) AS n, round(avg((a = b)::INT), 6) AS concordancia, count(*) FILTER (WHERE a AND b) AS vp, count(*) FILTER (WHERE NOT a AND NOT b) AS vn, count(*) FILTER (WHERE a AND NOT b) AS fp, count(*) FILTER (WHERE NOT a AND b) AS fn, round(avg((a = b)::INT) FILTER (WHERE confianca >= 0.7), 6) AS concordancia_certa, round(avg(abs(na - nb)), 6) AS mae FROM j GROUP BY 1",
    "cost_rollup": f"WITH {_R} SELECT event_type, sum(floor(value * 10)::BIGINT)::BIGINT AS prompt, sum(k * 5)::BIGINT AS resposta, round(sum(floor(value * 10) * 0.27 / 1e6 + k * 5 * 1.10 / 1e6), 6) AS custo FROM r WHERE k >= 60 GROUP BY ROLLUP (event_type)",
    "wer": """WITH q AS (SELECT DISTINCT id, pergunta, strip_accents(pergunta) AS t, length(strip_accents(pergunta)) // 2 AS h FROM perguntas_v05b),
v AS (SELECT id, regexp_extract_all(strip_accents(lower(pergunta)), '[a-z0-9]+') AS a, regexp_extract_all(strip_accents(lower(CASE WHEN h + 1 >= length(t) THEN t[:h] || t[h + 2:] ELSE t[:h] || t[h + 2:h + 2] || t[h + 1:h + 1] || t[h + 3:] END)), '[a-z0-9]+') AS b FROM q),
w AS (SELECT *, list_distinct(list_concat(a, b)) AS u FROM v)
SELECT id, round(levenshtein(array_to_string(list_transform(a, lambda x: chr(33 + list_position(u, x)::INT)), ''), array_to_string(list_transform(b, lambda x: chr(33 + list_position(u, x)::INT)), '')) / greatest(len(a), 1), 6) AS wer FROM w""",
    "novelty_ratio": f"""WITH {_K}, f AS (SELECT DISTINCT id, doc_id, pagina, unnest({tokens_sql('texto')}) AS t FROM k WHERE tipo = 'imagem'), o AS (SELECT DISTINCT doc_id, pagina, unnest({tokens_sql('texto')}) AS t FROM k WHERE tipo <> 'imagem'),
d AS (SELECT DISTINCT doc_id, t FROM o)
SELECT f.id, round(1 - count(o.t) / count(*), 3) AS novidade, round(count(d.t) / count(*), 3) AS dominio FROM f LEFT JOIN o ON o.doc_id = f.doc_id AND o.pagina = f.pagina AND o.t = f.t LEFT JOIN d ON d.doc_id = f.doc_id AND d.t = f.t GROUP BY f.id""",
    "image_admission": f"WITH {_K} SELECT CASE WHEN trim(texto) = '' THEN 'vazia' WHEN length(texto) < 30 THEN 'curta' WHEN coalesce(novo_ratio, 0) < 0.45 THEN 'pouca novidade' WHEN coalesce(sinal_dominio, 0) < 0.40 THEN 'fora do dominio' ELSE 'admitida' END AS motivo, count(*) AS figuras FROM k WHERE tipo = 'imagem' GROUP BY 1",
    "image_registry": "WITH o AS (SELECT DISTINCT imagem.sha1 AS sha1, coalesce(doc_id, '') AS doc_id, coalesce(pagina, 0) AS pagina, coalesce(imagem.indice, 0) AS indice FROM chunks WHERE imagem IS NOT NULL AND imagem.sha1 IS NOT NULL), n AS (SELECT *, count(*) OVER (PARTITION BY sha1) AS ocorrencias, row_number() OVER (PARTITION BY sha1 ORDER BY doc_id, pagina, indice) AS p FROM o) SELECT sha1, ocorrencias, doc_id, pagina, indice FROM n WHERE p = 1",
    "combined_corpus": f"WITH {_K} SELECT doc_id, count(*) AS chunks, count(*) FILTER (WHERE tipo = 'imagem') AS figuras, sum(length(texto))::BIGINT AS caracteres FROM k WHERE tipo <> 'imagem' OR (length(texto) >= 30 AND coalesce(novo_ratio, 0) >= 0.45 AND coalesce(sinal_dominio, 0) >= 0.40) GROUP BY 1",
}
