"""Evaluated answers: every golden question with the recorded answer of its number."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lavra.functions import text as X
from lavra.functions.text import citations
from lavra.operators import evaluation as E
from lavra.operators import retrieval as R
from lavra.operators.routing import answer_route, client_key, hard, input_status, limit_group
from lavra.plans.curation import _SCAN, _STR, _questions, _stratum
from lavra.plans.metrics import _answers, _routed, _R
from lavra.plans.retrieval import _FUSE, _LEX, _pool, _sides
from lavra.plans.text import tokens_sql
from lavra.sources.tables import table


def _evaluated(spark, d):
    """Answers with what was expected. The judge is the share of the expected answer's words: from one half on it is right; a document beyond the expected ones is made up."""
    q = _questions(spark, d).select(
        F.col("id").alias("resposta_id"), _stratum().alias("estrato"), F.coalesce("deve_abster", F.lit(False)).alias("deve"), F.coalesce(F.array_distinct("docs_esperados"), F.array().cast("array<string>")).alias("esperados"), F.col("_auditoria.resposta_esperada").alias("esperada"), "pergunta")
    a = _answers(spark, d).select(
        "resposta_id", F.coalesce("multiagente.rota", F.lit("?")).alias("rota"), F.coalesce("multiagente.agente", F.lit("?")).alias("agente"), F.coalesce("multiagente.fallback", F.lit(False)).alias("reserva"),
        F.coalesce("abstencao", F.lit(False)).alias("absteve"), "resposta", F.coalesce(citations(F.col("resposta")), F.array().cast("array<int>")).alias("marcas"),
        F.coalesce(F.array_distinct(F.filter("referencias.doc_id", lambda x: x.isNotNull())), F.array().cast("array<string>")).alias("docs"), F.col("latencia.llm").alias("latencia"))
    rows = a.join(q, "resposta_id").withColumn("respondida", F.coalesce(F.trim("resposta"), F.lit("")) != "").withColumn("contida", E.held_share(F.col("esperada"), F.col("resposta")))
    rows = rows.withColumn("julgada", F.col("contida").isNotNull() & F.col("respondida") & ~F.col("absteve"))
    judged = lambda c: F.when(F.col("julgada"), c)
    return rows.select(
        "*", judged(F.col("contida") >= 0.5).alias("correta"), judged(F.floor(F.col("contida") * 4) + 1).alias("nota"), judged(F.size(F.array_except("docs", "esperados")) > 0).alias("alucinou"),
        F.when(F.size("esperados") > 0, F.size(F.array_intersect("docs", "esperados")) / F.size("esperados")).alias("recall"), F.floor(F.length("pergunta") / 4).alias("prompt"), F.coalesce(F.floor(F.length("resposta") / 4), F.lit(0)).alias("completion"))


def e2e_summary(spark, d):
    """Answer metrics in all and by stratum."""
    return _evaluated(spark, d).rollup("estrato").agg(*E.answer_metrics())


def route_metrics(spark, d):
    """Route metrics in all, by route, by agent, by stratum, and of every cell of route and stratum that has answers."""
    return _evaluated(spark, d).groupingSets([[], ["rota"], ["agente"], ["estrato"], ["rota", "estrato"]], "rota", "agente", "estrato").agg(*E.route_metrics())


def citation_faithfulness(spark, d):
    """Citations against the expected documents, by stratum and in all."""
    return _evaluated(spark, d).rollup("estrato").agg(*E.citation_kinds(5))


def judge_summary(spark, d):
    """Judged answers by stratum and score."""
    return _evaluated(spark, d).where("julgada").rollup("estrato", "nota").agg(F.count("*").alias("n"), F.count_if("correta").alias("corretas"), F.count_if("alucinou").alias("alucinadas"))


def failed_questions(spark, d):
    """Questions that were not answered though they should have been."""
    return _evaluated(spark, d).where("absteve AND NOT deve").select("resposta_id", "estrato", F.left(F.coalesce("resposta", F.lit("")), F.lit(80)).alias("inicio"))


def two_arms(spark, d):
    """The same answers under two readings, as arms of an experiment: by the words they hold and by the documents they name."""
    arms = _evaluated(spark, d).where("contida IS NOT NULL").select("estrato", F.explode(F.array(F.struct(F.lit("palavras").alias("braco"), (F.col("contida") >= 0.5).alias("certa")), F.struct(F.lit("documentos").alias("braco"), (F.coalesce("recall", F.lit(0.0)) > 0).alias("certa")))).alias("x"))
    return arms.groupBy("x.braco").agg(F.count("*").alias("n"), E.share(F.col("x.certa")).alias("taxa"))


def arms_by_stratum(spark, d):
    """Right answers by stratum, a column a route."""
    return _evaluated(spark, d).groupBy("estrato").pivot("rota", ["simples", "complexa"]).agg(F.count_if(F.coalesce("correta", F.lit(False)))).withColumnsRenamed({"simples": "certas_simples", "complexa": "certas_complexa"}).fillna(0)


def forced_route(spark, d):
    """What the other route would gain: answers lost by one route that the answers of the stratum on the other mostly win, and its extra cost."""
    rows = _evaluated(spark, d).where("rota IN ('simples', 'complexa')")
    by = rows.groupBy("estrato", "rota").agg(F.count_if("julgada").alias("julgadas"), F.count_if(F.coalesce("correta", F.lit(False))).alias("certas"), F.count_if(F.coalesce("alucinou", F.lit(False))).alias("inventadas"), F.sum("prompt").alias("p"), F.sum("completion").alias("c"))
    one, two = (by.where(F.col("rota") == r).select("estrato", *[F.col(c).alias(f"{c}_{r}") for c in ("julgadas", "certas", "inventadas", "p", "c")]) for r in ("simples", "complexa"))
    both = one.join(two, "estrato")
    return both.select("estrato", (F.col("certas_complexa") - F.col("certas_simples")).alias("ganho"), (F.col("inventadas_complexa") - F.col("inventadas_simples")).alias("inventadas"), F.round((F.col("p_complexa") * 0.27 + F.col("c_complexa") * 1.10) / 1e6, 6).alias("custo"))


def rescued_and_missed(spark, d):
    """Questions of two arms, the five best and the ten best chunks: in which an expected document is found."""
    wanted = _questions(spark, d).select(F.col("id").alias("q"), _stratum().alias("estrato"), F.explode("docs_esperados").alias("doc"))
    best = _pool(spark, d, 10).join(table(spark, d, "chunks").select("id", F.col("doc_id").alias("doc")), "id")
    first = wanted.join(best, ["q", "doc"], "left").groupBy("q", "estrato").agg(F.min("posto").alias("posto"))
    kind = F.when(F.col("posto") <= 5, "ambos").when(F.col("posto") <= 10, "resgatada").otherwise("perdida")
    return first.groupBy("estrato", kind.alias("caso")).agg(F.count("*").alias("perguntas"))


def page_yardstick(spark, d):
    """Documents and pages found among the five best chunks, by stratum and in all.

    A page is found where a chunk holds the first 200 characters, folded, of the
    expected answer; shorter ones than 30 are no anchor. ``pagina_dado_doc`` is
    the page's share among the questions whose document was found.
    """
    q = _questions(spark, d).select(F.col("id").alias("q"), _stratum().alias("estrato"), F.coalesce("docs_esperados", F.array().cast("array<string>")).alias("docs"), F.trim(F.left(X.scan_key(F.col("_auditoria.resposta_esperada")), F.lit(200))).alias("ancora"))
    # Only the best chunks' texts are folded, where they meet their question.
    best = q.join(_pool(spark, d, 5).select("q", "id"), "q").join(table(spark, d, "chunks").select("id", "doc_id", "texto"), "id")
    held = best.select("q", F.array_contains("docs", F.col("doc_id")).alias("certo"), F.when(F.length("ancora") >= 30, F.coalesce(X.scan_key(F.col("texto")).contains(F.col("ancora")), F.lit(False))).alias("ha"))
    hits = q.select("q", "estrato", (F.length("ancora") >= 30).alias("tem")).join(held.groupBy("q").agg(F.max("certo").alias("certo"), F.max("ha").alias("ha")), "q", "left")
    hits = hits.select("estrato", F.coalesce("certo", F.lit(False)).alias("doc"), F.when(F.col("tem"), F.coalesce("ha", F.lit(False))).alias("pagina"))
    has = F.col("pagina").isNotNull()
    return hits.rollup("estrato").agg(F.count("*").alias("n"), F.count_if("doc").alias("doc"), F.count_if(has).alias("com_ancora"), F.count_if(F.coalesce("pagina", F.lit(False))).alias("pagina"), F.round(F.count_if(F.col("doc") & F.coalesce("pagina", F.lit(False))) / F.nullif(F.count_if(F.col("doc") & has), F.lit(0)), 3).alias("pagina_dado_doc"))


def retrieve(spark, d):
    """The whole retrieval for every evaluation item: 60 of either side, weighted fusion, the first 60, no repeats, five."""
    lexical, near = _sides(spark, d)
    kind = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") == 0, 1.15).otherwise(1.0).alias("fator"))
    fused = R.fuse(lexical, near).join(kind, "id").select("q", "id", (F.col("score") * F.col("fator")).alias("score"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("arquivo").alias("doc"), "pagina", X.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    kept = R.greedy_unique(R.ranked(fused, 60).select("q", "id", "posto").join(texts, "id"))
    return kept.where("posto <= 5").select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), "posto")


def keyword_context(spark, d):
    """The first five chunks that hold one of a question's first six words of four characters or more; the first five of all where none does."""
    words = F.slice(F.filter(F.split(F.lower("pergunta"), r"\s+"), lambda w: F.length(w) >= 4), 1, 6)
    q = _questions(spark, d).where("pergunta IS NOT NULL").select(F.col("id").alias("q"), F.array_distinct(words).alias("w"))
    chunks = table(spark, d, "chunks").where("texto IS NOT NULL").select("id", F.lower("texto").alias("t"))
    asked = q.select(F.explode("w").alias("w")).distinct()
    held = R.first_holding(chunks, asked, 5)
    hit = q.select("q", F.explode("w").alias("w")).join(held, "w").groupBy("q").agg(F.slice(F.array_sort(F.collect_set("id")), 1, 5).alias("ids"))
    start = chunks.orderBy("id").limit(5).agg(F.array_sort(F.collect_list("id")).alias("inicio"))
    return q.select("q").join(hit, "q", "left").join(F.broadcast(start)).select(F.col("q").alias("pergunta_id"), F.array_join(F.coalesce("ids", "inicio").cast("array<string>"), ",").alias("chunks"))


# Routing and the interface ---------------------------------------------------------


def router_dispatch(spark, d):
    """Labels of four routers by their answers' texts; whatever fails is SIMPLES, and an undecided label goes to the second router."""
    r = _routed(spark, d)
    said = F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("Rota: "), F.lower("segundo")))
    first = F.when(F.col("confianca") >= 0.7, F.col("previsto")).otherwise("INDETERMINADO")
    second = answer_route(said)
    rows = r.select(hard(F.col("previsto"), F.when(F.col("k") % 10 == 0, F.lit(" ")).otherwise(F.col("event_type"))).alias("fixo"), second.alias("texto"), F.when(first == "INDETERMINADO", second).otherwise(first).alias("cascata"), (first == "INDETERMINADO").alias("escalou"))
    return rows.groupBy("fixo", "texto", "cascata", "escalou").agg(F.count("*").alias("n"))


def chat_inputs(spark, d):
    """Requests by kind of input and status: exactly one of a file and a text, a file of a known kind that is not empty."""
    a = _answers(spark, d)
    file = F.when(F.col("tipo_entrada") != "texto", F.concat(F.lit("entrada."), F.when(F.col("tipo_entrada") == "audio", "ogg").when(F.col("resposta_id") % 5 == 0, "bmp2").otherwise("png")))
    status = input_status(file, F.col("audio_base64"), F.when((F.col("tipo_entrada") == "texto") | (F.col("resposta_id") % 7 == 0), F.col("texto")))
    return a.select(F.coalesce("tipo_entrada", F.lit("")).alias("entrada"), status.alias("s")).groupBy("entrada", F.col("s.status").alias("status"), F.col("s.tipo").alias("tipo")).agg(F.count("*").alias("pedidos"))


def fallback_reasons(spark, d):
    """Fallbacks by agent and reason; without a recorded one it is unknown."""
    m = F.col("multiagente")
    rows = _answers(spark, d).where(m["fallback"]).select(F.coalesce(m["agente"], F.lit("?")).alias("agente"), F.coalesce(F.nullif(F.trim(m["motivo"]), F.lit("")), F.lit("desconhecido")).alias("motivo"))
    return rows.groupBy("agente", "motivo").agg(F.count("*").alias("respostas"))


def request_limits(spark, d):
    """Requests by limit group and client key: the first forwarded address, else the peer's."""
    e = table(spark, d, "events")
    path = F.concat(F.lit("/"), F.when(F.col("event_type") == "click", "chat").otherwise(F.col("event_type")))
    forwarded = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(" , 10.1.1.1")))
    rows = e.select(limit_group(path).alias("g"), client_key(forwarded, F.concat(F.lit("192.168.0."), F.col("user_id").cast("string"))).alias("cliente"))
    return rows.groupBy(F.col("g.grupo").alias("grupo"), F.col("g.quantidade").alias("quantidade"), "cliente").agg(F.count("*").alias("pedidos"))


def judge_confidence(spark, d):
    """Confidence and expected score of a judge's probabilities by event type; the probabilities are made of the event's own values."""
    r = _routed(spark, d)
    p = F.create_map(F.lit("1"), 1 - F.col("confianca"), F.lit("3"), F.col("confianca") / 2, F.lit("5"), F.col("confianca") / 2)
    rows = r.select("event_type", E.confidence(F.when(F.col("k") % 4 == 0, F.col("confianca")), p).alias("c"), E.expected_score(p).alias("s"))
    return rows.groupBy("event_type").agg(F.round(F.avg("c"), 6).alias("confianca"), F.round(F.avg("s"), 6).alias("nota"))


def ownership_cost(spark, d):
    """Cost of all answers at three price mixes of a cheap and a dear model, and the share of dear answers at which a fixed cost of one dollar is earned back."""
    total = _evaluated(spark, d).agg(F.sum("prompt").alias("p"), F.sum("completion").alias("c"))
    prices = F.array(*[F.struct(F.lit(m).alias("mistura"), F.lit(a).alias("entrada"), F.lit(b).alias("saida")) for m, a, b in (("barata", 0.07, 0.30), ("meia", 0.17, 0.70), ("cara", 0.27, 1.10))])
    x = total.select("p", "c", F.explode(prices).alias("x")).withColumn("custo", (F.col("p") * F.col("x.entrada") + F.col("c") * F.col("x.saida")) / 1e6)
    return x.select(F.col("x.mistura").alias("mistura"), F.round("custo", 6).alias("custo"), F.round(1 / F.nullif(F.col("custo"), F.lit(0.0)), 3).alias("equilibrio"))


def stored_results(spark, d):
    """Route and stratum results as one comparison table, columns that one lacks null."""
    rows = _evaluated(spark, d)
    one = rows.groupBy("rota").agg(F.count("*").alias("n"), E.share(F.coalesce("correta", F.lit(False))).alias("acerto")).select(F.lit("rota").alias("fonte"), F.col("rota").alias("nome"), "n", "acerto")
    two = rows.groupBy("estrato").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 3).alias("recall")).select(F.lit("estrato").alias("fonte"), F.col("estrato").alias("nome"), "n", "recall")
    return one.unionByName(two, allowMissingColumns=True)


def grounding_hint(spark, d):
    """Questions by stratum and whether a word of the expected answer of more than four letters stands in their five best chunks."""
    q = _questions(spark, d).select(F.col("id").alias("q"), _stratum().alias("estrato"), F.filter(F.array_distinct(X.tokens(F.col("_auditoria.resposta_esperada"))), lambda w: F.length(w) > 4).alias("w")).where("w IS NOT NULL")
    # Only the best chunks' texts are cut into words, where they meet their question.
    best = q.select("q", "w").join(_pool(spark, d, 5).select("q", "id"), "q").join(table(spark, d, "chunks").select("id", "texto"), "id")
    found = best.groupBy("q").agg(F.max(F.arrays_overlap("w", X.tokens(F.col("texto")))).alias("ha"))
    hit = q.select("q", "estrato").join(found, "q", "left").select("estrato", F.coalesce("ha", F.lit(False)).alias("fundada"))
    return hit.groupBy("estrato", "fundada").agg(F.count("*").alias("perguntas"))


def answer_rates(spark, d):
    """Rates of answers that abstain, that keep to thirty words and that hold an object, by channel; and how often two orders of the same pair differ in preference."""
    r = F.col("resposta")
    words = F.size(F.filter(F.split(F.trim(r), r"\s+"), lambda w: w != ""))
    rows = _answers(spark, d).where(r.isNotNull()).select(F.coalesce("canal", F.lit("")).alias("canal"), X.abstains(r).alias("a"), (words <= 30).alias("b"), (X.first_object(r) != "").alias("o"), (F.length(r) > F.length(F.coalesce("texto", F.lit("")))).alias("p"), (F.length(r) >= F.length(F.coalesce("texto", F.lit("")))).alias("s"))
    return rows.groupBy("canal").agg(F.count("*").alias("n"), E.share(F.col("a")).alias("abstencao"), E.share(F.col("b")).alias("curtas"), E.share(F.col("o")).alias("json"), E.share(F.col("p")).alias("preferencia"), E.share(F.col("p") != F.col("s")).alias("vies_posicao"))


QUERIES = {
    "e2e_summary": e2e_summary, "route_metrics": route_metrics, "citation_faithfulness": citation_faithfulness, "judge_summary": judge_summary, "failed_questions": failed_questions, "two_arms": two_arms, "arms_by_stratum": arms_by_stratum,
    "forced_route": forced_route, "rescued_and_missed": rescued_and_missed, "page_yardstick": page_yardstick, "retrieve": retrieve, "keyword_context": keyword_context, "router_dispatch": router_dispatch, "chat_inputs": chat_inputs,
    "fallback_reasons": fallback_reasons, "request_limits": request_limits, "judge_confidence": judge_confidence, "ownership_cost": ownership_cost, "stored_results": stored_results, "grounding_hint": grounding_hint, "answer_rates": answer_rates,
}

_EV = rf"""WITH gq AS (SELECT DISTINCT ON (id) * FROM perguntas_v05b),
ga AS (SELECT DISTINCT ON (resposta_id) * FROM chatresponse),
ej AS (SELECT a.resposta_id, {_STR} AS estrato, coalesce(deve_abster, false) AS deve, coalesce(list_distinct(docs_esperados), []) AS esperados, _auditoria.resposta_esperada AS esperada, pergunta, coalesce(multiagente.rota, '?') AS rota, coalesce(multiagente.agente, '?') AS agente,
  coalesce(multiagente.fallback, false) AS reserva, coalesce(abstencao, false) AS absteve, resposta, coalesce(list_transform(regexp_extract_all(resposta, '\[(\d{{1,9}})\]', 1), lambda n: n::INT), []) AS marcas,
  coalesce(list_distinct(list_filter(list_transform(referencias, lambda x: x.doc_id), lambda x: x IS NOT NULL)), []) AS docs, latencia.llm AS latencia, coalesce(trim(resposta), '') <> '' AS respondida FROM ga a JOIN gq q ON q.id = a.resposta_id),
ec AS (SELECT *, len(list_intersect(list_distinct({tokens_sql('esperada')}), {tokens_sql('resposta')})) / nullif(len(list_distinct({tokens_sql('esperada')})), 0) AS contida FROM ej),
eg AS (SELECT *, contida IS NOT NULL AND respondida AND NOT absteve AS julgada FROM ec),
ev AS (SELECT *, CASE WHEN julgada THEN contida >= 0.5 END AS correta, CASE WHEN julgada THEN floor(contida * 4)::BIGINT + 1 END AS nota, CASE WHEN julgada THEN len(list_filter(docs, lambda x: NOT list_contains(esperados, x))) > 0 END AS alucinou,
  CASE WHEN len(esperados) > 0 THEN len(list_intersect(docs, esperados)) / len(esperados) END AS recall, length(pergunta) // 4 AS prompt, coalesce(length(resposta) // 4, 0) AS completion FROM eg)"""
_TOP = ", best AS (SELECT rk.q, c.doc_id, c.texto, rk.posto FROM rk JOIN chunks c ON c.id = rk.id WHERE posto <= {k})"
_GQ = rf"gold AS (SELECT DISTINCT ON (id) id AS q, {_STR} AS estrato, coalesce(docs_esperados, []) AS docs, _auditoria.resposta_esperada AS esperada, pergunta FROM perguntas_v05b)"

ORACLES = {
    "e2e_summary": _EV + """ SELECT estrato, count(*) AS n, round(avg(recall), 3) AS recall, round(count(*) FILTER (WHERE correta AND julgada) / greatest(1, count(*) FILTER (WHERE julgada)), 3) AS acerto_julgadas, round(avg(coalesce(correta, false)::INT), 3) AS acerto_todas,
 round(avg((absteve = deve)::INT), 3) AS abstencao_correta, count(*) FILTER (WHERE absteve AND NOT deve) AS abstencao_indevida, round(count(*) FILTER (WHERE absteve AND NOT deve) / greatest(1, count(*) FILTER (WHERE NOT deve)), 3) AS taxa_indevida,
 round(count(*) FILTER (WHERE len(marcas) > 0 AND NOT absteve) / greatest(1, count(*) FILTER (WHERE NOT absteve)), 3) AS citacao, count(*) FILTER (WHERE NOT julgada) AS nao_julgadas FROM ev GROUP BY ROLLUP (estrato)""",
    "route_metrics": _EV + """ SELECT rota, agente, estrato, count(*) AS n, count(*) FILTER (WHERE julgada) AS julgadas, count(*) FILTER (WHERE correta) AS acertos, round(count(*) FILTER (WHERE correta) / nullif(count(*) FILTER (WHERE julgada), 0), 3) AS acuracia,
 count(*) FILTER (WHERE alucinou) AS alucinacoes, round(coalesce(sum(nota), 0) / greatest(1, count(nota)), 2) AS nota_media, round(avg((absteve = deve)::INT), 3) AS abstencao_correta, round(count(*) FILTER (WHERE respondida AND NOT absteve) / greatest(1, count(*) FILTER (WHERE NOT absteve)), 3) AS nao_vazias,
 sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, round(sum(prompt) * 0.27 / 1e6 + sum(completion) * 1.10 / 1e6, 5) AS custo, round(avg(coalesce(latencia, 0)), 2) AS latencia_media, count(*) FILTER (WHERE reserva) AS reservas
 FROM ev GROUP BY GROUPING SETS ((), (rota), (agente), (estrato), (rota, estrato))""",
    "citation_faithfulness": _EV + """, c AS (SELECT estrato, NOT absteve AS corpo, NOT absteve AND len(marcas) > 0 AND len(esperados) > 0 AS citada, len(docs) > 0 AND len(list_filter(docs, lambda x: NOT list_contains(esperados, x))) = 0 AS fiel, coalesce(list_max(marcas) > 5, false) AS fantasma FROM ev)
 SELECT estrato, count(*) FILTER (WHERE corpo) AS corpo, count(*) FILTER (WHERE citada) AS com_citacao, count(*) FILTER (WHERE citada AND fiel) AS fiel, count(*) FILTER (WHERE citada AND NOT fiel) AS fora, count(*) FILTER (WHERE citada AND fantasma) AS fantasma FROM c GROUP BY ROLLUP (estrato)""",
    "judge_summary": _EV + " SELECT estrato, nota, count(*) AS n, count(*) FILTER (WHERE correta) AS corretas, count(*) FILTER (WHERE alucinou) AS alucinadas FROM ev WHERE julgada GROUP BY ROLLUP (estrato, nota)",
    "failed_questions": _EV + " SELECT resposta_id, estrato, left(coalesce(resposta, ''), 80) AS inicio FROM ev WHERE absteve AND NOT deve",
    "two_arms": _EV + " SELECT 'palavras' AS braco, count(*) AS n, round(avg((contida >= 0.5)::INT), 3) AS taxa FROM ev WHERE contida IS NOT NULL UNION ALL SELECT 'documentos', count(*), round(avg((coalesce(recall, 0) > 0)::INT), 3) FROM ev WHERE contida IS NOT NULL",
    "arms_by_stratum": _EV + " SELECT estrato, count(*) FILTER (WHERE rota = 'simples' AND correta) AS certas_simples, count(*) FILTER (WHERE rota = 'complexa' AND correta) AS certas_complexa FROM ev GROUP BY 1",
    "forced_route": _EV + """, b AS (SELECT estrato, rota, count(*) FILTER (WHERE correta) AS c, count(*) FILTER (WHERE alucinou) AS i, sum(prompt) * 0.27 + sum(completion) * 1.10 AS u FROM ev GROUP BY 1, 2)
 SELECT s.estrato, x.c - s.c AS ganho, x.i - s.i AS inventadas, round(x.u / 1e6, 6) AS custo FROM b s JOIN b x ON x.estrato = s.estrato WHERE s.rota = 'simples' AND x.rota = 'complexa'""",
    "rescued_and_missed": _LEX + _TOP.format(k=10) + f", {_GQ}, w AS (SELECT q, estrato, unnest(docs) AS doc FROM gold), f AS (SELECT w.q, w.estrato, min(posto) AS posto FROM w LEFT JOIN best b ON b.q = w.q AND b.doc_id = w.doc GROUP BY 1, 2) SELECT estrato, CASE WHEN posto <= 5 THEN 'ambos' WHEN posto <= 10 THEN 'resgatada' ELSE 'perdida' END AS caso, count(*) AS perguntas FROM f GROUP BY 1, 2",
    "page_yardstick": _LEX + _TOP.format(k=5) + f""", {_GQ}, an AS (SELECT *, trim(left({_SCAN.format('esperada')}, 200)) AS ancora FROM gold), h AS (SELECT an.q, estrato, coalesce(bool_or(list_contains(docs, doc_id)), false) AS doc, bool_or(CASE WHEN length(ancora) >= 30 THEN coalesce(contains({_SCAN.format('texto')}, ancora), false) END) AS pagina FROM an LEFT JOIN best b ON b.q = an.q GROUP BY 1, 2)
 SELECT estrato, count(*) AS n, count(*) FILTER (WHERE doc) AS doc, count(pagina) AS com_ancora, count(*) FILTER (WHERE pagina) AS pagina, round(count(*) FILTER (WHERE doc AND pagina) / nullif(count(*) FILTER (WHERE doc AND pagina IS NOT NULL), 0), 3) AS pagina_dado_doc FROM h GROUP BY ROLLUP (estrato)""",
    "retrieve": _FUSE + f""", fu AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, id) AS posto FROM (SELECT q, id, (1.0 * l + 1.5 * r) * CASE WHEN v.label = 0 THEN 1.15 ELSE 1.0 END AS s FROM un JOIN v ON v.vec_id = un.id) WHERE s > 0),
ca AS (SELECT q, list({{'posto': posto, 'id': id, 'doc': arquivo, 'pagina': pagina, 't': {tokens_sql("coalesce(text, '')")}, 's': list_distinct({tokens_sql("coalesce(text, '')")})}} ORDER BY posto) AS c FROM fu JOIN documents d ON d.doc_id = fu.id WHERE posto <= 60 GROUP BY q),
ke AS (SELECT q, list_reduce(list_transform(c, lambda x: [x]), lambda s, x: CASE WHEN len(list_filter(s, lambda o: o.doc = x[1].doc AND (o.t = x[1].t OR (o.pagina = x[1].pagina AND least(len(o.s), len(x[1].s)) > 0 AND len(list_intersect(o.s, x[1].s)) >= 0.85 * least(len(o.s), len(x[1].s)))))) > 0 THEN s ELSE list_concat(s, x) END) AS k FROM ca)
SELECT q AS item_id, k[n].id AS doc_id, n AS posto FROM (SELECT q, k, unnest(generate_series(1, least(len(k), 5))) AS n FROM ke)""",
    "keyword_context": f"""WITH {_GQ}, w AS (SELECT q, list_distinct(list_filter(string_split_regex(lower(pergunta), '\\s+'), lambda x: length(x) >= 4)[1:6]) AS w FROM gold WHERE pergunta IS NOT NULL), u AS (SELECT q, unnest(w) AS w FROM w),
h AS (SELECT u.q, c.id FROM u JOIN chunks c ON contains(lower(c.texto), u.w) GROUP BY 1, 2), r AS (SELECT q, id FROM h QUALIFY row_number() OVER (PARTITION BY q ORDER BY id) <= 5), s AS (SELECT string_agg(id::VARCHAR, ',' ORDER BY id) AS inicio FROM (SELECT id FROM chunks WHERE texto IS NOT NULL ORDER BY id LIMIT 5))
SELECT w.q AS pergunta_id, coalesce(string_agg(r.id::VARCHAR, ',' ORDER BY r.id), any_value(inicio)) AS chunks FROM w LEFT JOIN r ON r.q = w.q, s GROUP BY w.q""",
    "router_dispatch": f"""WITH {_R}, x AS (SELECT CASE WHEN k % 10 = 0 THEN 'SIMPLES' ELSE previsto END AS fixo, CASE WHEN event_id % 11 <> 0 AND segundo = 'COMPLEXA' THEN 'COMPLEXA' ELSE 'SIMPLES' END AS texto, previsto, confianca < 0.7 AS escalou FROM r)
 SELECT fixo, texto, CASE WHEN escalou THEN texto ELSE previsto END AS cascata, escalou, count(*) AS n FROM x GROUP BY ALL""",
    "chat_inputs": """WITH a AS (SELECT DISTINCT ON (resposta_id) * FROM chatresponse),
x AS (SELECT coalesce(tipo_entrada, '') AS entrada, tipo_entrada <> 'texto' AS arquivo, CASE WHEN tipo_entrada = 'audio' THEN 'audio' WHEN resposta_id % 5 <> 0 THEN 'imagem' END AS kind, coalesce(audio_base64, '') <> '' AS cheio, coalesce(CASE WHEN tipo_entrada = 'texto' OR resposta_id % 7 = 0 THEN trim(texto) END, '') <> '' AS texto FROM a),
y AS (SELECT entrada, CASE WHEN coalesce(arquivo, false) = texto THEN 400 WHEN texto THEN 200 WHEN kind IS NULL THEN 415 WHEN NOT cheio THEN 400 ELSE 200 END AS status, texto, kind FROM x)
 SELECT entrada, status, CASE WHEN status = 200 THEN CASE WHEN texto THEN 'texto' ELSE kind END END AS tipo, count(*) AS pedidos FROM y GROUP BY ALL""",
    "fallback_reasons": "WITH a AS (SELECT DISTINCT ON (resposta_id) * FROM chatresponse) SELECT coalesce(multiagente.agente, '?') AS agente, coalesce(nullif(trim(multiagente.motivo), ''), 'desconhecido') AS motivo, count(*) AS respostas FROM a WHERE multiagente.fallback GROUP BY 1, 2",
    "request_limits": "SELECT CASE WHEN event_type = 'click' THEN 'chat' ELSE 'geral' END AS grupo, CASE WHEN event_type = 'click' THEN 4 ELSE 300 END AS quantidade, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || user_id ELSE '192.168.0.' || user_id END AS cliente, count(*) AS pedidos FROM events GROUP BY ALL",
    "judge_confidence": f"WITH {_R} SELECT event_type, round(avg(CASE WHEN k % 4 = 0 THEN confianca ELSE greatest(1 - confianca, confianca / 2) END), 6) AS confianca, round(avg(1 - confianca + 4 * confianca), 6) AS nota FROM r GROUP BY 1",
    "ownership_cost": _EV + ", t AS (SELECT sum(prompt) AS p, sum(completion) AS c FROM ev), x AS (SELECT unnest(['barata', 'meia', 'cara']) AS mistura, unnest([0.07, 0.17, 0.27])::DOUBLE AS e, unnest([0.30, 0.70, 1.10])::DOUBLE AS s) SELECT mistura, round((p * e + c * s) / 1e6, 6) AS custo, round(1 / nullif((p * e + c * s) / 1e6, 0), 3) AS equilibrio FROM t, x",
    "stored_results": _EV + " SELECT 'rota' AS fonte, rota AS nome, count(*) AS n, round(avg(coalesce(correta, false)::INT), 3) AS acerto, NULL::DOUBLE AS recall FROM ev GROUP BY rota UNION ALL SELECT 'estrato', estrato, count(*), NULL, round(avg(recall), 3) FROM ev GROUP BY estrato",
    "grounding_hint": _LEX + _TOP.format(k=5) + f", {_GQ}, w AS (SELECT q, estrato, list_filter(list_distinct({tokens_sql('esperada')}), lambda x: length(x) > 4) AS w FROM gold WHERE esperada IS NOT NULL), h AS (SELECT w.q, estrato, coalesce(bool_or(list_has_any(w, {tokens_sql('texto')})), false) AS fundada FROM w LEFT JOIN best b ON b.q = w.q GROUP BY 1, 2) SELECT estrato, fundada, count(*) AS perguntas FROM h GROUP BY 1, 2",
    "answer_rates": r"""WITH a AS (SELECT DISTINCT ON (resposta_id) * FROM chatresponse), k AS (SELECT *, regexp_replace(translate(strip_accents(lower(resposta)), '_-', '  '), '[\s\x0b]+', ' ', 'g') AS t FROM a WHERE resposta IS NOT NULL)
SELECT coalesce(canal, '') AS canal, count(*) AS n, round(avg((t LIKE '%nao sei%' OR regexp_matches(t, '\bnao (ha|tenho|existem?) informa'))::INT), 3) AS abstencao, round(avg((len(list_filter(string_split_regex(trim(resposta), '[\s\x0b]+'), lambda w: w <> '')) <= 30)::INT), 3) AS curtas, round(avg(regexp_matches(resposta, '(?s)\{.*\}')::INT), 3) AS json,
 round(avg((length(resposta) > length(coalesce(texto, '')))::INT), 3) AS preferencia, round(avg((length(resposta) = length(coalesce(texto, '')))::INT), 3) AS vies_posicao FROM k GROUP BY 1""",
}
