"""Chunking, ranking, fusion and retrieval scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavra.functions.text import tokens
from lavra.operators import chunking as C
from lavra.operators import retrieval as R
from lavra.plans.text import STOP_SQL, tokens_sql
from lavra.sources.tables import table

# Chunks --------------------------------------------------------------------


def paragraph_split(spark, d):
    """Paragraphs and sentences of every document."""
    t = C.normalized(F.col("text"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(C.paragraphs(t)).cast("bigint").alias("paragrafos"), F.size(C.sentences(t)).cast("bigint").alias("frases"), F.length(t).cast("bigint").alias("tamanho"))


def sentence_pack(spark, d):
    """Sentences of every document packed to 400 characters."""
    packs = C.packed(C.sentences(C.normalized(F.col("text"))), 400)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(packs).alias("n", "grupo")).select("doc_id", "n", F.length("grupo").cast("bigint").alias("tamanho"), F.md5("grupo").alias("resumo"))


def chunk_documents(spark, d):
    """Boundary chunks of every document with the overlap."""
    return C.chunk_rows(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "n", "texto", F.col("tokens").cast("bigint").alias("tokens"), F.col("chars").cast("bigint").alias("chars"))


def chunk_filter_stats(spark, d):
    """Chunks of the table by whether they are dense enough, and by type."""
    rows = table(spark, d, "chunks").where("texto IS NOT NULL")
    dense = (F.length("texto") >= 100) & (F.size(F.filter(F.split("texto", r"\s+"), lambda w: w != "")) > 2)
    return rows.groupBy(F.coalesce(F.lower(F.trim("tipo")), F.lit("texto")).alias("tipo"), dense.alias("denso")).agg(F.count("*").alias("chunks"))


def fixed_windows(spark, d):
    """Windows of 1000 characters over every document."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(C.fixed_windows(F.col("text"))).alias("n", "janela")).select("doc_id", "n", F.md5("janela").alias("resumo"))


def slide_prefix(spark, d):
    """Leading lines of every chunk, to 160 characters."""
    return table(spark, d, "chunks").where("texto IS NOT NULL").select("id", C.slide_prefix(F.col("texto")).alias("prefixo"))


# Lexical ranking -------------------------------------------------------------


def _questions(spark, d):
    return table(spark, d, "perguntas_v05b").select("id", "pergunta", "estrato", "docs_esperados").dropDuplicates(["id"])


def _pool(spark, d, size):
    return R.bm25_best(_questions(spark, d), table(spark, d, "chunks"), size)


def bm25_idf(spark, d):
    """Document frequency and idf of every term of the chunks."""
    chunks = table(spark, d, "chunks")
    posted = R.postings(chunks, "id", "texto")
    return R.idf(posted, R.corpus_size(chunks, "texto", posted)).withColumn("idf", F.round("idf", 6))


def bm25_topk(spark, d):
    """The five best chunks of every evaluation question."""
    return _pool(spark, d, 5).select(F.col("q").alias("pergunta_id"), F.col("id").alias("chunk_id"), F.col("posto"), F.round("score", 6).alias("score"))


def near_dup_greedy(spark, d):
    """The first five of the 60 best chunks of every question that repeat none before them."""
    chunks = table(spark, d, "chunks").select("id", F.col("doc_id").alias("doc"), "pagina", F.col("texto").alias("t"))
    kept = R.greedy_unique_of(_pool(spark, d, 60).select("q", "id", "posto"), chunks, 5)
    return kept.select(F.col("q").alias("pergunta_id"), F.col("id").alias("chunk_id"), "posto")


def context_format(spark, d):
    """The context of every question: its three best chunks as one numbered text."""
    chunks = table(spark, d, "chunks").select("id", "doc_id", "pagina", "tipo", "texto")
    image = F.when(F.lower(F.trim("tipo")) == "imagem", " (imagem/figura OCR)").otherwise("")
    line = F.concat(F.lit("["), F.col("posto").cast("string"), F.lit("] "), F.col("doc_id"), F.lit(", pagina "), F.col("pagina").cast("string"), image, F.lit(": "), F.col("texto"))
    rows = _pool(spark, d, 3).join(chunks, "id").select(F.col("q").alias("pergunta_id"), "posto", line.alias("linha"))
    return rows.groupBy("pergunta_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("posto", "linha"))), lambda s: s["linha"]), "\n\n")).alias("contexto"))


def _scored(spark, d, k):
    docs = table(spark, d, "chunks").select("id", F.col("doc_id").alias("doc"))
    hits = _pool(spark, d, k).select("q", "id", "posto").join(docs, "id")
    return R.recall_and_rank(hits, _questions(spark, d).select(F.col("id").alias("q"), F.col("docs_esperados").alias("docs")))


def recall_at_k(spark, d):
    """Recall at 5 and reciprocal rank of every question with expected documents."""
    return _scored(spark, d, 5).select(F.col("q").alias("pergunta_id"), F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


def retrieval_by_stratum(spark, d):
    """Mean recall and reciprocal rank, in all and by stratum."""
    strata = _questions(spark, d).select(F.col("id").alias("q"), F.regexp_replace(F.lower("estrato"), r"[\s_]+", "").alias("estrato"))
    return _scored(spark, d, 5).join(strata, "q").rollup("estrato").agg(F.count("*").alias("perguntas"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr"))


def pool_sweep(spark, d):
    """Recall by the size of the pool."""
    docs = table(spark, d, "chunks").select("id", F.col("doc_id").alias("doc"))
    hits = _pool(spark, d, 60).select("q", "id", "posto").join(docs, "id")
    wanted = _questions(spark, d).where(F.size("docs_esperados") > 0).select(F.col("id").alias("q"), F.size(F.array_distinct("docs_esperados")).alias("n"), F.explode(F.array_distinct("docs_esperados")).alias("doc"))
    # A document counts for each pool that reaches its first hit.
    first = hits.join(wanted, ["q", "doc"]).groupBy("q", "n", "doc").agg(F.min("posto").alias("posto"))
    found = first.select("q", "n", F.explode(F.array(*[F.lit(n) for n in (5, 10, 30, 60)])).alias("pool"), "posto").where("posto <= pool").groupBy("pool", "q", "n").agg(F.count("*").alias("achados"))
    total = wanted.select("q").distinct().agg(F.count("*").alias("perguntas"))
    return found.groupBy("pool").agg(F.sum(F.col("achados") / F.col("n")).alias("soma")).join(F.broadcast(total)).select("pool", F.round(F.col("soma") / F.col("perguntas"), 6).alias("recall"))


def expected_position(spark, d):
    """Zero-based place of the first chunk of an expected document in the pool of 60."""
    docs = table(spark, d, "chunks").select("id", F.col("doc_id").alias("doc"))
    wanted = _questions(spark, d).select(F.col("id").alias("q"), F.explode("docs_esperados").alias("doc")).distinct()
    return _pool(spark, d, 60).select("q", "id", "posto").join(docs, "id").join(wanted, ["q", "doc"]).groupBy(F.col("q").alias("pergunta_id")).agg((F.min("posto") - 1).cast("bigint").alias("posicao"))


# Dense ranking and fusion ------------------------------------------------------


def dense_topk(spark, d):
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    vectors = table(spark, d, "embeddings")
    return R.dense(vectors, vectors.where("vec_id % 100 = 0")).select(F.col("q").alias("consulta"), F.col("id").alias("vec_id"), "posto", F.round("score", 6).alias("cosseno"))


def vector_normalize(spark, d):
    """Length and first component of every normalised vector."""
    n = R.normalize(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(n, F.lit(0.0), lambda s, x: s + x * x), 6).alias("norma"), F.round(F.element_at(n, 1), 6).alias("primeiro"))


def _sides(spark, d):
    """Lexical and dense pools of the evaluation items over documents that have a vector; an item's vector is that of its id."""
    vectors = table(spark, d, "embeddings")
    items = table(spark, d, "itens_avaliacao").select(F.col("item_id").cast("bigint").alias("item_id"), "texto")
    texts = table(spark, d, "documents").select("doc_id", "text").join(vectors.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    near = R.dense(vectors.join(texts.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), vectors.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi"), k=60)
    return R.ranked(R.bm25(items, texts, query_id="item_id", query="texto", id="doc_id", text="text"), 60), near


def rrf_fusion(spark, d):
    """The ten best documents of every item by weighted reciprocal ranks, images raised by 15 per cent."""
    lexical, near = _sides(spark, d)
    kind = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") == 0, 1.15).otherwise(1.0).alias("fator"))
    fused = R.fuse(lexical, near).join(kind, "id").select("q", "id", (F.col("score") * F.col("fator")).alias("score"))
    return R.ranked(fused, 10).select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), "posto", F.round("score", 9).alias("score"))


def rrf_grid(spark, d):
    """Mean fused score of the first document under fifteen pairs of weights."""
    lexical, near = _sides(spark, d)
    left = lexical.select("q", "id", (1 / (F.col("posto") + 60)).alias("l"), F.lit(0.0).alias("r"))
    right = near.select("q", "id", F.lit(0.0).alias("l"), (1 / (F.col("posto") + 60)).alias("r"))
    both = left.unionByName(right).groupBy("q", "id").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    pairs = F.array(*[F.struct(F.lit(a).alias("wl"), F.lit(b).alias("wd")) for a in (0.5, 1.0, 1.5) for b in (0.5, 1.0, 1.25, 1.5, 2.0)])
    # The grid unfolds after fusion: scores, not rankings, are repeated.
    grid = both.select("q", "id", "l", "r", F.explode(pairs).alias("w")).select(F.col("w.wl").alias("peso_lexico"), F.col("w.wd").alias("peso_denso"), "q", "id", F.round(F.col("w.wl") * F.col("l") + F.col("w.wd") * F.col("r"), 9).alias("score"))
    best = grid.groupBy("peso_lexico", "peso_denso", "q").agg(F.max("score").alias("melhor"))
    return best.groupBy("peso_lexico", "peso_denso").agg(F.count("*").alias("itens"), F.round(F.avg("melhor"), 6).alias("media"))


QUERIES = {
    "paragraph_split": paragraph_split, "sentence_pack": sentence_pack, "chunk_documents": chunk_documents, "chunk_filter_stats": chunk_filter_stats, "fixed_windows": fixed_windows, "slide_prefix": slide_prefix,
    "bm25_idf": bm25_idf, "bm25_topk": bm25_topk, "near_dup_greedy": near_dup_greedy, "context_format": context_format,
    "recall_at_k": recall_at_k, "retrieval_by_stratum": retrieval_by_stratum, "pool_sweep": pool_sweep, "expected_position": expected_position,
    "dense_topk": dense_topk, "vector_normalize": vector_normalize, "rrf_fusion": rrf_fusion, "rrf_grid": rrf_grid,
}

_WS = r"[\s\x0b]"
_STRIP = rf"regexp_replace({{0}}, '^{_WS}+|{_WS}+$', '', 'g')"
_NORM = _STRIP.format(r"regexp_replace(regexp_replace(regexp_replace({0}, '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
_KEPT = "list_filter(list_transform({0}, lambda z: " + _STRIP.format("z") + "), lambda z: z <> '')"
_PARS = _KEPT.format(rf"string_split_regex({{0}}, '\n{_WS}*\n')")
_SENT = _KEPT.format(rf"string_split(regexp_replace({{0}}, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1))")


def _packed(parts: str, longest: int) -> str:
    """Packs as a fold over (open group, closed groups)."""
    fold = f"list_reduce(list_transform({parts}, lambda z: {{'a': z, 'f': []::VARCHAR[]}}), lambda s, x: CASE WHEN s.a = '' THEN {{'a': x.a, 'f': s.f}} WHEN length(s.a) + length(x.a) + 1 <= {longest} THEN {{'a': s.a || ' ' || x.a, 'f': s.f}} ELSE {{'a': x.a, 'f': list_append(s.f, s.a)}} END, {{'a': '', 'f': []::VARCHAR[]}})"
    return f"(SELECT CASE WHEN e.a = '' THEN e.f ELSE list_append(e.f, e.a) END FROM (SELECT {fold} AS e))"


_BM = f"""
tk AS (SELECT id, t, len(t) AS dl FROM (SELECT id, {tokens_sql('texto')} AS t FROM {{texts}})),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM tk),
po AS (SELECT termo, id, dl, count(*) AS tf FROM (SELECT id, dl, unnest(t) AS termo FROM tk) GROUP BY ALL),
idf AS (SELECT termo, count(*) AS df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM po, st GROUP BY termo),
qt AS (SELECT q, termo, count(*) AS qtf FROM (SELECT q, unnest(list_filter({tokens_sql('pergunta')}, lambda t: NOT list_contains({STOP_SQL}, t))) AS termo FROM {{queries}}) GROUP BY ALL),
sc AS (SELECT q, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM qt JOIN idf USING (termo) JOIN po USING (termo), st GROUP BY q, id),
rk AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS posto FROM sc WHERE score > 0)"""
_QS = "qs AS (SELECT id AS q, any_value(pergunta) AS pergunta, any_value(estrato) AS estrato, any_value(docs_esperados) AS docs FROM perguntas_v05b GROUP BY id)"
_LEX = f"WITH {_QS}," + _BM.replace("{texts}", "(SELECT id, texto FROM chunks WHERE texto IS NOT NULL)").replace("{queries}", "qs")
_SCORE = """,
alvo AS (SELECT q, len(list_distinct(docs)) AS n, unnest(list_distinct(docs)) AS doc FROM qs WHERE len(docs) > 0),
achou AS (SELECT a.q, a.n, a.doc, min(r.posto) AS posto FROM alvo a LEFT JOIN (SELECT rk.q, rk.posto, c.doc_id AS doc FROM rk JOIN chunks c ON c.id = rk.id WHERE posto <= 5) r ON r.q = a.q AND r.doc = a.doc GROUP BY a.q, a.n, a.doc),
nota AS (SELECT q, count(posto) / any_value(n) AS recall, coalesce(1 / min(posto), 0.0) AS mrr FROM achou GROUP BY q)"""
_DENSE = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"""
_FUSE = f"""
WITH docs AS (SELECT d.doc_id AS id, d.text AS texto FROM documents d WHERE d.text IS NOT NULL AND d.doc_id IN (SELECT vec_id FROM embeddings)),
todos AS (SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
qs AS (SELECT item_id AS q, texto AS pergunta FROM itens_avaliacao),""" + _BM.replace("{texts}", "docs").replace("{queries}", "qs") + """,
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
de AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, id) AS posto FROM (SELECT a.vec_id AS q, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS s FROM v a, v b WHERE a.vec_id IN (SELECT q FROM qs) AND b.vec_id IN (SELECT id FROM todos))),
un AS (SELECT q, id, sum(l) AS l, sum(r) AS r FROM (SELECT q, id, 1 / (posto + 60) AS l, 0.0 AS r FROM rk WHERE posto <= 60 UNION ALL SELECT q, id, 0.0, 1 / (posto + 60) FROM de WHERE posto <= 60) GROUP BY q, id)"""
_TAIL = rf"(CASE WHEN length({{0}}) <= 100 THEN {{0}} ELSE regexp_replace(CASE WHEN strpos(right({{0}}, 100), ' ') BETWEEN 1 AND 20 THEN substring(right({{0}}, 100), strpos(right({{0}}, 100), ' ') + 1) ELSE right({{0}}, 100) END, '^{_WS}+', '') END)"

ORACLES = {
    "paragraph_split": f"SELECT doc_id, len({_PARS.format('t')}) AS paragrafos, len({_SENT.format('t')}) AS frases, length(t) AS tamanho FROM (SELECT doc_id, {_NORM.format('text')} AS t FROM documents WHERE text IS NOT NULL)",
    "sentence_pack": f"SELECT doc_id, (n - 1)::INT AS n, length(g[n]) AS tamanho, md5(g[n]) AS resumo FROM (SELECT doc_id, g, unnest(generate_series(1, len(g))) AS n FROM (SELECT doc_id, {_packed('p', 400)} AS g FROM (SELECT doc_id, {_SENT.format(_NORM.format('text'))} AS p FROM documents WHERE text IS NOT NULL)))",
    "chunk_documents": rf"""
WITH RECURSIVE pa AS (SELECT doc_id, unnest(p) AS par, unnest(generate_series(1, len(p))) AS i, len(p) AS total FROM (SELECT doc_id, {_PARS.format(_NORM.format('text'))} AS p FROM documents WHERE text IS NOT NULL) WHERE len(p) > 0),
gg AS (SELECT doc_id, i, CASE WHEN length(par) > 1200 THEN {_packed('sl', 1200)} ELSE NULL END AS g FROM (SELECT doc_id, i, par, {_SENT.format('par')} AS sl FROM pa)),
fo AS (
  SELECT doc_id, 0::BIGINT AS i, ''::VARCHAR AS a, []::VARCHAR[] AS f, any_value(total) AS total FROM pa GROUP BY doc_id
  UNION ALL
  SELECT fo.doc_id, fo.i + 1,
    CASE WHEN gg.g IS NOT NULL THEN '' WHEN fo.a = '' THEN pa.par WHEN length(fo.a) + length(pa.par) + 2 <= 1200 THEN fo.a || chr(10) || chr(10) || pa.par
      WHEN length(fo.a) >= 300 THEN {_TAIL.format('fo.a')} || chr(10) || chr(10) || pa.par ELSE fo.a || chr(10) || chr(10) || pa.par END,
    CASE WHEN gg.g IS NOT NULL THEN list_concat(CASE WHEN fo.a = '' THEN fo.f ELSE list_append(fo.f, fo.a) END, list_transform(gg.g, lambda x, k: CASE WHEN k = 1 THEN x ELSE {_TAIL.format('gg.g[k - 1]')} || ' ' || x END))
      WHEN fo.a <> '' AND length(fo.a) + length(pa.par) + 2 > 1200 AND length(fo.a) >= 300 THEN list_append(fo.f, fo.a) ELSE fo.f END, fo.total
  FROM fo JOIN pa ON pa.doc_id = fo.doc_id AND pa.i = fo.i + 1 JOIN gg ON gg.doc_id = pa.doc_id AND gg.i = pa.i),
fim AS (SELECT doc_id, CASE WHEN a = '' THEN f ELSE list_append(f, a) END AS f FROM fo WHERE i = total),
ex AS (SELECT doc_id, unnest(f) AS cru, unnest(generate_series(1, len(f))) AS pos FROM fim),
tr AS (SELECT doc_id, pos, {_STRIP.format('cru')} AS texto, length(cru) AS chars FROM ex),
ct AS (SELECT *, len(list_filter(string_split_regex(texto, '{_WS}+'), lambda w: w <> '')) AS tokens FROM tr)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, texto, tokens, chars FROM ct WHERE length(texto) >= 100 AND tokens > 2""",
    "chunk_filter_stats": rf"SELECT coalesce(lower(trim(tipo)), 'texto') AS tipo, length(texto) >= 100 AND len(list_filter(string_split_regex(texto, '{_WS}+'), lambda w: w <> '')) > 2 AS denso, count(*) AS chunks FROM chunks WHERE texto IS NOT NULL GROUP BY 1, 2",
    "fixed_windows": "SELECT doc_id, n, md5(substring(text, n * 1000 + 1, 1000)) AS resumo FROM (SELECT doc_id, text, unnest(generate_series(0, ((length(text) - 1) // 1000)::INT))::INT AS n FROM documents WHERE length(text) > 0)",
    "slide_prefix": "SELECT id, substring(coalesce(list_reduce(list_prepend('', list_filter(list_transform(string_split(texto, chr(10)), lambda l: trim(l)), lambda l: l <> '')), lambda s, l: CASE WHEN length(s) >= 160 THEN s ELSE trim(s || ' ' || l) END), ''), 1, 160) AS prefixo FROM chunks WHERE texto IS NOT NULL",
    "bm25_idf": _LEX + " SELECT termo, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": _LEX + " SELECT q AS pergunta_id, id AS chunk_id, posto, round(score, 6) AS score FROM rk WHERE posto <= 5",
    "near_dup_greedy": _LEX + f""",
ca AS (SELECT rk.q, list({{'posto': rk.posto, 'id': rk.id, 'doc': c.doc_id, 'pagina': c.pagina, 't': {tokens_sql('c.texto')}, 's': list_distinct({tokens_sql('c.texto')})}} ORDER BY rk.posto) AS c FROM rk JOIN chunks c ON c.id = rk.id WHERE rk.posto <= 60 GROUP BY rk.q),
ke AS (SELECT q, list_reduce(list_transform(c, lambda x: [x]), lambda s, x: CASE WHEN len(list_filter(s, lambda o: o.doc = x[1].doc AND (o.t = x[1].t OR (o.pagina = x[1].pagina AND least(len(o.s), len(x[1].s)) > 0 AND len(list_intersect(o.s, x[1].s)) >= 0.85 * least(len(o.s), len(x[1].s)))))) > 0 THEN s ELSE list_concat(s, x) END) AS k FROM ca)
SELECT q AS pergunta_id, k[n].id AS chunk_id, n AS posto FROM (SELECT q, k, unnest(generate_series(1, least(len(k), 5))) AS n FROM ke)""",
    "context_format": _LEX + """ SELECT rk.q AS pergunta_id, md5(string_agg('[' || posto || '] ' || doc_id || ', pagina ' || pagina || CASE WHEN lower(trim(tipo)) = 'imagem' THEN ' (imagem/figura OCR)' ELSE '' END || ': ' || texto, chr(10) || chr(10) ORDER BY posto)) AS contexto FROM rk JOIN chunks c ON c.id = rk.id WHERE posto <= 3 GROUP BY 1""",
    "recall_at_k": _LEX + _SCORE + " SELECT q AS pergunta_id, round(recall, 6) AS recall, round(mrr, 6) AS mrr FROM nota",
    "retrieval_by_stratum": _LEX + _SCORE + r" SELECT estrato, count(*) AS perguntas, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM (SELECT regexp_replace(lower(estrato), '[\s_]+', '', 'g') AS estrato, recall, mrr FROM nota JOIN qs USING (q)) GROUP BY ROLLUP (estrato)",
    "pool_sweep": _LEX + """, alvo AS (SELECT q, len(list_distinct(docs)) AS n, unnest(list_distinct(docs)) AS doc FROM qs WHERE len(docs) > 0)
SELECT pool, round(sum(achados / n) / (SELECT count(DISTINCT q) FROM alvo), 6) AS recall FROM (SELECT p.pool, a.q, a.n, count(DISTINCT a.doc) AS achados FROM rk JOIN chunks c ON c.id = rk.id JOIN alvo a ON a.q = rk.q AND a.doc = c.doc_id, (SELECT unnest([5, 10, 30, 60]) AS pool) p WHERE rk.posto <= p.pool GROUP BY ALL) GROUP BY pool""",
    "expected_position": _LEX + """ SELECT rk.q AS pergunta_id, min(posto) - 1 AS posicao FROM rk JOIN chunks c ON c.id = rk.id JOIN (SELECT DISTINCT q, unnest(docs) AS doc FROM qs) a ON a.q = rk.q AND a.doc = c.doc_id WHERE posto <= 60 GROUP BY 1""",
    "dense_topk": f"WITH {_DENSE} SELECT consulta, vec_id, posto, round(s, 6) AS cosseno FROM (SELECT a.vec_id AS consulta, b.vec_id, list_cosine_similarity(a.e, b.e) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.vec_id) AS posto FROM v a, v b WHERE a.vec_id % 100 = 0) WHERE posto <= 10",
    "vector_normalize": f"WITH {_DENSE}, n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS m FROM v) SELECT vec_id, round(list_sum(list_transform(e, lambda x: (x / m) * (x / m))), 6) AS norma, round(e[1] / m, 6) AS primeiro FROM n",
    "rrf_fusion": _FUSE + " SELECT item_id, doc_id, posto, round(score, 9) AS score FROM (SELECT q AS item_id, id AS doc_id, s AS score, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, id) AS posto FROM (SELECT q, id, (1.0 * l + 1.5 * r) * CASE WHEN v.label = 0 THEN 1.15 ELSE 1.0 END AS s FROM un JOIN v ON v.vec_id = un.id) WHERE s > 0) WHERE posto <= 10",
    "rrf_grid": _FUSE + """, grid AS (SELECT wl, wd, q, max(round(wl * l + wd * r, 9)) AS melhor FROM un, (SELECT unnest([0.5, 1.0, 1.5])::DOUBLE AS wl) a, (SELECT unnest([0.5, 1.0, 1.25, 1.5, 2.0])::DOUBLE AS wd) b GROUP BY ALL)
SELECT wl AS peso_lexico, wd AS peso_denso, count(*) AS itens, round(avg(melhor), 6) AS media FROM grid GROUP BY 1, 2""",
}
