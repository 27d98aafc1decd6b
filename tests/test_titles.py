import random
from collections import defaultdict

from lavra.plans import curation as P


def tables(spark, path):
    rng = random.Random(3)
    vocabulary = ["alfa", "beta", "gama", "delta", "modelo", "rede"]
    chunks = [(k, f"d{rng.randrange(4)}", None if k % 7 == 0 else " ".join(rng.choices(vocabulary, k=rng.randint(1, 3))), None if k == 5 else ", ".join(rng.choices(vocabulary + ["zeta", "eta", "teta"] * 6, k=40))) for k in range(40)]
    chunks += [(100, "d0", "«Zeta»", "a zeta, zeta"), (101, "d0", "***", "nada"), (102, "d9", "ausente", "uma coisa"), (103, "d9", "uma coisa", "outra"), (104, "d9", "outra", "outra coisa")]
    spark.createDataFrame(chunks, "id long, doc_id string, titulo string, texto string").write.parquet(f"{path}/chunks.parquet")
    questions = [(1, "negativa", ["d0", "d1"]), (2, "Negativa", ["d2"]), (3, "outra", ["d3"]), (4, "negativa", []), (5, "negativa", ["d9"])]
    spark.createDataFrame(questions, "id long, estrato string, docs_esperados array<string>").write.parquet(f"{path}/perguntas_v05b.parquet")
    return chunks, questions


def plain(text):
    return "".join(c if c.isalnum() and c.isascii() else " " for c in text.lower()).split()


def count(words, target):
    n = at = 0
    while at + len(target) <= len(words):
        hit = words[at : at + len(target)] == target
        n, at = n + hit, at + (len(target) if hit else 1)
    return n


def test_every_title_is_an_option(spark, tmp_path):
    chunks, questions = tables(spark, tmp_path)
    want = {}
    for q, stratum, docs in questions:
        options = {t.lower() for _, doc, t, _ in chunks if t and doc in docs and plain(t)}
        if stratum.lower() == "negativa" and options:
            n = sorted((sum(count(plain(x), plain(o)) for _, doc, _, x in chunks if x and doc in docs), o) for o in options)
            absent = sum(k == 0 for k, _ in n)
            one = n[0][1] if absent == 1 else None
            rarest = n[0][1] if sum(k == n[0][0] for k, _ in n) < len(n) else None
            want[q] = (one, one if absent else rarest, "ausente unica" if absent == 1 else "ambigua" if absent else "todas presentes", len(n), absent)
    got = {r[0]: tuple(r[1:]) for r in P.negative_rule_all(spark, str(tmp_path)).collect()}
    assert got == want and max(w[3] for w in want.values()) > 3 and want[5][0] == "ausente"


def test_every_title_is_windowed(spark, tmp_path):
    chunks, _ = tables(spark, tmp_path)
    lemmas = lambda text: [w[:-1] if len(w) > 3 and w.endswith("s") else w for w in plain(text) if len(w) > 1]
    titles = defaultdict(set)
    for _, doc, title, _ in chunks:
        if title and len(set(lemmas(title))) > 1:
            titles[doc].add(tuple(sorted(set(lemmas(title)))))
    want = {}
    for doc, sets in titles.items():
        for title in sets:
            texts = [lemmas(x) for _, other, _, x in chunks if x and other == doc]
            some = [x for x in texts if set(title) & set(x)]
            want[doc, " ".join(title)] = (len(some), sum(any(set(title) <= set(x[k : k + 15]) for k in range(len(x))) for x in some))
    got = {(r.doc_id, r.lemas): (r.chunks, r.presentes) for r in P.window_cooccurrence_all(spark, str(tmp_path)).collect()}
    assert got == want and max(len(s) for s in titles.values()) > 1


def test_titles_meet_texts_without_rows_of_pairs(spark, tmp_path):
    from lavra.operators import curation as C

    # One document has most texts, others have no text or no title; parts of any size must give the same.
    rows = [("d0", f"alfa {'x ' * (k % 20)}beta") for k in range(60)] + [("d1", "beta"), ("d3", "alfa"), (None, "alfa beta")]
    texts, titles = spark.createDataFrame(rows, "doc string, t string"), spark.createDataFrame([("d0", "alfa beta"), ("d1", "alfa beta"), ("d2", "alfa beta"), (None, "alfa beta")], "doc string, lemas string")
    for size in (7, 1000):
        found = C.by_document(texts, titles, C.count_windows, "doc string, lemas string, chunks bigint, presentes bigint", rows=size).groupBy("doc").sum("chunks", "presentes")
        assert {tuple(r) for r in found.collect()} == {("d0", 60, 42), ("d1", 1, 0), ("d2", 0, 0), (None, 0, 0)}
    tables(spark, tmp_path)
    plan = P.window_cooccurrence_all(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_runs_are_counted_without_unfolding():
    from lavra.operators.curation import count_runs

    assert count_runs(["zeta  zeta  zeta", "a  zeta  b", "zetas", ""], ["zeta", "zeta  zeta", "a  zeta", "b  zeta"]) == {"n": [4, 1, 1, 0]}
