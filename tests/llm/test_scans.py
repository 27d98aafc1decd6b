from lavra.llm.perceptron import Perceptron
from lavra.llm.scans import JOIN, composed, labels_of, line_key, noise, page_number, proposals, repair, repaired, Settings, train_editor

SCHEMA = "id int, doc_id string, pagina int, texto string, linha string, classe string"
WORDS = "o modelo mede a entonação do corpus enquanto a memória permitir o agente complementa a imagem com margem estreita".split()


def chunks(spark):
    rows = []
    for k in range(60):
        page = k + 1
        body = [" ".join(WORDS[(k + j) % 7 :] + WORDS[: (k + j) % 7]) for j in range(4)]
        text = f"{body[0]}\nCurso PLN - Grafos - Banca ..... {page + 2}\n{body[1]} no{k}vo fim.\n\n{body[2]}\n{body[3]}\n- {page + 2} -"
        rows.append((k, "a.pdf", page, text.replace(f"no{k}vo ", ""), "x", "y"))
    rows[3] = (3, "a.pdf", 4, "O rnodelo mede a ento-\nnação do corpus.\n7312\n\nA irnagem com margem estreita.\n[6]\nVer também a página 9 do relatório.", "x", "y")
    for k, read in ((7, "rnede"), (9, "rnargem"), (11, "cornplementa"), (13, "rnemória")):
        rows[k] = (k, "a.pdf", k + 1, rows[k][3].replace(read.replace("rn", "m"), read), "x", "y")
    return rows + [(100, None, None, None, None, None), (101, "b.pdf", None, "", None, None), (102, None, 5, "   \n \n", None, None)]


def test_page_numbers(spark):
    from pyspark.sql import functions as F

    values = ["12", "[12]", "- 12 -", "Página 12 de 40", "pág. 12", "12 / 40", "0,794", "k = 33", "2.8 Painel", "Ver também a página 47 do relatório."]
    got = [r.n for r in spark.createDataFrame([(v,) for v in values], "v string").select(page_number(F.col("v")).alias("n")).collect()]
    assert got == [12] * 6 + [None] * 4
    key = [r.k for r in spark.createDataFrame([("34 | M@terial de ap0io – turma 2",), ("Material de Apoio – turma 2 ..... 77",)], "v string").select(line_key(F.col("v")).alias("k")).collect()]
    assert key[0] == key[1]


def test_noise(spark):
    df = spark.createDataFrame(chunks(spark), SCHEMA)
    found = repair(df)
    got = {(r.chunk_id, r.ruido, r.trecho) for r in noise(found).collect()}
    assert {(3, "hifen", "entonação"), (3, "pagina", "[6]")} <= got
    assert (3, "caractere", "modelo") in got and (3, "caractere", "imagem") in got
    assert (5, "cabecalho", "Curso PLN - Grafos - Banca ..... 8") in got and (5, "pagina", "- 8 -") in got
    assert not [x for x in got if x[2] in ("7312", "Ver também a página 9 do relatório.")]
    clean = {r.chunk: r.texto_limpo for r in repaired(df, found).collect()}
    assert clean[3].startswith("O modelo mede a entonação do corpus. 7312\n\nA imagem com margem estreita.") and "Curso" not in clean[5]


def test_editor_parts():
    assert labels_of("irnagem", "imagem") == ["=", "r:m", "-", "=", "=", "=", "="]
    assert labels_of("hmita", "limita") == ["r:li", "=", "=", "=", "="]
    assert labels_of("abc", "xyz") is None
    assert composed("e´pocas") == "épocas" and composed("ﬁnal") == "final"
    p = Perceptron(["=", "r:m", "-", "r:-"]).train([(["a"], "="), (["b"], "r:m")])
    assert p.predict(["b"]) == "r:m"
    joined = proposals("ento" + JOIN + "nação", p, Settings())
    assert ("entonação" in dict(joined)) and all(JOIN not in w for w, _ in joined)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert noise(repair(df)).count() == 0
    one = spark.createDataFrame([(1, "a", 1, "palavra " * 30000, "x", "y")], SCHEMA)
    assert noise(repair(one)).count() == 0
