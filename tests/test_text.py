from pyspark.sql import functions as F

from lavra.functions import quality as Q
from lavra.functions import text as X


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_tokens(spark):
    assert one(spark, "Recuperação, e o RAG-2!", X.tokens) == ["recuperacao", "rag"]
    assert one(spark, "RAG, embeddings!", X.all_tokens) == ["rag", "embeddings"]
    assert one(spark, "O que é um banco de dados?", X.query_tokens) == ["banco", "dados"]
    assert one(spark, "época época", X.tokens) == ["epoca", "epoca"]
    assert one(spark, None, X.tokens) is None
    assert one(spark, "", X.tokens) == []


def test_keys(spark):
    assert one(spark, "Ação Nº 1", X.duplicate_key) == "aon1"
    assert one(spark, "educa- cao­  x", X.scan_key) == "educacaox"
    assert one(spark, "Aula 03 — Redes (2)", X.slug) == "aula_03_redes_2"
    assert one(spark, "copy of notas_2", X.file_slug) == "notas"
    assert one(spark, "(1)", X.file_slug) == "1"


def test_abstention(spark):
    yes = ["NAO_SEI", "NÃO_SEI", "Não sei", "não sei", "Bem, NAO_SEI", "não há informações suficientes", "não tenho informações sobre isso"]
    no = ["O modelo mede o corpus.", "", None, "Sei que não."]
    assert [one(spark, v, X.abstains) for v in yes + no] == [True] * 7 + [False] * 4


def test_citations(spark):
    row = spark.createDataFrame([("texto [3] e [1] e [3] e [9].\n[1] a.pdf", 3)], "t string, n int").select(X.renumbered(F.col("t"), F.col("n")).alias("r")).first()["r"]
    assert row["texto"] == "texto [1] e [2] e [1] e ."
    assert row["marcas"] == [3, 1]
    assert one(spark, "a [2] b [2]", X.citations) == [2, 2]


def test_spoken(spark):
    assert one(spark, "NAO_SEI", X.spoken) == "Não sei responder com base nos materiais do curso."
    assert one(spark, "  **RAG**  é *recuperação* [1] .\n[1] a.pdf, p. 2", X.spoken) == "RAG é recuperação."


def test_options(spark):
    assert one(spark, "Qual destes: hora: GAN, voz ou ab?", X.options) == ["GAN", "voz"]
    assert one(spark, "sem dois pontos", X.options) == []


def test_typos(spark):
    assert one(spark, "olá mundo", X.drop_middle) == "ola undo"
    assert one(spark, "abcd", X.swap_middle) == "abdc"
    assert one(spark, "a", X.swap_middle) == ""


def test_verdict(spark):
    v = one(spark, 'x {rascunho} {"nota": 4, "correta": true, "alucinou": false} {}', X.verdict)
    assert (v["nota"], v["correta"], v["alucinou"]) == (4, True, False)
    assert one(spark, "não é json", X.verdict) is None
    assert one(spark, None, X.verdict) is None


def test_page_cleaner(spark):
    page = "Um texto com palavras normais aqui\nab\n12 34\nfale com a@b.org agora\nveja www.x.org hoje\nProfessor Fulano\n@@@@ ####\na b c d e f"
    assert one(spark, page, Q.clean_page) == "Um texto com palavras normais aqui"
    assert one(spark, "", Q.clean_page) == ""
    assert one(spark, "a b c d", Q.letter_spaced) is True
    assert one(spark, "\n\nTÍTULO DA AULA\ntexto", Q.title) == "TÍTULO DA AULA"
    assert one(spark, "texto\nmais", Q.title) is None
