"""Rules of the evaluation, against literals of the rules themselves."""

from pyspark.sql import functions as F

from lavra.functions import quality as Q
from lavra.functions import text as X
from lavra.operators import evaluation as E
from lavra.operators.routing import answer_route, client_key, hard, input_status, limit_group


def column(spark, values, expression, kind="string"):
    return [r.c for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(expression(F.col("v")).alias("c")).collect()]


def test_lines(spark):
    assert column(spark, ["10%", "3 – 4", "12/05", "1", "---", ";;", "4 x", "", None], Q.is_numeric) == [True, True, True, True, False, False, False, False, None]
    assert column(spark, ["ver a.b+c@d-e.org", "a@b", "www.x.y", "HTTP://z", "awww."], lambda c: Q.has_email(c) | Q.has_url(c)) == [True, False, True, True, False]
    assert column(spark, ["PÁGINA 3", "Prof. Ana", "slide", "x" * 61 + " slide", "profissional"], Q.is_short_header) == [True, True, True, False, False]


def test_speech_and_names(spark):
    said = column(spark, ["NÃO_SEI.", "Veja [1] www.a.b, e *b* !\n[1] a.pdf, p. 2", "não sei ao certo", "escreva a x@y.com."], X.spoken)
    assert said == [X.NO_ANSWER, "Veja e b!", "não sei ao certo", "escreva a."]
    assert column(spark, ["[1] a.pdf", " [2]  b-c.pdf, p. 3", "[1] a.pdfx", "[1] texto a.pdf", "[x] a.pdf", "[1]"], X.is_reference_line) == [True, True, False, False, False, False]
    assert column(spark, ["NLP 2.1 - Aula 05 Árvores (2)", "Cópia de Redes_3", "tdp – grafos", "aula", ""], X.file_slug) == ["05_arvores", "redes", "grafos", "aula", ""]


def test_objects(spark):
    text = 'a {rascunho} {"nota": 4, "correta": true, "alucinou": false, "justificativa": "tem } e {", "x": {"y": 1}} fim {"nota": 1}'
    found = column(spark, [text, "nada", None, '{"nota": 1}'], X.verdict)
    assert (found[0].nota, found[0].correta, found[0].justificativa) == (4, True, "tem } e {") and found[1:] == [None, None, None]
    lists = column(spark, ['x ```json\n[{"q": "a", "a": "b",},]\n``` y', "sem lista", None], lambda c: X.first_array(c, "q:string,a:string"))
    assert [tuple(r) for r in lists[0]] == [("a", "b")] and lists[1:] == [None, None]


def test_routes(spark):
    assert column(spark, ["é complexa", "COMPLEXA", "simples", "", None], answer_route) == ["COMPLEXA", "COMPLEXA", "SIMPLES", "SIMPLES", "SIMPLES"]
    assert column(spark, ["x", " ", None], lambda c: hard(F.lit("COMPLEXA"), c)) == ["COMPLEXA", "SIMPLES", "SIMPLES"]
    assert [tuple(g) for g in column(spark, ["/chat/x", "/saude"], limit_group)] == [("chat", 4, 60.0), ("geral", 300, 60.0)]
    assert column(spark, [" 1.2.3.4 , 5", "", None], lambda c: client_key(c, F.lit("p"))) == ["1.2.3.4", "p", "p"]
    rows = spark.createDataFrame([("a.ogg", "x", None), ("a.OGG", "", None), ("a.doc", "x", None), ("a.png", "x", "t"), (None, None, " "), (None, None, "t"), ("a.b.png", "x", None)], "f string, c string, t string")
    assert [tuple(r.s) for r in rows.select(input_status(F.col("f"), F.col("c"), F.col("t")).alias("s")).collect()] == [(200, "audio"), (400, None), (415, None), (400, None), (400, None), (200, "texto"), (200, "imagem")]


def test_scores(spark):
    rows = spark.createDataFrame([({"1": 0.5, "5": 0.5}, None), ({}, 0.9), (None, None)], "p map<string,double>, a double")
    got = [tuple(r) for r in rows.select(E.expected_score(F.col("p")), E.confidence(F.col("a"), F.col("p"))).collect()]
    assert got == [(3.0, 0.5), (None, 0.9), (None, 0.5)]
    assert column(spark, ["rede neural", "rede", "", None], lambda c: E.held_share(F.lit("a rede neural"), c)) == [1.0, 0.5, 0.0, None]
