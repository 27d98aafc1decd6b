from lavra.llm.truncation import rates, verdicts

SCHEMA = "tabela string, registro long, fonte string, texto string, pergunta string, corpo string"


def cut(spark, rows):
    df = spark.createDataFrame([(t, i, f, x, p, "z") for t, i, f, x, p in rows], SCHEMA)
    return {(r.tabela, r.registro) for r in verdicts(df).where("cortado").collect()}, verdicts(df)


def test_ends(spark):
    whole = [("t", 100 + k, "web", f"O modelo {k} mede o corpus em cada rodada. A rede guarda os pesos com margem estreita.", None) for k in range(40)]
    rows = [
        ("t", 1, "web", "O modelo mede o corpus em cada", None), ("t", 2, "web", "O modelo mede o corpus em cada rod", None), ("t", 3, "web", "O modelo mede o corpus em cada rodada", None),
        ("t", 4, "web", "A rede guarda os pesos com...", None), ("t", 5, "web", "A rede guarda os pesos com\n\nReferências:\n[1] a.pdf, p. 2", None), ("t", 6, "web", "A rede guarda os pesos com margem estreita [1] [2]\n\nReferências:\n[1] a.pdf", None),
        ("t", 7, "web", "Um código:\nassert f(2) == 3", None), ("t", 8, "web", "- um item\n- outro item", None), ("t", 9, "web", "Busca semântica", None), ("t", 10, None, None, None), ("t", 11, "web", "  ", None), ("t", None, "web", "x y z w v", None),
        ("t", 12, "web", "que arquivo a rede guarda na turma", "Que arquivo a rede guarda na turma?"), ("t", 13, None, "A rede guarda os pesos, que", None), ("u", 1, "web", "A rede guarda,", None), ("t", 1, "web", "O modelo mede o corpus em cada", None),
    ]
    got, df = cut(spark, rows + whole)
    assert got == {("t", 1), ("t", 2), ("t", 4), ("t", 5), ("t", 13), ("u", 1)}
    assert df.where("tabela = 't' AND registro = 1").count() == 1
    assert {r.fonte: r.cortados for r in rates(df).where("tabela = 't'").collect()}[None] == 1


def test_empty(spark):
    assert cut(spark, [])[0] == set()
    assert cut(spark, [("t", 1, "a", "palavra " * 50000 + "fim.", None)])[0] == set()


def test_every_end_is_counted(spark):
    whole = [("t", 100 + k, "web", f"O modelo {k} mede o corpus em 7 por cento dos casos. A rede guarda os pesos com margem estreita.\n- o corpus\n- a rede de pesos\n- a margem", None) for k in range(40)]
    rows = [
        ("t", 1, "web", "A rede guarda os pesos. O modelo mede o corpus em 7", None), ("t", 2, "web", "Veja:\n- o corpus\n- a rede de", None), ("t", 3, "web", "A rede guarda o", None),
        ("t", 4, "web", "Veja:\n- o corpus\n- a margem", None), ("t", 5, "web", "Sim", None), ("t", 6, "web", "O modelo mede o corpus (", None), ("t", 7, None, "O modelo mede o corpus em 7 por cento dos casos", None),
    ]
    assert cut(spark, rows + whole)[0] == {("t", 1), ("t", 2), ("t", 3), ("t", 6)}
