from lavra.llm.pairs import NaiveBayes, Settings, defects

SAMPLES = [("pt", "O modelo mede o corpus com poucos exemplos, porque a rede não guarda os pesos na turma."), ("pt", "Segundo o relatório, a função de custo reduz o ruído em cada rodada de treino."), ("en", "The model measures the corpus with few examples, because the network does not keep the weights."), ("en", "According to the report, the loss function reduces the noise in each round of training.")]
SCHEMA = "id long, pergunta string, resposta string, tipo string, origem string, tabela string, registro long"


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted((r.id, r.defeito) for r in defects(df, NaiveBayes(SAMPLES, Settings())).collect())


def test_defects(spark):
    q = "Que arquivo o modelo grava ao terminar na turma Rapranade?"
    fine = [(100 + k, q, f"O modelo mede o corpus número {k} em cada rodada.", "ancorado", "web") for k in range(30)]
    rows = [
        (1, q, None, "ancorado", "web"), (2, q, " ​ ", "ancorado", "web"), (3, q, "N/A", "ancorado", "web"), (4, q, "(sem resposta)", None, "web"),
        (5, q, "Bom, não sei.", "ancorado", "web"), (6, q, "Não sei.", "abstencao", "web"), (7, q, "Não há informações de que o modelo mede. O material diz que a rede guarda.", "ancorado", "web"),
        (8, q, "A pergunta é: " + q, "ancorado", "web"), (9, q, q + " O arquivo de pesos.", "ancorado", "web"),
        (10, q, "The network does not keep the weights because the loss function measures the noise.", "ancorado", "web"), (11, q, "Few-shot prompting", "ancorado", "web"),
        (12, q, "O modelo mede o corpus em ca", "ancorado", "web"), (13, q, "O modelo mede o corpus em cada...", "ancorado", "web"), (14, q, "O modelo mede o corpus em cada rodada", "ancorado", "web"),
        (15, None, "Um texto sem pergunta nenhuma ao lado.", "ancorado", None), (16, q, "- um\n- dois", "ancorado", "web"), (None, q, None, "ancorado", "web"),
    ]
    got = found(spark, rows + fine)
    assert got == [(1, "vazia"), (2, "vazia"), (3, "vazia"), (4, "vazia"), (5, "recusa"), (8, "copia"), (10, "idioma"), (12, "truncada"), (13, "truncada")]


def test_empty_and_repeated(spark):
    assert found(spark, []) == []
    q = "Que papel o agente cumpre?"
    assert found(spark, [(1, q, "", "ancorado", "a"), (1, q, "", "ancorado", "a")]) == [(1, "vazia")]
    assert found(spark, [(1, q * 2000, SAMPLES[0][1] * 2000, "ancorado", "a")]) == []
