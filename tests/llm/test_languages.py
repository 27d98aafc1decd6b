from lavra.llm.languages import Centroids, Settings, fit, identify, label_code, mislabelled, sentences

PT = ["O modelo mede o corpus com poucos exemplos, porque a rede não guarda os pesos.", "Segundo o relatório, a função de custo reduz o ruído em cada rodada.", "A turma percebeu que o agente não evita o sobreajuste na maior parte dos testes.", "No experimento, a média móvel simplifica a transcrição quando o limiar é baixo."]
EN = ["The model measures the corpus with few examples, because the network does not keep the weights.", "According to the report, the loss function reduces the noise in each round.", "The class noticed that the agent does not avoid overfitting in most of the tests.", "In the experiment, the moving average simplifies the transcript when the threshold is low."]
MODEL = Centroids([("pt", t) for t in PT] + [("en", t) for t in EN], Settings(centroids=2))
SCHEMA = "doc_id long, text string, lang string, doc string, idioma string"


def segments(spark, rows):
    df = spark.createDataFrame([(i, t, lang, "x", "y") for i, t, lang in rows], SCHEMA)
    return identify(df, MODEL)


def test_documents(spark):
    rows = [
        (1, PT[0] + " " + PT[1], "pt-BR"), (2, EN[0], "pt"), (3, PT[0] + "\n\n" + EN[0] + " " + EN[1] + "\nassert f(3) == 4\n" + PT[2], "pt"), (4, "x = conv2d(x, 3, k=7)\n12;4;7;12", None), (5, "0,12 0,4", "und"), (6, PT[3], " POR "), (7, None, "pt"), (8, " \n", "pt"), (9, PT[0], None), (10, PT[0], "und"), (11, (PT[0] + " ") * 3000, "pt"),
    ]
    all_ = segments(spark, rows)
    got = sorted((r.doc, r.segmento, r.idioma) for r in mislabelled(all_).collect())
    assert got == [(2, 0, "en"), (3, 0, "pt"), (3, 1, "en"), (3, 2, "pt"), (4, 0, "und"), (9, 0, "pt"), (10, 0, "pt")]
    assert all(0.5 <= r.confianca <= 1 for r in all_.collect())


def test_parts(spark):
    assert sentences("Um dois.\ntres quatro\ncinco. Seis!") == ["Um dois.", "tres quatro cinco.", "Seis!"]
    from pyspark.sql import functions as F

    values = ["pt_br", "POR", " en-GB ", "", None, "und", "fre"]
    assert [r.c for r in spark.createDataFrame([(v,) for v in values], "v string").select(label_code(F.col("v")).alias("c")).collect()] == ["pt", "pt", "en", None, None, "und", "fr"]


def test_empty(spark):
    assert segments(spark, []).count() == 0


def test_copies_teach_nothing(spark):
    rows = [(k, f"{a} {b}", lang, "x", "y") for k, (lang, a, b) in enumerate([("pt", PT[0], PT[1]), ("pt", PT[2], PT[3]), ("en", EN[0], EN[1]), ("en", EN[2], EN[3]), (None, PT[1], EN[2])])]
    once = spark.createDataFrame(rows, SCHEMA)
    tenfold = once.unionByName(spark.createDataFrame([(100 * n + i, *rest) for n in range(1, 10) for i, *rest in rows], SCHEMA))
    samples = spark.createDataFrame([("pt", t) for t in PT] + [("en", t) for t in EN], "idioma string, texto string")
    settings = Settings(centroids=2, sample=3)
    first, second = (fit(samples, df, settings=settings) for df in (once, tenfold))
    assert (first.matrix == second.matrix).all() and first.margin == second.margin
    named = lambda model: sorted(tuple(r) for r in identify(once, model).collect())
    assert named(first) == named(second)


def test_short_sentences_together(spark):
    short = "Não guarda.\nO ruído.\nA rede.\nOs pesos.\nNa turma."
    assert [r.idioma for r in segments(spark, [(1, short, None)]).collect()] == ["pt"]
    assert [r.idioma for r in segments(spark, [(1, "x = 3;\ny = 4;", None)]).collect()] == ["und"]


def test_shared_topics_tell_nothing():
    topic = [("pt", f"O índice invertido {x} o corpus, porque a rede não guarda os pesos.") for x in ("mede", "reduz")] + [("es", f"El índice invertido {x} el corpus en la red.") for x in ("mide", "reduce", "filtra", "ordena", "traza")]
    model = Centroids(topic + [("pt", t) for t in PT], Settings(centroids=3))
    found, *_ = model.score(["Segundo a turma, o índice invertido não reduz o ruído."])
    assert model.languages[found[0]] == "pt"
