from lavra.llm.proportions import allocate, draw

ROWS = "id int, estrato string, deve_abster boolean, plano_id string"
PLANS = "plano_id int, linha int, n_total int, estrato string, deve_abster boolean, proporcao double, minimo int, id string"


def rows(spark):
    data = [(k, "rotineira", False, "x") for k in range(50)] + [(k, " Rotineira", None, "x") for k in range(45, 60)]
    data += [(100 + k, "negativa", True, "x") for k in range(4)] + [(200 + k, "NEGATIVA", False, "x") for k in range(30)] + [(None, "negativa", True, "x"), (300, None, None, None)]
    return spark.createDataFrame(data, ROWS)


def test_allocation_passes_to_siblings_then_cousins(spark):
    plans = spark.createDataFrame([(1, 1, 50, "rotineira", False, 0.5, 0, "a"), (1, 2, 50, "negativa", True, 0.4, 0, "a"), (1, 3, 50, "negativa", False, 0.1, 0, "a")], PLANS)
    got = {r.linha: r for r in allocate(rows(spark), plans).collect()}
    assert (got[2].cota, got[2].disponivel, got[2].alocado, got[2].cumprida) == (20, 4, 4, False)
    assert got[3].de_irmaos == 16 and got[3].alocado == 21
    assert sum(r.alocado for r in got.values()) == 50
    # A sibling that is full hands on to the cousins.
    tight = spark.createDataFrame([(1, 1, 60, "rotineira", False, 0.2, 0, "a"), (1, 2, 60, "negativa", True, 0.7, 0, "a"), (1, 3, 60, "negativa", False, 0.1, 0, "a")], PLANS)
    got = {r.linha: r for r in allocate(rows(spark), tight).collect()}
    assert got[3].alocado == 30 and got[1].de_primos == 60 - 12 - 4 - 30


def test_minimum_missing_category_and_nulls(spark):
    plans = spark.createDataFrame([(1, 1, 20, "rotineira", None, 0.95, None, "a"), (1, 2, 20, "negativa", True, 0.05, 3, "a"), (2, 1, 10, "leitura", False, 1.0, 0, "a"), (3, 1, None, None, None, None, None, "a")], PLANS)
    got = {(r.plano_id, r.linha): r for r in allocate(rows(spark), plans).collect()}
    assert got[1, 2].cota == 3 and got[1, 1].cota == 17
    assert got[2, 1].disponivel == 0 and not got[2, 1].cumprida and got[2, 1].falta == 10
    assert got[3, 1].alocado == 0 and got[3, 1].cumprida and got[3, 1].disponivel == 1


def test_draw_is_exact_disjoint_and_repeatable(spark):
    plans = spark.createDataFrame([(1, 1, 40, "rotineira", False, 0.4, 0, "a"), (1, 2, 40, "Rotineira ", False, 0.4, 0, "a"), (1, 3, 40, "negativa", False, 0.2, 0, "a")], PLANS)
    sample = draw(rows(spark), allocate(rows(spark), plans)).collect()
    ids = [r.id for r in sample]
    assert len(ids) == len(set(ids)) == 40
    assert sorted(ids) == sorted(r.id for r in draw(rows(spark), allocate(rows(spark), plans)).collect())


def test_empty(spark):
    assert allocate(spark.createDataFrame([], ROWS), spark.createDataFrame([], PLANS)).count() == 0
    plans = spark.createDataFrame([(1, 1, 5, "a", False, 1.0, 0, "a")], PLANS)
    assert allocate(spark.createDataFrame([], ROWS), plans).first().disponivel == 0
    assert draw(rows(spark), allocate(rows(spark), spark.createDataFrame([], PLANS))).count() == 0
