from pyspark.sql import functions as F

from lavra.operators import router


def test_router_learns(spark):
    rows = [(f"qual o valor de x{k}?", "S") for k in range(40)] + [(f"compare e explique a diferença entre a{k} e b{k}?", "C") for k in range(40)]
    df = spark.createDataFrame(rows, "pergunta string, rotulo string")
    model = router.train(df, "pergunta", F.when(F.col("rotulo") == "S", 1.0).otherwise(0.0), rounds=5)
    new = spark.createDataFrame([("qual o valor de y?",), ("explique a diferença entre c e d?",), (None,)], "pergunta string")
    got = [r.probabilidade for r in router.predict(model, new, "pergunta").collect()]
    assert got[0] > 0.6 and got[1] < 0.4 and got[2] is None


def test_grams(spark):
    got = spark.createDataFrame([("Olá",)], "x string").select(router.char_grams(F.col("x"), 3, 4).alias("g")).first()["g"]
    assert got == [" ol", "ola", "la ", " ola", "ola "]


def test_all_rounds_are_fitted(spark):
    df = spark.createDataFrame([("qual o valor?", 1.0), ("compare e explique", 0.0)] * 3, "pergunta string, r double")
    assert router.train(df, "pergunta", F.col("r"), features=20).stages[-1].getNumTrees == 100
