from collections import deque

import pytest
from pyspark.sql import functions as F

from lavra.operators import curation as C
from lavra.operators import metrics as M
from lavra.operators import routing as G
from lavra.streaming.limiter import admit, limit, limit_stream


def test_wer(spark):
    rows = [("o que e rag", "o que e rag"), ("a b c", "a x c"), ("", "a"), (None, "a")]
    got = [r.w for r in spark.createDataFrame(rows, "a string, b string").select(M.wer(F.filter(F.split("a", " "), lambda w: w != ""), F.split("b", " ")).alias("w")).collect()]
    assert got[0] == 0.0 and got[1] == pytest.approx(1 / 3) and got[2] == 1.0 and got[3] is None


def test_last_bin(spark):
    rows = spark.createDataFrame([("A", "A", 1.0), ("A", "B", 0.95)], "esperado string, previsto string, confianca double")
    assert [(r.faixa, r.n) for r in M.calibration(rows).collect()] == [(9, 2)]


def test_reject_zone(spark):
    got = spark.createDataFrame([(0.55,), (0.5,), (0.9,), (0.1,)], "p double").select(G.decided(F.col("p"), 0.6).alias("a"), G.decided(F.col("p"), 0.0).alias("b")).collect()
    assert [r.a for r in got] == ["INDETERMINADO", "INDETERMINADO", "SIMPLES", "COMPLEXA"]
    assert [r.b for r in got] == ["SIMPLES", "SIMPLES", "SIMPLES", "COMPLEXA"]


def test_fallback(spark):
    rows = spark.createDataFrame([("ok", "x"), (" ", "y"), (None, ""), ("", None)], "a string, b string").select(G.with_fallback(F.col("a"), F.col("b")).alias("r")).collect()
    assert [(r.r["resposta"], r.r["fallback"], len(r.r["erros"])) for r in rows] == [("ok", False, 0), ("y", True, 1), ("NAO_SEI", True, 2), ("NAO_SEI", True, 2)]


def test_client_key(spark):
    rows = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "9"), ("", "9"), (None, "9")], "f string, p string").select(G.client_key(F.col("f"), F.col("p")).alias("k")).collect()
    assert [r.k for r in rows] == ["1.1.1.1", "9", "9"]


def test_limiter_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b", None]), float(rng.randint(0, 600))) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, t double").withColumn("t", F.timestamp_seconds("t"))
    got = {r.id: r.admitida for r in limit(df, id="id", key="k", time="t", quantity=2, period=20.0).collect()}
    logs, want = {}, {}
    for i, k, t in sorted((r for r in rows if r[1]), key=lambda r: (r[2], r[0])):
        want[i] = admit(logs.setdefault(k, deque()), t, 2, 20.0)[0]
    assert got == want


def test_limiter_counts_admitted_only():
    log = deque()
    assert [admit(log, t, 2, 60)[0] for t in (0, 1, 2, 3, 60.5, 61.5, 61.6)] == [True, True, False, False, True, True, False]


def test_limiter_stream(spark, tmp_path):
    rows = spark.createDataFrame([(k, "a", float(k)) for k in range(5)] + [(9, "b", 0.0)], "id long, k string, t double").withColumn("t", F.timestamp_seconds("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = limit_stream(stream, id="id", key="k", time="t", quantity=4, period=60.0).writeStream.format("memory").queryName("limite").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert {(r.id, r.admitida) for r in spark.table("limite").collect()} == {(0, True), (1, True), (2, True), (3, True), (4, False), (9, True)}


def test_set_links_against_brute_force(spark):
    import random

    rng = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    left = [(k, rng.sample(words, rng.randint(1, 8))) for k in range(60)]
    right = [(k, rng.sample(words, rng.randint(1, 8))) for k in range(60)] + [(99, [])]
    got = {r.id: (r.ligacoes, round(r.maior, 6)) for r in C.set_links(spark.createDataFrame(left, "id long, palavras array<string>"), spark.createDataFrame(right, "id long, palavras array<string>"), 0.7).collect()}
    want = {}
    for i, a in left:
        js = [len(set(a) & set(b)) / len(set(a) | set(b)) for _, b in right if b]
        hits = [j for j in js if j > 0.7]
        if hits:
            want[i] = (len(hits), round(max(hits), 6))
    assert got == want


def test_exact_classes(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None)], "id long, t string")
    assert {(r.id, r.classe, r.copias) for r in C.exact_classes(df, "id", F.col("t")).collect()} == {(1, 1, 2), (3, 1, 2), (2, 2, 1), (4, 4, 1)}
