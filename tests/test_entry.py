import glob
import os

import pytest

import __spark_entry__ as entry


def test_entry(spark, data):
    df = entry.entry(spark)
    assert df.columns == ["pergunta_id", "chunk_id", "posto", "score"] and df.count() > 0


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


#: Tables this small are done sooner without compiled stages and in one piece.
QUICK = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false"}


@pytest.fixture
def quick(spark):
    usual = {k: spark.conf.get(k) for k in QUICK}
    for k, v in QUICK.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in usual.items():
        spark.conf.set(k, v)


def parts(row) -> tuple[tuple, list[float]]:
    """A row's exact values as texts, and its floating ones."""
    exact, floats = [], []
    for value in row:
        if isinstance(value, float):
            floats.append(value)
        elif isinstance(value, (list, tuple)):
            inner = parts(value)
            exact.append(str(inner[0]))
            floats += inner[1]
        else:
            exact.append(str(value))
    return tuple(exact), floats


#: Modules whose queries are compared with their SQL here; those that rank the whole corpus are only run.
COMPARED = ("text", "metrics", "assembly")


def test_core_queries_agree_with_their_sql(quick, data):
    duckdb = pytest.importorskip("duckdb")
    from importlib import import_module

    base, wrong = duckdb.connect(), []
    for path in glob.glob(f"{data}/*.parquet"):
        base.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for module in (import_module(f"lavra.plans.{m}") for m in COMPARED):
        for name, sql in module.ORACLES.items():
            df, theirs = module.QUERIES[name](quick, data), base.sql(sql)
            columns = sorted(df.columns)
            ours = sorted(parts(row) for row in df.select(*columns).collect())
            rows = sorted(parts(row) for row in theirs.select(", ".join(f'"{c}"' for c in columns)).fetchall())
            if columns != sorted(theirs.columns) or [r[0] for r in ours] != [r[0] for r in rows] or any(abs(x - y) > 2e-6 + 1e-4 * abs(y) for a, b in zip(ours, rows) for x, y in zip(a[1], b[1])):
                wrong.append((name, [x for x in zip(ours, rows) if x[0] != x[1]][:2]))
    assert wrong == []


def test_core_queries_run(quick, data):
    from importlib import import_module

    from lavra import plans

    compared = {n for m in COMPARED for n in import_module(f"lavra.plans.{m}").ORACLES}
    # A question set of this size has no row for these two.
    may_be_empty = {"reachable_questions", "fuzzy_vs_golden"}
    for name, query in plans.queries().items():
        if name not in compared:
            df = query(quick, data)
            assert df.columns and (name in may_be_empty or df.count() > 0), name
