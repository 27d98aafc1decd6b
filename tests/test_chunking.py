from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lavra.operators import chunking as C


def chunks(spark, text, **kw):
    return spark.createDataFrame([(text,)], "x string").select(C.boundary_chunks(F.col("x"), **kw).alias("y")).first()["y"]


def brute(text, least, longest, overlap):
    import re

    def tail(t):
        t = t.rstrip()
        if len(t) <= overlap:
            return t
        cut = t[-overlap:]
        space = cut.find(" ")
        return (cut[space + 1 :] if 0 <= space < 20 else cut).lstrip()

    done, now = [], ""
    for par in [p.strip() for p in re.split(r"\n\s*\n", text.strip()) if p.strip()]:
        if len(par) > longest:
            done += [now] if now else []
            now, group, groups = "", "", []
            for s in [s.strip() for s in re.split(r"(?<=[.!?])\s+", par) if s.strip()]:
                if group and len(group) + 1 + len(s) > longest:
                    groups.append(group)
                    group = s
                else:
                    group = f"{group} {s}" if group else s
            groups += [group] if group else []
            done += [g if k == 0 else f"{tail(groups[k - 1])} {g}" for k, g in enumerate(groups)]
        elif not now:
            now = par
        elif len(now) + 2 + len(par) <= longest:
            now += "\n\n" + par
        elif len(now) >= least:
            done.append(now)
            now = tail(now) + "\n\n" + par
        else:
            now += "\n\n" + par
    return done + ([now] if now else [])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["um", "dois.", "tres", "quatro!", "cinco,", "x?"]), min_size=1, max_size=30).map(" ".join), max_size=8))
def test_against_brute_force(spark, pars):
    text = "\n\n".join(pars)
    assert chunks(spark, text, least=20, longest=60, overlap=15) == brute(text, 20, 60, 15)


def test_long_sentence_stays_whole(spark):
    assert chunks(spark, "a" * 50 + ". " + "b" * 10, least=5, longest=20, overlap=4)[0] == "a" * 50 + "."


def test_rows(spark):
    pages = spark.createDataFrame([(1, "palavra " * 20 + "\n\n" + "b" * 10), (2, None), (3, ""), (4, "curta demais")], "id int, t string")
    assert [(r.id, r.n) for r in C.chunk_rows(pages, "id", "t").collect()] == [(1, 1)]


def test_windows(spark):
    row = spark.createDataFrame([("abcdefghij",)], "x string").select(C.fixed_windows(F.col("x"), 4).alias("y")).first()["y"]
    assert row == ["abcd", "efgh", "ij"]
