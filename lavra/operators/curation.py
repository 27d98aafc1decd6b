"""Duplicates, samples, splits and checks of question sets."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(id: Column, seed: int = 42) -> Column:
    """A seeded order that any engine can repeat."""
    return F.md5(F.concat(id.cast("string"), F.lit(f"-{seed}")))


def exact_classes(rows: DataFrame, id: str, key: Column) -> DataFrame:
    """(id, classe, copias): the least id of the rows with an equal key, and their number. Null keys are classes of their own."""
    keyed = rows.select(F.col(id).alias("id"), F.coalesce(F.md5(key), F.concat(F.lit("null-"), F.col(id).cast("string"))).alias("chave"))
    sizes = keyed.groupBy("chave").agg(F.min("id").alias("classe"), F.count("*").alias("copias"))
    return keyed.join(sizes, "chave").select("id", "classe", "copias")


def set_links(left: DataFrame, right: DataFrame, limit: float = 0.8) -> DataFrame:
    """(id, ligacoes, maior): rows of ``right`` whose word set has a Jaccard similarity above ``limit`` with a row of ``left``.

    Both have id and palavras (distinct words). Two sets that similar share a
    word among the rarest n - ceil(limit n) + 1 of either, so that only those are
    joined on; equal sets of one side are one set until the end.
    """
    def distinct_sets(rows: DataFrame) -> DataFrame:
        return rows.where(F.size("palavras") > 0).select("id", F.array_sort("palavras").alias("conjunto")).withColumn("chave", F.md5(F.array_join("conjunto", " ")))

    a, b = distinct_sets(left), distinct_sets(right)
    both = a.select("chave", "conjunto").unionByName(b.select("chave", "conjunto")).dropDuplicates(["chave"])
    df = both.select(F.explode("conjunto").alias("palavra")).groupBy("palavra").agg(F.count("*").alias("df"))
    ranked = both.select("chave", F.explode("conjunto").alias("palavra")).join(df, "palavra").groupBy("chave").agg(F.array_sort(F.collect_list(F.struct("df", "palavra"))).alias("p"))
    keep = F.size("p") - F.ceil(F.size("p") * limit - 1e-9) + 1
    front = ranked.select("chave", F.col("p.palavra").alias("conjunto"), F.slice(F.col("p.palavra"), F.lit(1), keep.cast("int")).alias("frente"))
    ka, kb = a.select("chave").distinct(), b.select("chave").distinct()
    fa = front.join(ka, "chave").select(F.col("chave").alias("ca"), F.col("conjunto").alias("sa"), F.explode("frente").alias("palavra"))
    fb = front.join(kb, "chave").select(F.col("chave").alias("cb"), F.col("conjunto").alias("sb"), F.explode("frente").alias("palavra"))
    share = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    near = (F.size("sa") * limit <= F.size("sb")) & (F.size("sb") * limit <= F.size("sa"))
    linked = fa.join(fb, "palavra").where(near).select("ca", "cb", share.alias("jaccard")).where(F.col("jaccard") > limit).distinct()
    weight = b.groupBy(F.col("chave").alias("cb")).agg(F.count("*").alias("n"))
    per = linked.join(weight, "cb").groupBy("ca").agg(F.sum("n").alias("ligacoes"), F.max("jaccard").alias("maior"))
    return a.select("id", F.col("chave").alias("ca")).join(per, "ca").select("id", "ligacoes", "maior")


def stratified(rows: DataFrame, id: str, stratum: Column, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows of every stratum in seeded order; WindowGroupLimit keeps the first of each partition before the shuffle."""
    order = Window.partitionBy("estrato_").orderBy(order_key(F.col(id), seed), id)
    return rows.withColumn("estrato_", stratum).withColumn("posto_", F.row_number().over(order)).where(F.col("posto_") <= size)


def split(id: Column, held_out: float, seed: int = 42) -> Column:
    """``teste`` for about ``held_out`` of the ids, else ``treino``; the same id always falls on the same side."""
    bucket = F.conv(F.substring(order_key(id, seed), 1, 6), 16, 10).cast("long")
    return F.when(bucket < math.floor(held_out * 16**6), "teste").otherwise("treino")


def by_document(texts: DataFrame, wanted: DataFrame, count: Callable[[list[str], list[str]], dict[str, list[int]]], schema: str, rows: int = 50_000) -> DataFrame:
    """``count`` of the texts (doc, t) and of what is wanted in them (doc, and one text column), document by document.

    A document's texts are spread over one part for every ``rows`` texts in all, and
    what is wanted of it goes to each part, so the results are to be added up.
    Texts are moved once; pairs of text and wanted are never rows. A null document
    holds no texts.
    """
    parts = max(1, math.ceil(texts.count() / rows))
    name = wanted.columns[1]
    left = texts.where("doc IS NOT NULL").withColumn("parte", F.pmod(F.xxhash64("t"), F.lit(parts)).cast("int"))
    right = wanted.withColumn("parte", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        counts = count(held["t"].tolist(), asked[name].tolist())
        return pd.DataFrame({"doc": asked["doc"], name: asked[name], **counts})

    return left.groupBy("doc", "parte").cogroup(right.groupBy("doc", "parte")).applyInPandas(run, schema)


def count_runs(texts: list[str], wanted: list[str]) -> dict[str, list[int]]:
    """How often each run of words stands in the texts; words are two spaces apart."""
    n, starting = [0] * len(wanted), defaultdict(list)
    for place, run in enumerate(wanted):
        starting[run.split(" ", 1)[0]].append((place, f" {run} "))
    for text in texts:
        # Only runs whose first word the text holds are sought in it.
        for word in starting.keys() & set(text.split()):
            for place, run in starting[word]:
                n[place] += f" {text} ".count(run)
    return {"n": n}


def count_windows(texts: list[str], wanted: list[str], width: int = 14) -> dict[str, list[int]]:
    """For every group of distinct words: the texts that hold any of them, and those that hold all within ``width`` words."""
    groups, holding = [x.split(" ") for x in wanted], defaultdict(list)
    for place, group in enumerate(groups):
        for word in group:
            holding[word].append(place)
    some, whole = [0] * len(groups), [0] * len(groups)
    for text in texts:
        at, found = defaultdict(list), defaultdict(int)
        for place, word in enumerate(text.split(" ")):
            if word in holding:
                at[word].append(place)
        for word in at:
            for group in holding[word]:
                found[group] += 1
        for group, words in found.items():
            some[group] += 1
            whole[group] += words == len(groups[group]) and _within([at[w] for w in groups[group]], width)
    return {"chunks": some, "presentes": whole}


def _within(places: list[list[int]], width: int) -> bool:
    """Whether some place has one of every list at it or within ``width`` after it."""
    return any(all((k := bisect_left(other, first)) < len(other) and other[k] <= first + width for other in places) for each in places for first in each)
