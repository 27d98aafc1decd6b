"""Sampling to target category proportions.

Quotas go down a two-level category tree (group, then leaf). What a leaf cannot
fill is passed to its siblings (leaves of the same group), and what they cannot
take to its cousins (leaves of the other groups of the plan). Leaves are drawn
by the dense rank of their distinct ids in a seeded permutation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the permutation hash that make a rank bucket: 4096 buckets a leaf, so no leaf is one task.
BUCKET_DIGITS = 3


def category(spelling: Column) -> Column:
    """One key for spellings that differ in case, white space or underscores; null becomes ''."""
    return F.coalesce(F.regexp_replace(F.lower(spelling), r"[\s_]+", ""), F.lit(""))


@dataclass(frozen=True)
class Names:
    """Column names of the two inputs."""

    id: str = "id"
    group: str = "estrato"
    flag: str = "deve_abster"
    plan: str = "plano_id"
    line: str = "linha"
    total: str = "n_total"
    share: str = "proporcao"
    minimum: str = "minimo"


def _population(rows: DataFrame, names: Names) -> DataFrame:
    """Distinct (leaf, id); rows read twice count once, rows without an id not at all."""
    return (
        rows.where(F.col(names.id).isNotNull())
        .select(category(F.col(names.group)).alias("grupo"), F.coalesce(F.col(names.flag), F.lit(False)).alias("marca"), F.col(names.id).alias("chave"))
        .distinct()
    )


def _lines(plans: DataFrame, names: Names) -> DataFrame:
    return plans.select(
        F.col(names.plan).alias("plano_id"),
        F.col(names.line).alias("linha"),
        category(F.col(names.group)).alias("grupo"),
        F.coalesce(F.col(names.flag), F.lit(False)).alias("marca"),
        F.coalesce(F.col(names.total), F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(F.col(names.share), F.lit(0.0)).alias("parte"),
        F.coalesce(F.col(names.minimum), F.lit(0)).cast("bigint").alias("minimo"),
    )


def _spread(amount: Column, room: Column, over) -> Column:
    """``amount`` in whole pieces over the lines of the window, in proportion to ``room`` and never above it."""
    upto = F.sum(room).over(over.orderBy("linha").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum(room).over(over)
    return F.when(whole > 0, F.floor(amount * upto / whole) - F.floor(amount * (upto - room) / whole)).otherwise(F.lit(0)).cast("bigint")


def allocate(rows: DataFrame, plans: DataFrame, names: Names = Names()) -> DataFrame:
    """Quota, capacity and allocation of every plan line.

    ``alvo`` is the larger of the minimum and ``total x share``; ``disponivel``
    the distinct ids of the category; ``cota`` the whole-number quota (minima
    kept, the rest scaled to the plan's total, fractions by largest remainder);
    ``alocado`` what is drawn, of it ``de_irmaos`` and ``de_primos`` taken over
    from siblings and cousins; ``falta`` is alvo minus disponivel where positive,
    ``cumprida`` whether the table can fill the line.

    Nulls: null category is the category '', null flag false, null numbers 0,
    null ids are no rows. Lines of one plan that name the same category share its
    ids in the order of ``linha``. Empty inputs give an empty report or capacity 0.
    """
    capacity = _population(rows, names).groupBy("grupo", "marca").agg(F.count("*").alias("disponivel"))
    lines = _lines(plans, names).join(capacity, ["grupo", "marca"], "left").withColumn("disponivel", F.coalesce("disponivel", F.lit(0)).cast("bigint"))
    plan = Window.partitionBy("plano_id")
    lines = lines.withColumn("alvo", F.greatest(F.col("minimo").cast("double"), F.col("total") * F.col("parte")))
    # Lines held at their minimum; what is left of the total is scaled over the others. By falling minimum per share,
    # a line is held while what those before it leave, shared by it and those after, gives it less than its minimum.
    need = F.when(F.col("parte") > 0, F.col("minimo") / F.col("parte")).when(F.col("minimo") > 0, F.lit(float("inf"))).otherwise(0.0)
    falling = plan.orderBy(F.desc("necessidade"), "linha")
    lines = lines.withColumn("necessidade", need).withColumn("inteiro", F.least(F.lit(1.0), F.sum("parte").over(plan)))
    left = F.col("total") - F.coalesce(F.sum("minimo").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum("parte").over(falling.rowsBetween(0, Window.unboundedFollowing))
    given = F.when(open_ > 0, F.greatest(F.lit(0.0), left * F.col("parte") / open_ * F.col("inteiro"))).otherwise(0.0)
    lines = lines.withColumn("abaixo", F.col("minimo") > given)
    lines = lines.withColumn("presa", F.min("abaixo").over(falling.rowsBetween(Window.unboundedPreceding, 0)))
    rest = F.col("total") - F.sum(F.when(F.col("presa"), F.col("minimo")).otherwise(0)).over(plan)
    free = F.sum(F.when(F.col("presa"), 0.0).otherwise(F.col("parte"))).over(plan)
    lines = lines.withColumn("justa", F.when(F.col("presa"), F.col("minimo").cast("double")).when(free > 0, F.greatest(F.lit(0.0), rest * F.col("parte") / free * F.col("inteiro"))).otherwise(0.0))
    lines = lines.withColumn("justa", F.round(F.greatest(F.col("justa"), F.col("minimo").cast("double")), 6))
    missing = F.round(F.sum("justa").over(plan)).cast("bigint") - F.sum(F.floor("justa")).over(plan)
    place = F.row_number().over(plan.orderBy(F.desc(F.col("justa") - F.floor("justa")), "linha"))
    lines = lines.withColumn("cota", (F.floor("justa") + F.when(place <= missing, 1).otherwise(0)).cast("bigint"))

    same = Window.partitionBy("plano_id", "grupo", "marca").orderBy("linha").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("cota").over(same), F.lit(0))
    lines = lines.withColumn("livre", F.greatest(F.lit(0), F.col("disponivel") - before))
    lines = lines.withColumn("proprio", F.least("cota", "livre"))
    last = F.row_number().over(Window.partitionBy("plano_id", "grupo", "marca").orderBy(F.desc("linha"))) == 1
    lines = lines.withColumn("sobra", F.when(last, F.col("livre") - F.col("proprio")).otherwise(0).cast("bigint")).withColumn("aberto", F.col("cota") - F.col("proprio"))

    family = Window.partitionBy("plano_id", "grupo")
    passed = F.least(F.sum("aberto").over(family), F.sum("sobra").over(family))
    lines = lines.withColumn("passado", passed).withColumn("de_irmaos", _spread(F.col("passado"), F.col("sobra"), family))
    lines = lines.withColumn("sobra", F.col("sobra") - F.col("de_irmaos"))
    still = F.sum("aberto").over(plan) - F.sum("de_irmaos").over(plan)
    lines = lines.withColumn("passado", F.least(still, F.sum("sobra").over(plan))).withColumn("de_primos", _spread(F.col("passado"), F.col("sobra"), plan))
    lines = lines.withColumn("alocado", F.col("proprio") + F.col("de_irmaos") + F.col("de_primos"))
    first = F.coalesce(F.sum("alocado").over(same), F.lit(0))
    return lines.select(
        "plano_id", "linha", "grupo", "marca", "total", F.round("alvo", 6).alias("alvo"), "disponivel", "cota", "de_irmaos", "de_primos", "alocado",
        first.cast("bigint").alias("inicio"),
        F.greatest(F.lit(0.0), F.round(F.col("alvo") - F.col("disponivel"), 6)).alias("falta"),
        (F.col("alvo") <= F.col("disponivel")).alias("cumprida"),
    )


def draw(rows: DataFrame, allocation: DataFrame, seed: int = 42, names: Names = Names()) -> DataFrame:
    """The sampled ids of every plan line, with their rank in the leaf's permutation.

    The dense rank of a leaf is made of the rank inside a hash bucket and the
    number of ids in the buckets before it, so that a leaf holding most rows is
    still ranked by many tasks.
    """
    mixed = F.md5(F.concat_ws("-", F.col("chave").cast("string"), F.lit(str(seed))))
    keyed = _population(rows, names).withColumn("mistura", mixed).withColumn("balde", F.substring("mistura", 1, BUCKET_DIGITS))
    leaf = ["grupo", "marca"]
    sizes = keyed.groupBy(*leaf, "balde").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("antes", F.coalesce(F.sum("n").over(Window.partitionBy(*leaf).orderBy("balde").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.dense_rank().over(Window.partitionBy(*leaf, "balde").orderBy("mistura", "chave"))
    ranked = keyed.withColumn("dentro", inside).join(offsets, [*leaf, "balde"]).select(*leaf, "chave", (F.col("dentro") + F.col("antes")).cast("bigint").alias("posto"))
    taken = allocation.where(F.col("alocado") > 0).select("plano_id", "linha", *leaf, "inicio", "alocado")
    return ranked.join(taken, leaf).where((F.col("posto") > F.col("inicio")) & (F.col("posto") <= F.col("inicio") + F.col("alocado"))).select("plano_id", "linha", F.col("chave").alias(names.id), "grupo", "marca", "posto")
