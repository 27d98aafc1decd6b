"""A trained router: character n-grams in TF-IDF, boosted trees. Scores differ from other boosted trees by design."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.text import router_key


def char_grams(text: Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams of every padded word."""
    words = F.transform(F.split(router_key(text), " "), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(n: int) -> Column:
        return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - n + 1)), lambda i: F.substring(w, i, F.lit(n)))))

    return F.flatten(F.array(*[grams(n) for n in range(least, most + 1)]))


def train(rows: DataFrame, text: str, label: Column, sample: int = 2000, rounds: int = 100, features: int = 1000, seed: int = 0) -> PipelineModel:
    """A router from at most ``sample`` labelled texts, chosen by hash; ``label`` is 1.0 for the first class, 0.0 for the other."""
    chosen = rows.where(F.col(text).isNotNull()).select(char_grams(F.col(text)).alias("gramas"), label.alias("label"), F.xxhash64(text).alias("h")).where(F.col("label").isNotNull()).orderBy("h").limit(sample)
    stages = [HashingTF(inputCol="gramas", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features"), GBTClassifier(maxDepth=3, maxIter=rounds, stepSize=0.1, seed=seed)]
    return Pipeline(stages=stages).fit(chosen)


def predict(model: PipelineModel, rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the probability of the first class; null texts have none."""
    scored = model.transform(rows.withColumn("gramas", F.coalesce(char_grams(F.col(text)), F.array().cast("array<string>"))))
    return scored.withColumn("probabilidade", F.when(F.col(text).isNotNull(), vector_to_array("probability")[1])).drop("gramas", "tf", "features", "rawPrediction", "probability", "prediction")
