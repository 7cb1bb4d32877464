"""Candidate scoring and clustering with the models Spark has."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 11
#: By name; the columns are features (a vector) and label (0 or 1).
MODELS = {
    "logistic": lambda: LogisticRegression(maxIter=50, regParam=1e-3),
    "boosting": lambda: GBTClassifier(maxIter=20, maxDepth=4, seed=SEED),
    "forest": lambda: RandomForestClassifier(numTrees=50, maxDepth=8, seed=SEED),
}


def scored(train: DataFrame, rows: DataFrame, name: str, features: str, label: str) -> DataFrame:
    """``rows`` with ``score``, the probability of label 1 by the named model fitted on ``train`` (features: array of doubles)."""
    vector = lambda df: df.withColumn("_features", array_to_vector(F.col(features).cast("array<double>")))
    model = MODELS[name]().setFeaturesCol("_features").setLabelCol(label).fit(vector(train))
    out = model.transform(vector(rows))
    return out.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).select(*rows.columns, "score")


def cluster_count(df: DataFrame, features: str, most: int, tolerance: float = 0.02) -> int:
    """The least number of clusters (from two) whose silhouette comes within ``tolerance`` of the best; one for fewer than three rows."""
    rows = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("features")).cache()
    try:
        if rows.limit(3).count() < 3:
            return 1
        seen = {}
        for k in range(2, most + 1):
            parted = BisectingKMeans(k=k, seed=SEED).fit(rows).transform(rows)
            if parted.select("prediction").distinct().count() < k:
                break
            seen[k] = ClusteringEvaluator().evaluate(parted)
        return min((k for k, s in seen.items() if s >= max(seen.values()) - tolerance), default=1)
    finally:
        rows.unpersist()
