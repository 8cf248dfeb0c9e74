"""Cross-validated classifiers over feature frames, with spark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .stats import class_scores


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight: n / (classes * n of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))  # a row for each class
    whole = Window.partitionBy()
    weights = counts.select(label, (F.sum("_n").over(whole) / (F.count("*").over(whole) * F.col("_n"))).alias("weight"))
    return df.join(weights, label)


LEARNERS = ("logistic", "boosting", "forest")


def _learner(kind: str, seed: int, rounds: int):
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier

    common = {"featuresCol": "x", "labelCol": "y", "weightCol": "weight"}
    if kind == "logistic":
        return LogisticRegression(**common, maxIter=60, regParam=1e-3, family="multinomial")
    if kind == "boosting":
        # gradient boosting over binned features; Spark's has two classes, so there is a model for each class
        return OneVsRest(**common, classifier=GBTClassifier(maxIter=rounds, maxDepth=4, maxBins=64, stepSize=0.1, seed=seed))
    if kind == "forest":
        return RandomForestClassifier(**common, numTrees=40, maxDepth=6, seed=seed)
    raise ValueError(f"learner must be one of {LEARNERS}")


def cross_validate(features: DataFrame, columns: Sequence[str], folds: int, learner: str = "logistic", seed: int = 0, rounds: int = 20) -> DataFrame:
    """(oid, fold, label, predicted): each fold predicted by a model of the others.

    features: oid, fold, label and numeric columns. Columns are standardised, classes balanced by weight. learner: logistic
    (multinomial), boosting (one-against-rest gradient-boosted trees of so many rounds) or forest.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler

    held = stage(features.select("oid", "fold", "label", *columns), "features")
    indexer = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(held)
    ends = [VectorAssembler(inputCols=list(columns), outputCol="v"), StandardScaler(inputCol="v", outputCol="x", withMean=True)], [IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)]
    data = indexer.transform(held)

    def predicted(fold: int) -> DataFrame:
        model = Pipeline(stages=[*ends[0], _learner(learner, seed, rounds), *ends[1]]).fit(balanced_weights(data.where(F.col("fold") != fold)))
        return model.transform(data.where(F.col("fold") == fold)).select("oid", "fold", "label", "predicted")

    return reduce(DataFrame.unionByName, side_by_side(predicted, range(folds)))


#: Models that are fitted at the same time.
AT_ONCE = 4


def side_by_side(run, arguments) -> list:
    """run of each argument, in order, some at a time: fitting is a chain of small jobs that leave a cluster idle."""
    with ThreadPool(AT_ONCE) as pool:
        return pool.map(run, list(arguments))


def compare_blocks(features: DataFrame, blocks: dict[str, Sequence[str]], folds: int, learner: str = "logistic", seed: int = 0) -> DataFrame:
    """(block, fold, balanced_accuracy, macro_f1) of each block of columns on identical folds."""
    scored = [class_scores(cross_validate(features, columns, folds, learner, seed), ["fold"]).withColumn("block", F.lit(name)) for name, columns in blocks.items()]
    return reduce(DataFrame.unionByName, scored).select("block", "fold", "balanced_accuracy", "macro_f1")
