"""A temporally split classifier of transactions."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.config import Supervised
from heddle.functions import scans
from heddle.operators.features import feature_names

#: The least fall of the validation loss, as a share, that lets training go on.
TOLERANCE = 0.001
CATEGORICAL = ["payment_format", "pay_ccy", "recv_ccy"]


def temporal_split(df: DataFrame, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Adds split (train, val, test) by position in order of (timestamp, txn_id); equal times may straddle a cut."""
    n = df.count()
    d = scans.positions(df, ["timestamp", "txn_id"], "__at")
    cut1, cut2 = int(n * train), int(n * (train + val))
    return d.withColumn("split", F.when(F.col("__at") < cut1, "train").when(F.col("__at") < cut2, "val").otherwise("test")).drop("__at")


def class_weight(split: DataFrame, cfg: Supervised = Supervised()) -> float:
    """What a positive weighs: (negatives / positives) ** power over the training rows, 1 without negatives."""
    n, pos = split.where("split = 'train'").agg(F.count("*"), F.coalesce(F.sum(F.col("is_laundering").cast("long")), F.lit(0))).first()
    pos = max(pos, 1)
    return float(((n - pos) / pos) ** cfg.pos_weight_power) if n > pos else 1.0


def fit(split: DataFrame, cfg: Supervised = Supervised(), rounds: int = 1500, depth: int = 5, seed: int = 42, weight: float | None = None) -> PipelineModel:
    """Boosted trees on rows of train and val, of `rounds` trees at most: they end when val's loss no longer falls by TOLERANCE of itself."""
    weight = class_weight(split, cfg) if weight is None else weight
    d = split.where("split <> 'test'").withColumns({"label": F.col("is_laundering").cast("double"), "weight": F.when(F.col("is_laundering") == 1, weight).otherwise(1.0), "is_val": F.col("split") == "val"})
    numeric = [c for c in feature_names(split) if c not in [*CATEGORICAL, "split"]]
    stages = [
        StringIndexer(inputCols=CATEGORICAL, outputCols=[f"{c}_ix" for c in CATEGORICAL], handleInvalid="keep", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=[*numeric, *[f"{c}_ix" for c in CATEGORICAL]], outputCol="features"),
        GBTClassifier(
            labelCol="label", weightCol="weight", validationIndicatorCol="is_val", validationTol=TOLERANCE, maxIter=rounds, maxDepth=depth, stepSize=0.1,
            minInstancesPerNode=20, subsamplingRate=0.8, featureSubsetStrategy="0.8", maxBins=64, seed=seed, featuresCol="features",
        ),
    ]
    return Pipeline(stages=stages).fit(d)


def described(model: PipelineModel, split: DataFrame, threshold: float, weight: float) -> dict:
    """What scoring needs beside the model, and where the split was cut: plain values for JSON."""
    first = split.groupBy("split").agg(F.min("timestamp").cast("string").alias("at")).collect()  # three rows
    return {
        "features": model.stages[1].getInputCols(),
        "categories": dict(zip(CATEGORICAL, map(list, model.stages[0].labelsArray), strict=True)),
        "threshold": threshold,
        "threshold_is_margin": True,
        "best_iteration": model.stages[2].getNumTrees,
        "class_weight": weight,
        "boundaries": {r.split: r.at for r in first},
    }


def margins(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(txn_id, margin): the raw score, whose order never saturates."""
    return model.transform(df).select("txn_id", vector_to_array("rawPrediction")[1].alias("margin"))


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    names = model.stages[1].getInputCols()
    values = model.stages[2].featureImportances.toArray()
    return sorted(zip(names, map(float, values), strict=True), key=lambda x: -x[1])


def save(model: PipelineModel, path: str, about: dict | None = None) -> None:
    """The model below path, and beside it what described() tells of it, as one JSON text."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(about or {}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def about(path: str) -> dict:
    """What was saved beside the model."""
    return json.loads(SparkSession.active().read.text(f"{path}/about", wholetext=True).first().value)
