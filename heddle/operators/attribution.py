"""Shapley values of boosted trees' margins, by paths to leaves."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.arrays import matrix
from heddle.session import shipped

#: A leaf: its weighted value, and for each feature on its path (index, tests, share of training rows that stay).
Leaf = tuple[float, list[tuple[int, list, float]]]


def leaves(model: PipelineModel) -> list[Leaf]:
    """The leaves of all trees of the pipeline's boosted classifier."""
    gbt = model.stages[-1]
    out: list[Leaf] = []

    def walk(node, weight: float, path: dict[int, tuple[list, float]]) -> None:
        if node.subtreeDepth() == 0:
            out.append((weight * node.prediction(), [(f, tests, share) for f, (tests, share) in path.items()]))
            return
        split = node.split()
        f = split.featureIndex()
        whole = node.impurityStats().count()
        if "Categorical" in split.getClass().getSimpleName():
            kept = sorted(split.leftCategories())
            left, right = ("in", kept), ("out", kept)
        else:
            left, right = ("le", split.threshold()), ("gt", split.threshold())
        for child, test in ((node.leftChild(), left), (node.rightChild(), right)):
            tests, share = path.get(f, ([], 1.0))
            walk(child, weight, {**path, f: ([*tests, test], share * child.impurityStats().count() / whole)})

    for tree, weight in zip(gbt.trees, gbt.treeWeights, strict=True):
        walk(tree._call_java("rootNode"), weight, {})
    return out


def expected(parts: list[Leaf]) -> float:
    """The margin that training rows have on average."""
    return float(sum(v * np.prod([share for _, _, share in path]) for v, path in parts))


def _passes(x: np.ndarray, tests: list) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for kind, at in tests:
        ok &= x <= at if kind == "le" else x > at if kind == "gt" else np.isin(x, at) if kind == "in" else ~np.isin(x, at)
    return ok


def shapley(parts: list[Leaf], x: np.ndarray) -> np.ndarray:
    """(rows, features): each feature's share of a row's margin over the expected one.

    On a leaf's path, a known feature passes its tests or not, an unknown one passes for its share of training
    rows; a feature's value is the mean, over all orders of making features known, of what it changes.
    """
    out = np.zeros(x.shape)
    for value, path in parts:
        m = len(path)
        one = [_passes(x[:, f], tests).astype(float) for f, tests, _ in path]
        zero = [share for _, _, share in path]
        for i, (f, _, _) in enumerate(path):
            # coefficients by how many of the others are known
            poly = np.zeros((m, len(x)))
            poly[0] = 1.0
            for j in range(m):
                if j != i:
                    poly[1:] = poly[1:] * zero[j] + poly[:-1] * one[j]
                    poly[0] *= zero[j]
            weights = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])
            out[:, f] += value * (one[i] - zero[i]) * (weights[:, None] * poly).sum(0)
    return out


def attributions(model: PipelineModel, df: DataFrame, key: str = "txn_id") -> DataFrame:
    """(key, feature, value, shap): a row for each row of df and model input."""
    names = model.stages[-2].getInputCols()
    parts = leaves(model)
    v = PipelineModel(model.stages[:-1]).transform(df).select(key, vector_to_array("features").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1))
            s = shapley(parts, x) if len(x) else x
            n = len(names)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(names * len(x), pa.string()), pa.array(x.ravel()), pa.array(s.ravel())], [key, "feature", "value", "shap"])

    return shipped(v).mapInArrow(run, f"{key} long, feature string, value double, shap double")


def strongest(found: DataFrame, n: int = 10) -> DataFrame:
    """(feature, mean_abs): the features that move margins most, on average."""
    return found.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature").limit(n)
