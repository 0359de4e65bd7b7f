"""Fitted tree ensembles as data: flat arrays of nodes that SQL functions walk, so that a prediction is a column expression."""

from __future__ import annotations

import numpy as np
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tsrisk.session import new_path

NODES = "feature array<int>, threshold array<double>, lower array<int>, upper array<int>, value array<double>, roots array<int>, depth int"


def forest_table(spark: SparkSession, model: GBTRegressionModel) -> DataFrame:
    """One row with the nodes of all trees, tree after tree.

    A row whose `feature` is at most `threshold` goes to the node `lower`, else to `upper`; a leaf leads to itself. `value` is the
    leaf's prediction times the weight of its tree. The nodes come from the model's saved form; there are as many as
    the model itself holds on the driver.
    """
    path = new_path(spark, "forest")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("prediction"),
        F.col("nodeData.leftChild").alias("lower"), F.col("nodeData.rightChild").alias("upper"),
        F.col("nodeData.split.featureIndex").alias("feature"), F.col("nodeData.split.numCategories").alias("categories"),
        F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"),
    )
    nodes = saved.orderBy("tree", "id").toPandas()
    if (nodes["categories"] >= 0).any():
        raise ValueError("only splits of numbers can be walked")
    at = np.arange(len(nodes))
    roots = at[nodes["id"] == 0]
    own = roots[nodes["tree"].to_numpy()]
    leaf = (nodes["lower"] < 0).to_numpy()
    lower, upper = (np.where(leaf, at, own + nodes[c].to_numpy()) for c in ("lower", "upper"))
    weights = np.array(model.treeWeights)[nodes["tree"].to_numpy()]
    row = (
        np.where(leaf, 0, nodes["feature"]).tolist(), np.where(leaf, np.inf, nodes["threshold"]).tolist(), lower.tolist(),
        upper.tolist(), (nodes["prediction"].to_numpy() * weights).tolist(), roots.tolist(), max(t.depth for t in model.trees),
    )
    return spark.createDataFrame([row], NODES)


def bind(value: Column, then) -> Column:
    """`then` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def walk(forest: Column, features: Column) -> Column:
    """Prediction of a forest, a struct of NODES, for an array of features."""

    def step(node: Column, _: Column) -> Column:
        low = features[forest["feature"][node]] <= forest["threshold"][node]
        return F.when(low, forest["lower"][node]).otherwise(forest["upper"][node])

    def leaf(root: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), forest["depth"]), root, step)

    return F.aggregate(forest["roots"], F.lit(0.0), lambda total, root: total + forest["value"][leaf(root)])
