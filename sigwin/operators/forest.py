"""A random forest as a table of nodes, with a minimum number of rows to split.

Spark ML grows the trees; its saved form is read as a table, one row a node.  Nodes of
fewer rows than ``min_split`` become leaves and lose their descendants, and the table is
written back, so that Spark ML scores with it.  ``walked_probability`` scores by walking
the table, all rows of an Arrow batch a step at once, and is what the tests and the check
query compare with.  A tree
has at most ``2 ** (depth + 1)`` nodes, whatever the number of training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigwin.session import scratch_path

NODES = ("tree int, node int, n long, feature int, threshold double, left int, right int, "
         "gain double, impurity double, prediction double, stats array<double>")


def node_table(spark: SparkSession, model: RandomForestClassificationModel) -> DataFrame:
    """``NODES``: a leaf has no children (-1) and no feature (-1); ``stats`` are its weighted rows by class."""
    return _saved_nodes(spark, model, scratch_path(spark, "forest"))


def _saved_nodes(spark: SparkSession, model: RandomForestClassificationModel, path: str) -> DataFrame:
    """Save the model and read its nodes."""
    model.write().overwrite().save(path)
    node = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("node"), node["rawCount"].alias("n"),
        node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["gain"].alias("gain"),
        node["impurity"].alias("impurity"), node["prediction"].alias("prediction"), node["impurityStats"].alias("stats"))


def collapsed(nodes: DataFrame, min_split: int) -> DataFrame:
    """The table without the splits of nodes that have fewer than ``min_split`` rows; nodes are renumbered."""
    names = [c.split()[0] for c in NODES.split(", ")]

    def one_tree(table: pa.Table) -> pa.Table:
        rows = {r["node"]: r for r in table.select(names).to_pylist()}
        numbers, out, waiting = {}, [], [0]
        while waiting:  # in the order of the numbers: a node, its left side, its right side
            row = rows[waiting.pop()]
            numbers[row["node"]] = len(out)
            if row["n"] < min_split:
                row |= {"feature": -1, "threshold": None, "left": -1, "right": -1, "gain": -1.0}
            if row["left"] >= 0:
                waiting += [row["right"], row["left"]]
            out.append(row)
        out = [r | {"node": i, **{side: numbers.get(r[side], -1) for side in ("left", "right")}} for i, r in enumerate(out)]
        return pa.Table.from_pylist(out, schema=table.select(names).schema)

    return nodes.groupBy("tree").applyInArrow(one_tree, NODES)


def with_min_split(spark: SparkSession, model: RandomForestClassificationModel, min_split: int
                   ) -> RandomForestClassificationModel:
    """The model in which no node of fewer than ``min_split`` rows is split.

    It is always a loaded one: a model just fitted carries its session, which may not serialize.
    """
    old, path = scratch_path(spark, "forest"), scratch_path(spark, "forest")
    nodes = _saved_nodes(spark, model, old)
    if nodes.where((F.col("left") >= 0) & (F.col("n") < min_split)).isEmpty():
        return RandomForestClassificationModel.load(old)
    split = F.struct(F.col("feature").alias("featureIndex"),
                     F.when(F.col("left") >= 0, F.array("threshold")).otherwise(F.array().cast("array<double>"))
                     .alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    data = collapsed(nodes, min_split).select(F.col("tree").alias("treeID"), F.struct(
        F.col("node").alias("id"), "prediction", "impurity", F.col("stats").alias("impurityStats"),
        F.col("n").alias("rawCount"), "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
        split.alias("split")).alias("nodeData"))
    data.coalesce(1).write.parquet(f"{path}/data")
    spark.read.parquet(f"{old}/treesMetadata").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.read.text(f"{old}/metadata").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestClassificationModel.load(path)


@dataclass(frozen=True)
class TreeArrays:
    """All trees one after the other; ``left`` and ``right`` count from the first node of all, a leaf is its own
    child, ``p`` is the probability of class 1 and ``roots`` are the trees' first nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    p: np.ndarray
    roots: np.ndarray

    def walked(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The mean over the trees of the probability where each row of ``x`` is after ``depth`` steps."""
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(max(depth, 1)):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.p[at]
        return total / len(self.roots)


def tree_arrays(nodes: DataFrame) -> TreeArrays:
    """The node table as arrays: the driver gets the forest, at most ``2 ** (depth + 1)`` short rows a tree."""
    p1 = F.coalesce(F.try_divide(F.get("stats", F.lit(1)), F.aggregate("stats", F.lit(0.0), lambda a, s: a + s)), F.lit(0.0))
    table = nodes.select("tree", "node", "feature", "threshold", "left", "right", p1.alias("p")).toArrow()
    table = table.sort_by([("tree", "ascending"), ("node", "ascending")])
    tree, feature, threshold, left, right, p = (
        table.column(c).to_numpy() for c in ("tree", "feature", "threshold", "left", "right", "p"))
    own, leaf = np.arange(len(tree)), left < 0
    roots = np.flatnonzero(np.diff(tree, prepend=tree[:1] - 1))
    first = np.repeat(roots, np.diff(roots, append=len(tree)))
    return TreeArrays(np.where(leaf, 0, feature), threshold.astype("<f8"), np.where(leaf, own, first + left),
                      np.where(leaf, own, first + right), p, roots)


def walked_probability(df: DataFrame, nodes: DataFrame, x: str, depth: int, name: str) -> DataFrame:
    """``df`` with the probability of class 1: the mean over the trees of the leaf that array ``x`` reaches."""
    at = df.columns.index(x)
    # As large as the forest.
    trees = df.sparkSession.sparkContext.broadcast(tree_arrays(nodes))
    fields = [*df.schema.fields, T.StructField(name, T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype("<f8")
            walked = trees.value.walked(values.reshape(batch.num_rows, -1), depth) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(walked, pa.float64())], [f.name for f in fields])

    return df.mapInArrow(run, T.StructType(fields))
