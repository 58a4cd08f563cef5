"""Two-model ensemble: a random forest and a ReLU network under focal loss, each giving
P(class 1); the combined probability is their mean.

Spark ML builds the trees (``operators.forest`` adds the minimum split); the network's
gradients are summed over stored blocks (``operators.network``).  Both read training
rows that are stored once.  Scoring is narrow.  The fitted state is the scaler (one
(mean, scale) pair per feature), the feature names, the hyper-parameters, the forest
and the network's weights; all are saved together.
"""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigwin import schemas as S
from sigwin.functions.columns import ensemble_mean
from sigwin.operators.counts import RowCounts
from sigwin.operators.features import class_weights, fit_scaler, scale_features
from sigwin.operators.forest import with_min_split
from sigwin.operators.network import Network, Training, fit_network, with_probability
from sigwin.operators.windows import finite_filter
from sigwin.session import stored


@dataclass
class EnsembleParams:
    # Fixed defaults of the forest and the network.
    num_trees: int = 200
    max_depth: int = 10
    min_instances_per_node: int = 2
    min_split: int = 5
    feature_subset: str = "sqrt"
    hidden_layers: list[int] = field(default_factory=lambda: [256, 128])
    max_iter: int = 100
    patience: int = 20
    alpha: float = 1.0
    gamma: float = 2.0
    max_memory_mb: int = 1024
    seed: int = 42
    valid_ratio: float = 0.2


@dataclass
class FittedEnsemble:
    features: list[str]
    scaler: dict[str, tuple[float, float]]
    forest: RandomForestClassificationModel
    network: Network
    params: EnsembleParams
    #: (round, split, n, loss, auc, ap) of the network's training; empty for a loaded state.
    history: list[tuple] = field(default_factory=list)

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.forest.write().overwrite().save(os.path.join(path, "forest"))
        state = {"features": self.features,
                 "scaler": {k: list(v) for k, v in self.scaler.items()},
                 "layers": list(self.network.layers), "params": asdict(self.params)}
        # One row, as large as the network.
        (spark.createDataFrame([(json.dumps(state), self.network.weights.tolist())], "state string, weights array<double>")
         .write.mode("overwrite").parquet(os.path.join(path, "state")))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedEnsemble":
        row = spark.read.parquet(os.path.join(path, "state")).first()
        if row is None:
            raise FileNotFoundError(f"no fitted state under {path}")
        state = json.loads(row["state"])
        return FittedEnsemble(
            features=state["features"],
            scaler={k: (float(v[0]), float(v[1])) for k, v in state["scaler"].items()},
            forest=RandomForestClassificationModel.load(os.path.join(path, "forest")),
            network=Network(tuple(state["layers"]), np.array(row["weights"])),
            params=EnsembleParams(**state["params"]))


def _feature_array(features: list[str]):
    return F.array(*[F.col(S.q(c)) for c in features])


def _fit_forest(rows: DataFrame, p: EnsembleParams) -> RandomForestClassificationModel:
    vectors = rows.where("NOT valid").select(array_to_vector("x").alias("features"), F.col("label").cast("double"), "weight")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", numTrees=p.num_trees, maxDepth=p.max_depth,
        minInstancesPerNode=p.min_instances_per_node, featureSubsetStrategy=p.feature_subset,
        seed=p.seed, maxMemoryInMB=p.max_memory_mb, cacheNodeIds=True,
        predictionCol="rf_pred", probabilityCol="rf_prob", rawPredictionCol="rf_raw")
    return forest.fit(vectors)


def _fit_network(rows: DataFrame, n_features: int, p: EnsembleParams) -> Training:
    return fit_network(rows, (n_features, *p.hidden_layers, 2), p.alpha, p.gamma, p.max_iter, p.patience, p.seed)


def fit_ensemble(windows: DataFrame, features: list[str] | None = None,
                 params: EnsembleParams | None = None) -> FittedEnsemble:
    """Finite filter -> scaler (population std) -> balanced class weights for the forest ->
    forest + network, on a labelled window table.

    With a column ``split`` only its ``train`` rows are fitted on; the others give the
    network's validation metrics and its stopping.
    """
    features = features or S.FEATURES
    params = params or EnsembleParams()
    valid = (F.col("split") != "train") if "split" in windows.columns else F.lit(False)
    clean = finite_filter(windows, features).where(F.col("label").isin(0, 1)).withColumn("valid", valid)
    train = clean.where("NOT valid")
    scaler = fit_scaler(train, features)
    weights = class_weights(train, "label").select(F.col("label").cast("int"), "weight")
    scaled = scale_features(clean, scaler, keep=["label", "valid"])
    # One row a class.  Both learners read these rows many times: they are stored.
    rows = stored(scaled.select(F.col("label").cast("int"), "valid", _feature_array(features).alias("x"))
                  .join(F.broadcast(weights), "label", "left"), "training-rows")
    with ThreadPoolExecutor(max_workers=2) as pool:
        forest, training = pool.submit(_fit_forest, rows, params), pool.submit(_fit_network, rows, len(features), params)
        forest, training = forest.result(), training.result()
    forest = with_min_split(windows.sparkSession, forest, params.min_split)
    return FittedEnsemble(features, scaler, forest, training.network, params, training.history)


def scaled_arrays(windows: DataFrame, fitted: FittedEnsemble, keep: list[str], rows: RowCounts | None = None) -> DataFrame:
    """``keep`` and the scaled features as array ``x``, for every finite window."""
    clean = finite_filter(windows, fitted.features, rows)
    return scale_features(clean, fitted.scaler, keep=keep).select(*keep, _feature_array(fitted.features).alias("x"))


def predict(windows: DataFrame, fitted: FittedEnsemble, keep=("contig", "position"),
            rows: RowCounts | None = None) -> DataFrame:
    """Prediction table: keys, NeuralNetwork_Prob, RandomForest_Prob, Combined_Prob.
    Windows with a non-finite feature are dropped first (counted as ``not_finite`` in ``rows``)."""
    keep = list(keep)
    arrays = scaled_arrays(windows, fitted, keep, rows)
    scored = fitted.forest.transform(arrays.withColumn("features", array_to_vector("x")))
    # A model fitted on class 0 alone has no second probability: it is 0.
    forest = F.coalesce(F.get(vector_to_array("rf_prob"), F.lit(1)), F.lit(0.0))
    both = with_probability(scored.select(*keep, forest.alias("RandomForest_Prob"), "x"), fitted.network, "x",
                            "NeuralNetwork_Prob")
    return both.select(*keep, "NeuralNetwork_Prob", "RandomForest_Prob",
                       ensemble_mean("NeuralNetwork_Prob", "RandomForest_Prob").alias("Combined_Prob"))


HISTORY = "round int, split string, n long, loss double, auc double, ap double"


def training_history(spark: SparkSession, fitted: FittedEnsemble) -> DataFrame:
    """``HISTORY``: two rows for each accepted round of a network just fitted (no more than twice ``max_iter``)."""
    return spark.createDataFrame([tuple(h) for h in fitted.history], HISTORY)
