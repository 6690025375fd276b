"""Learned scorers: trees and logistic models with a hash split, calibration, gates and drivers."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpforge.functions.hashing import bucket
from kelpforge.functions.numeric import logit
from kelpforge.operators.statistics import determinism, fidelity, matrix_values, psi_merge_first, roc_auc


def estimator(algorithm: str, seed: int = 7):
    common = {"featuresCol": "scaled", "labelCol": "label"}
    if algorithm == "gradient_boosting":
        return GBTClassifier(maxIter=20, maxDepth=3, seed=seed, **common)
    if algorithm == "random_forest":
        return RandomForestClassifier(numTrees=200, seed=seed, **common)
    if algorithm == "logistic_regression":
        return LogisticRegression(regParam=0.01, **common)
    raise ValueError(f"unknown algorithm {algorithm}")


def check_training(df: DataFrame, label: str, least: int) -> None:
    found = {int(r[0]): r[1] for r in df.groupBy(F.col(label).cast("int")).count().collect() if r[0] is not None}
    if sum(found.values()) < least or len(found) < 2:
        raise ValueError(f"training needs {least} rows of both classes, got {found}")


def train(df: DataFrame, features: Sequence[str], label: str, algorithm: str = "gradient_boosting", least: int = 40, seed: int = 7) -> PipelineModel:
    check_training(df, label, least)
    rows = df.select(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features), F.col(label).cast("double").alias("label"))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), estimator(algorithm, seed)]).fit(rows)


def score(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with `probability`; missing and null features count as 0."""
    filled = df.select("*", *(F.lit(0.0).alias(f) for f in features if f not in df.columns)).fillna(0.0, list(features))
    out = model.transform(filled)
    return out.select(*df.columns, vector_to_array("probability")[1].alias("probability"))


def calibration_split(df: DataFrame, key: str, share: float = 0.25, salt: str = "calibration") -> tuple[DataFrame, DataFrame]:
    held = bucket(F.col(key).cast("string"), "split", salt) < share
    return df.where(~held), df.where(held)


def fit_platt(scored: DataFrame, probability: str, label: str) -> tuple[float, float]:
    """Slope and intercept over the logit; the identity where one class is missing."""
    rows = scored.select(logit(F.col(probability)).alias("z"), F.col(label).cast("double").alias("label"))
    if rows.select("label").distinct().limit(2).count() < 2:
        return 1.0, 0.0
    model = LogisticRegression(featuresCol="x").fit(VectorAssembler(inputCols=["z"], outputCol="x").transform(rows))
    return float(model.coefficients[0]), float(model.intercept)


def train_ranker(df: DataFrame, features: Sequence[str], label: str, key: str) -> tuple[PipelineModel, tuple[float, float], float]:
    """Model, calibration and held-out AUC: boosted trees on three quarters by hash, Platt's map on the rest."""
    fit_rows, held = calibration_split(df, key)
    model = train(fit_rows, features, label, least=20)
    scored = score(model, held, features)
    return model, fit_platt(scored, "probability", label), float(roc_auc(scored, "probability", label).first()["auc"])


def importance(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    last = model.stages[-1]
    raw = np.abs(last.coefficients.toArray()) if hasattr(last, "coefficients") else last.featureImportances.toArray()
    total = float(raw.sum())
    return {f: float(x / total) if total else 0.0 for f, x in zip(features, raw, strict=True)}


def cohort_means(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    return {k: float(v or 0.0) for k, v in df.agg(*(F.avg(f).alias(f) for f in features)).first().asDict().items()}


def score_trees(nodes: dict[str, np.ndarray], base: float, rate: float, columns: Sequence[Column]) -> Column:
    """Probability of a boosted ensemble given as padded arrays tree x node: feature (-1 at leaves), threshold, left, right, value.

    The ensemble is a constant of the plan, nested arrays that a fold over trees and another over their depth walk, so rows
    are scored in the JVM. Features are compared as 32-bit floats, as the arrays were grown; what isn't a number, and null,
    goes right.
    """
    trees = [
        [{"feature": int(f), "threshold": float(t), "left": int(a), "right": int(b), "value": float(v)} for f, t, a, b, v in zip(*(nodes[c][k] for c in ("feature", "threshold", "left", "right", "value")), strict=True)]
        for k in range(len(nodes["feature"]))
    ]
    held = F.from_json(F.lit(json.dumps(trees)), "array<array<struct<feature:int,threshold:double,left:int,right:int,value:double>>>")
    x = F.array(*(c.cast("float").cast("double") for c in columns))
    steps = F.sequence(F.lit(1), F.lit(max(1, max((_depth(nodes, k) for k in range(len(trees))), default=1))))

    def walked(tree: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            node = F.get(tree, at)
            goes_left = F.get(x, node["feature"]) <= node["threshold"]
            return F.when(node["feature"] < 0, at).when(goes_left, node["left"]).otherwise(node["right"])

        return F.get(tree, F.aggregate(steps, F.lit(0), step))["value"]

    raw = F.aggregate(held, F.lit(float(base)), lambda total, tree: total + walked(tree) * rate)
    return 1 / (1 + F.exp(-raw))


def _depth(nodes: dict[str, np.ndarray], tree: int, at: int = 0) -> int:
    if nodes["feature"][tree][at] < 0:
        return 0
    return 1 + max(_depth(nodes, tree, int(nodes[side][tree][at])) for side in ("left", "right"))


def save_arrays(arrays: dict[str, np.ndarray]) -> str:
    return json.dumps({k: [str(v.dtype), v.tolist()] for k, v in sorted(arrays.items())})


def load_arrays(text: str, needed: Sequence[str]) -> dict[str, np.ndarray]:
    held = {k: np.array(v, dtype) for k, (dtype, v) in json.loads(text).items()}
    if missing := sorted(set(needed) - set(held)):
        raise ValueError("arrays are missing: " + ", ".join(missing))
    return held


def assess(model: PipelineModel, rows: DataFrame, features: Sequence[str], key: str, previous: DataFrame | None = None, impact_verdict: str | None = None, repeats: int = 10, probe_rows: int = 5) -> DataFrame:
    """score, gate, determinism_score, drift_score, findings of a candidate: repeated scores, drift, and adverse impact, which can only lower PASS to WARN."""
    probe = rows.orderBy(F.xxhash64(key), key).limit(probe_rows)
    runs = score(model, probe.crossJoin(rows.sparkSession.range(repeats).withColumnRenamed("id", "__run")), features)
    cases = determinism(runs.select(F.concat(F.lit("row "), F.col(key).cast("string")).alias("c"), F.round("probability", 12).cast("string").alias("o")), "c", "o")
    if previous is None:
        drift = rows.sparkSession.createDataFrame([], "feature string, severity string, statistic double")
    else:
        both = matrix_values(previous, features, F.lit(False)).union(matrix_values(rows, features, F.lit(True)))
        drift = psi_merge_first(both).groupBy("feature").agg(F.first("severity").alias("severity"), F.first("psi").alias("statistic"))
    report = fidelity(cases, drift)
    if impact_verdict == "ADVERSE_IMPACT":
        report = report.withColumn("gate", F.when(F.col("gate") == "PASS", "WARN").otherwise(F.col("gate"))).withColumn("findings", F.array_append("findings", F.lit("adverse impact")))
    return report


def model_card(name: str, version: int, metrics: dict[str, float], features: Sequence[str], note: str = "") -> dict:
    return {"name": name, "version": version, "metrics": dict(sorted(metrics.items())), "features": list(features), "note": note}


def grid_search(train_one, validate, configs: Sequence[dict]) -> tuple[dict, list[tuple[dict, float]]]:
    """The best config by validate(train_one(config)), and all scores; the first of equals."""
    scored = [(c, float(validate(train_one(**c)))) for c in configs]
    return max(scored, key=lambda x: x[1])[0], scored
