"""Scorers: anything that adds a lower-is-safer score column; Spark ML pipelines and out-of-fold scoring among them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysieve.functions.checks import ConstraintError, outcome_blind
from skysieve.operators.contracts import enough_folds
from skysieve.operators.features import event_weights, tail_weights
from skysieve.session import cut

#: A scorer fits on labelled rows and returns a function that adds `score` to rows.
Scorer = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def with_missing_flags(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Add <column>_value (0 where missing or not finite) and <column>_missing (0 or 1)."""
    out = {}
    for c in columns:
        x = F.col(c).cast("double")
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        # Readings span many orders of magnitude.
        out |= {f"{c}_value": F.when(bad, 0.0).otherwise(F.signum(x) * F.log1p(F.abs(x))), f"{c}_missing": bad.cast("double")}
    return rows.withColumns(out)


def pipeline(columns: tuple[str, ...], categories: tuple[str, ...] = (), trees: bool = False, iterations: int = 20) -> Pipeline:
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in categories]
    stages += [OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_hot") for c in categories]
    inputs = [f"{c}_{k}" for c in columns for k in ("value", "missing")] + [f"{c}_hot" for c in categories]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    kind = GBTClassifier(labelCol="y", weightCol="weight", maxIter=iterations, maxDepth=4, seed=7) if trees else LogisticRegression(labelCol="y", weightCol="weight", maxIter=iterations, regParam=0.01)
    return Pipeline(stages=[*stages, kind])


def feature_contract(columns: tuple[str, ...], categories: tuple[str, ...] = ()) -> str:
    """SHA-256 of the names of a model's inputs in their order; repeated names are an error."""
    names = [*columns, *categories]
    if not names or len(set(names)) != len(names):
        raise ConstraintError("a feature contract needs names, each of them once")
    return hashlib.sha256(json.dumps([list(columns), list(categories)]).encode()).hexdigest()


def ml_scorer(columns: tuple[str, ...], categories: tuple[str, ...] = (), trees: bool = False, iterations: int = 20, weighted: Callable[[DataFrame], DataFrame] = event_weights, contract: str | None = None) -> Scorer:
    """Weighted so that every event counts alike, or by `weighted`; missing categories are a category; rows to be scored may not show outcomes. A
    `contract` other than that of the inputs is an error."""
    if contract is not None and contract != feature_contract(columns, categories):
        raise ConstraintError("the inputs are not those of the feature contract")

    def prepared(rows: DataFrame) -> DataFrame:
        return with_missing_flags(rows, columns).withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")) for c in categories})

    def fit(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
        model: PipelineModel = pipeline(columns, categories, trees, iterations).fit(weighted(prepared(rows)))

        def score(new: DataFrame) -> DataFrame:
            out = model.transform(prepared(outcome_blind(new)))
            return out.withColumn("score", vector_to_array("probability")[1]).select(*new.columns, "score")

        return score

    return fit


def tail_aligned_scorer(columns: tuple[str, ...], categories: tuple[str, ...] = (), trees: bool = False, iterations: int = 20, hard_fraction: float = 0.25, hard_mass: float = 0.5, fold: str = "fold") -> Scorer:
    """Fitted in two steps: models of the other folds score each fold of the training rows, and these scores, which no row has a part in, put the
    weight of positive events on their lowest messages. Needs two folds at least, and a column `diag_no` that tells rows apart."""
    base = ml_scorer(columns, categories, trees, iterations)

    def fit(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
        inner = out_of_fold(enough_folds(rows, 2), base, fold, at_once=1).select(F.col("diag_no").alias("__of"), F.col("score").alias("__base"))
        aligned = cut(tail_weights(rows.join(inner, F.col("diag_no") == F.col("__of")).drop("__of"), "__base", hard_fraction, hard_mass).drop("__base"))
        return ml_scorer(columns, categories, trees, iterations, weighted=lambda prepared: prepared)(aligned)

    return fit


def out_of_fold(rows: DataFrame, scorer: Scorer, fold: str = "fold", at_once: int = 4) -> DataFrame:
    """Every row scored by a model of the other folds. The folds are a handful; each fit is a series of distributed jobs, and `at_once` fits run
    side by side."""
    rows = cut(rows)
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        scores = list(pool.map(lambda f: scorer(rows.filter(F.col(fold) != f)), folds))
    return reduce(DataFrame.unionByName, (score(rows.filter(F.col(fold) == f).drop("y")) for f, score in zip(folds, scores)))
