"""Gradient boosting one round at a time, so that a validation error can end it.

Each round fits one tree to the residuals of the rounds before. The residuals live in a
column: a round adds the new tree's output to it, and every ``STORE_ROUNDS`` rounds the
table is written to the shared folder, so neither plans nor lineage grow with the number
of rounds and no tree is evaluated twice on the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

STORE_ROUNDS = 16


class Booster:
    """Boosting state over ``rows`` with ``__x`` (vector), ``__y`` and, optionally, ``__valid`` (boolean).

    Starts from the mean; ``step`` adds a tree at ``rate``. Valid rows are not trained on.
    """

    def __init__(self, rows: DataFrame, *, rate: float, seed: int, **tree):
        self.rate, self.seed, self.tree = rate, seed, tree
        valid = F.col("__valid") if "__valid" in rows.columns else F.lit(False)
        self.rows = rows.select("__x", F.col("__y").cast("double"), F.coalesce(valid, F.lit(False)).alias("__valid"))
        self.rows = self.rows.where("__y IS NOT NULL AND NOT isnan(__y)")
        self.base = self.rows.where(~F.col("__valid")).agg(F.avg("__y")).first()[0]
        if self.base is None:
            raise ValueError("no training rows")
        self.rows = self.rows.withColumn("__rest", F.col("__y") - F.lit(self.base))
        self.trees: list = []
        self.errors: list[float] = []

    def step(self) -> float | None:
        """One more tree; the mean absolute error on the valid rows after it."""
        number = len(self.trees)
        learner = RandomForestRegressor(
            featuresCol="__x", labelCol="__rest", predictionCol="__step", numTrees=1, bootstrap=False,
            seed=self.seed + number, **self.tree,
        )
        model = learner.fit(self.rows.where(~F.col("__valid")))
        self.trees.append(model)
        moved = model.transform(self.rows).withColumn("__rest", F.col("__rest") - F.lit(self.rate) * F.col("__step"))
        moved = moved.select("__x", "__y", "__valid", "__rest")
        self.rows = materialise(moved) if number % STORE_ROUNDS == 0 else moved
        error = self.rows.where("__valid").agg(F.avg(F.abs("__rest"))).first()[0]
        self.errors.append(error)
        return error

    def model(self, rounds: int) -> GBTRegressionModel:
        """The first ``rounds`` trees as one model of the part above ``base``."""
        session = self.rows.sparkSession
        jvm, gateway = session.sparkContext._jvm, session.sparkContext._gateway
        trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
        weights = gateway.new_array(jvm.double, rounds)
        for i in range(rounds):
            trees[i], weights[i] = self.trees[i]._java_obj.trees()[0], self.rate
        java = jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"boosted_{self.seed}_{rounds}", trees, weights)
        return GBTRegressionModel(java).setFeaturesCol("__x").setPredictionCol("__above")


def boost(boosters: Sequence[Booster], max_rounds: int, patience: int | None) -> int:
    """Steps all boosters together until their mean error has not fallen for ``patience`` rounds.

    Returns the number of rounds of least mean error. Without patience all rounds are trained.
    """
    best, least = 0, np.inf
    with ThreadPoolExecutor(len(boosters)) as pool:
        for number in range(1, max_rounds + 1):
            errors = pool.map(Booster.step, boosters)
            error = np.mean([np.nan if e is None else e for e in errors])
            if error < least:
                best, least = number, error
            elif patience is not None and number - best >= patience:
                break
    return max(best, 1)
