"""Boosted trees by folds: one model for each split, stopped early on the last days of its training days."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_predictions(rows: DataFrame, roles: DataFrame, features: list[str], folds: Iterable[int], rounds: int = 30, depth: int = 3, step: float = 0.1, seed: int = 42) -> DataFrame:
    """(split, *columns of rows, p) for the test rows of each fold.

    rows: day, label (0 or 1) and the features; roles: (split, day, day_no,
    role). Of a split's training days the last fifth validates: boosting stops
    where the loss on it no longer falls. Missing features count as zero. A
    fold whose training rows lack a label or validation gives p = null.
    Only trees reach the driver, never rows.
    """
    plain = rows.select("*", F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features]).alias("_x"))
    wide = plain.select(*rows.columns, *[F.get("_x", F.lit(k)).alias(f"_f{k}") for k in range(len(features))])
    ready = VectorAssembler(inputCols=[f"_f{k}" for k in range(len(features))], outputCol="_features").transform(wide).select(*rows.columns, "_features")
    out = []
    for split in folds:
        days = roles.where(F.col("split") == split)
        train = days.where("role = 'train'").selectExpr("day", "row_number() over (order by day_no) > floor(count(*) over () * 4 / 5e0) as _validation")
        known = ready.join(F.broadcast(train), "day").select(F.col("label").cast("double").alias("_label"), "_features", "_validation")
        held = ready.join(F.broadcast(days.where("role = 'test'").select("day")), "day")
        kinds = {(r["_label"], r["_validation"]) for r in known.select("_label", "_validation").distinct().collect()}
        if {l for l, _ in kinds} == {0.0, 1.0} and {v for _, v in kinds} == {False, True}:
            trees = GBTClassifier(labelCol="_label", featuresCol="_features", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, validationIndicatorCol="_validation", validationTol=0.01)
            trees = trees.setPredictionCol("_prediction").setProbabilityCol("_probability").setRawPredictionCol("_raw")
            scored = trees.fit(known).transform(held).withColumn("p", F.get(vector_to_array("_probability"), F.lit(1)))
        else:
            scored = held.withColumn("p", F.lit(None).cast("double"))
        out.append(scored.select(F.lit(split).alias("split"), *rows.columns, "p"))
    return reduce(DataFrame.unionByName, out)
