"""Boosted trees from a model file, as expressions that stay in the optimizer's hands."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def load_trees(spark: SparkSession, path: str) -> dict:
    """{"base": logit of the base score, "trees": [...]} from a JSON model; ValueError for anything else."""
    return parse_trees("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()), path)


def parse_trees(text: str, path: str = "the text") -> dict:
    try:
        learner = json.loads(text)["learner"]
        trees = learner["gradient_booster"]["model"]["trees"]
        score = float(str(learner["learner_model_param"]["base_score"]).strip("[]"))
    except (KeyError, TypeError, ValueError) as wrong:
        raise ValueError(f"{path} is no tree model") from wrong
    if not trees or not 0 < score < 1:
        raise ValueError(f"{path} has no trees or a base score outside (0, 1)")
    return {"base": math.log(score / (1 - score)), "trees": trees}


def _node(tree: dict, features: list[Column], k: int) -> Column:
    left, right = tree["left_children"][k], tree["right_children"][k]
    if left == -1:
        return F.lit(float(tree["base_weights"][k]))
    at = tree["split_indices"][k]
    yes, no = _node(tree, features, left), _node(tree, features, right)
    default = yes if tree["default_left"][k] else no
    if at >= len(features):
        return default
    x = features[at].cast("double")
    return F.when(x.isNull() | F.isnan(x), default).when(x < float(tree["split_conditions"][k]), yes).otherwise(no)


def probability(model: dict, features: list[Column]) -> Column:
    """The model's probability: each tree goes left below its threshold and by default where a value is missing."""
    total = F.lit(model["base"])
    for tree in model["trees"]:
        total = total + _node(tree, features, 0)
    return 1 / (1 + F.exp(-total))


def standardised(features: list[Column], means: list[float], deviations: list[float]) -> list[Column]:
    """z-scores; a deviation below 1e-10 counts as 1, a missing value as the mean."""
    if not len(features) == len(means) == len(deviations):
        raise ValueError("features, means and deviations differ in number")
    return [F.coalesce(F.nanvl((x - m) / (1.0 if abs(d) < 1e-10 else d), F.lit(0.0)), F.lit(0.0)) for x, m, d in zip(features, means, deviations)]


def signal(p_directional: Column, p_long: Column) -> Column:
    """0 below one half of the first stage, else the side of the second."""
    return F.when(p_directional < 0.5, 0).when(p_long > 0.5, 1).otherwise(-1)
