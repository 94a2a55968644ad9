"""Event-count exponential averages without a fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Half-lives in updates of the fast, medium and slow averages.
SCALES = {"fast": 50, "med": 500, "slow": 5000}


def ema(rows: DataFrame, out: str, update: Column, value: Column, half_life: int, key: str = "instrument_id", order: str = "seq") -> DataFrame:
    """rows with out: after the n-th update, the sum of value * 2**-((n - its own number) / half_life).

    Only rows where update holds count and add. Weights are taken relative to
    blocks of 64 half-lives, so none overflows however long the series; what
    lies more than a block back is below double precision.
    """
    block = 64 * half_life
    w = Window.partitionBy(key).orderBy(order)
    n = rows.withColumn("_u", update.cast("int")).withColumn("_n", F.sum("_u").over(w) - 1)
    n = n.withColumn("_b", F.floor(F.col("_n") / block)).withColumn("_r", F.col("_n") - F.col("_b") * block)
    grow = F.pow(F.lit(2.0), F.col("_r") / half_life)
    inside = Window.partitionBy(key, "_b").orderBy(order)
    n = n.withColumn("_x", F.sum(F.when(F.col("_u") == 1, value.cast("double") * grow).otherwise(0.0)).over(inside) / grow)
    before = Window.partitionBy(key).orderBy("_b").rangeBetween(-1, -1)
    end = F.max(F.when((F.col("_u") == 1) & (F.col("_r") == block - 1), F.struct("_r", "_x"))).over(before)
    carry = F.coalesce(end["_x"] * F.pow(F.lit(2.0), -(F.col("_r") + 1) / half_life), F.lit(0.0))
    return n.withColumn(out, F.col("_x") + carry).drop("_u", "_n", "_b", "_r", "_x")
