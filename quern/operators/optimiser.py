"""Steps of an optimiser over a table of parameters, and checkpoints of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def adamw_step(parameters: DataFrame, step: int, rate: float, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8, decay: float = 0.01) -> DataFrame:
    """The same rows after one step; ``step`` counts from 1. Columns value, grad, m and v are the
    parameter, its gradient and the two running means, 0 at first. Each row is a parameter of its own;
    one without a gradient stays as it is."""
    first, second = betas
    m = F.col("m") * first + F.col("grad") * (1 - first)
    v = F.col("v") * second + F.col("grad") * F.col("grad") * (1 - second)
    change = (m / (1 - first**step)) / (F.sqrt(v / (1 - second**step)) + eps)
    after = {"value": F.col("value") * (1 - rate * decay) - change * rate, "m": m, "v": v}
    known = F.col("grad").isNotNull()
    return parameters.select(*(F.when(known, after[c]).otherwise(F.col(c)).alias(c) if c in after else F.col(f"`{c}`") for c in parameters.columns))


def save_checkpoint(parameters: DataFrame, iteration: int, path: str) -> None:
    """Writes a table of parameters, with whatever an optimiser keeps there, and the iteration."""
    parameters.write.parquet(f"{path}/parameters")
    parameters.sparkSession.createDataFrame([(iteration,)], "iteration long").coalesce(1).write.parquet(f"{path}/iteration")


def load_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The table of parameters and the iteration that were saved; the iteration is written last, so a
    checkpoint that was broken off can't be loaded."""
    return spark.read.parquet(f"{path}/parameters"), spark.read.parquet(f"{path}/iteration").first()["iteration"]
