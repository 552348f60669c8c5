"""One step on a whole batch of judged suggestions, data-parallel.

Every task sums the gradient of its rows against the shipped weights; Spark adds the sums up.
What reaches the driver is one number per weight, however many examples there were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import Policy
from . import network
from .scoring import BLOCK_ROWS
from .weights import ArmModel


def _partition_gradient(models: list[ArmModel], policy: Policy):
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, list] = {}
        for batch in batches:
            for arm, rows in batch.groupby("arm_idx"):
                for start in range(0, len(rows), BLOCK_ROWS):
                    part = rows.iloc[start : start + BLOCK_ROWS]
                    block = network.dense(part["buckets"].tolist(), policy.n_features)
                    labels = part["label"].to_numpy(dtype=float)
                    layers = network.loss_gradient(models[arm], block, labels)
                    flat = np.concatenate([g.ravel() for g in layers])
                    total = totals.setdefault(arm, [0, np.zeros_like(flat)])
                    total[0] += len(part)
                    total[1] += flat
        if totals:
            yield pd.DataFrame(
                {
                    "arm_idx": list(totals),
                    "n": [n for n, _ in totals.values()],
                    "gradient": [g for _, g in totals.values()],
                }
            )

    return sums


def gradient_sums(examples: DataFrame, models: list[ArmModel], policy: Policy) -> DataFrame:
    """Summed gradient per arm and weight: (arm_idx, place, n, gradient)."""
    parts = examples.select("arm_idx", "buckets", "label").mapInPandas(
        _partition_gradient(models, policy), "arm_idx INT, n BIGINT, gradient ARRAY<DOUBLE>"
    )
    return (
        parts.select("arm_idx", "n", F.posexplode("gradient").alias("place", "part"))
        .groupBy("arm_idx", "place")
        .agg(F.sum("n").alias("n"), F.sum("part").alias("gradient"))
    )


def update(examples: DataFrame, models: list[ArmModel], policy: Policy) -> list[ArmModel] | None:
    """Models one Adam step per arm further; None when there was nothing to learn from.

    Collected are as many numbers as the models have weights.
    """
    collected = gradient_sums(examples, models, policy).toPandas()
    if collected.empty:
        return None
    out = list(models)
    for arm, rows in collected.groupby("arm_idx"):
        summed = models[arm].shaped(rows.sort_values("place")["gradient"].to_numpy())
        mean = network.penalized(models[arm], summed, int(rows["n"].iloc[0]), policy.l2)
        out[arm] = models[arm].adam(mean, policy.learning_rate)
    return out
