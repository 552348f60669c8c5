"""Scoring every arm for every session-batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import Policy
from . import network
from .weights import ArmModel

# Rows of one matrix product; bounds the dense block that an Arrow batch turns into.
BLOCK_ROWS = 4096


def scorer(models: list[ArmModel], policy: Policy):
    """A vectorised function from set slots to one score per arm, in arm order.

    All rows are scored with the models as passed in; the weights travel with the function.
    Null in, null out.
    """
    n_features = policy.n_features

    @F.pandas_udf("array<double>")
    def score(buckets: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(buckets), index=buckets.index, dtype=object)
        wanted = buckets[buckets.notna()]
        for start in range(0, len(wanted), BLOCK_ROWS):
            part = wanted.iloc[start : start + BLOCK_ROWS]
            block = network.dense(part.tolist(), n_features)
            scores = np.column_stack([network.probability(m, block) for m in models])
            out.loc[part.index] = pd.Series(list(scores), index=part.index)
        return out

    return score


def list_scorer(models: list[ArmModel], policy: Policy):
    """The same for an array of such vectors per row: one array of scores for each of them."""
    n_features = policy.n_features

    @F.pandas_udf("array<array<double>>")
    def score(vectors: pd.Series) -> pd.Series:
        sizes = vectors.map(len).to_numpy()
        flat = [vector for row in vectors for vector in row]
        parts = [np.empty((0, len(models)))]
        for start in range(0, len(flat), BLOCK_ROWS):
            block = network.dense(flat[start : start + BLOCK_ROWS], n_features)
            parts.append(np.column_stack([network.probability(m, block) for m in models]))
        split = np.split(np.vstack(parts), np.cumsum(sizes)[:-1])
        return pd.Series([list(scores) for scores in split][: len(vectors)], index=vectors.index)

    return score


def with_scores(summaries: DataFrame, models: list[ArmModel], policy: Policy) -> DataFrame:
    return summaries.withColumn("scores", scorer(models, policy)(F.col("buckets")))


def arm_scores(summaries: DataFrame, models: list[ArmModel], policy: Policy) -> DataFrame:
    """One row per session-batch and arm."""
    names = F.array(*[F.lit(a) for a in policy.arms])
    scored = with_scores(summaries, models, policy)
    return scored.select(
        "batch_id", "session_id", F.posexplode("scores").alias("arm_idx", "score")
    ).withColumn("action", F.get(names, F.col("arm_idx")))
