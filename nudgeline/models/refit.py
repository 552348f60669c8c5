"""Offline refit of the arm models themselves: L-BFGS over gradients that Spark adds up.

The network, loss and penalty are those of the online models, so the result is a list of ``ArmModel``
that can be written to a ledger and serve (``Ledger.adopt``).

Every pass over the examples yields loss and gradient of all arms at once, each at a point of its own.
Arms do not wait for each other: one whose point is good enough takes it, remembers the curvature and
chooses a new direction; one whose step was too long tries half of it in the same pass. The driver
holds, per arm, a weight vector and the last ``memory`` pairs of differences; it gets one number per
weight and pass. The sums are decimals, so a fit does not depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import Policy
from . import network
from .scoring import BLOCK_ROWS
from .weights import ArmModel, initial_models

_SUMS = "arm_idx INT, n BIGINT, sums ARRAY<DOUBLE>"
_EXACT = "decimal(38,18)"
# A step must lower the loss by this part of what the slope promises.
ENOUGH = 1e-4


def _partition_sums(models: dict[int, ArmModel], n_features: int):
    """Per arm: the loss and the gradient, added up over a partition."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, list] = {}
        for batch in batches:
            for arm, rows in batch.groupby("arm_idx"):
                if arm not in models:
                    continue
                for start in range(0, len(rows), BLOCK_ROWS):
                    part = rows.iloc[start : start + BLOCK_ROWS]
                    block = network.dense(part["buckets"].tolist(), n_features)
                    labels = part["label"].to_numpy(dtype=float)
                    layers = network.loss_gradient(models[arm], block, labels)
                    loss = network.loss_sum(models[arm], block, labels)
                    flat = np.concatenate([[loss], *[g.ravel() for g in layers]])
                    total = totals.setdefault(arm, [0, np.zeros_like(flat)])
                    total[0] += len(part)
                    total[1] += flat
        if totals:
            yield pd.DataFrame(
                {
                    "arm_idx": list(totals),
                    "n": [n for n, _ in totals.values()],
                    "sums": [s for _, s in totals.values()],
                }
            )

    return sums


def evaluate(
    examples: DataFrame, models: dict[int, ArmModel], policy: Policy
) -> dict[int, tuple[float, np.ndarray]]:
    """Mean penalized loss and its gradient of each arm that has examples, in one pass."""
    parts = examples.select("arm_idx", "buckets", "label").mapInPandas(
        _partition_sums(models, policy.n_features), _SUMS
    )
    sums = (
        parts.select("arm_idx", "n", F.posexplode("sums").alias("place", "x"))
        .groupBy("arm_idx", "place")
        .agg(F.sum("n").alias("n"), F.sum(F.col("x").cast(_EXACT)).cast("double").alias("x"))
    )
    out = {}
    for arm, part in sums.toPandas().groupby("arm_idx"):
        part = part.sort_values("place")
        model, n, x = models[arm], int(part["n"].iloc[0]), part["x"].to_numpy()
        gradient = network.penalized(model, model.shaped(x[1:]), n, policy.l2)
        penalty = sum(float((w[:-1] ** 2).sum()) for w in model.layers) * policy.l2 / 2
        out[int(arm)] = (x[0] + penalty) / n, np.concatenate([g.ravel() for g in gradient])
    return out


@dataclass
class Descent:
    """L-BFGS of one arm. ``point`` is where loss and gradient are wanted next."""

    at: np.ndarray
    memory: int = 10
    tolerance: float = 1e-5
    loss: float | None = None
    gradient: np.ndarray | None = None
    direction: np.ndarray | None = None
    length: float = 1.0
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    done: bool = False

    @property
    def point(self) -> np.ndarray:
        return self.at if self.direction is None else self.at + self.length * self.direction

    def tell(self, loss: float, gradient: np.ndarray) -> None:
        """Takes loss and gradient at ``point`` and moves on."""
        if self.direction is not None:
            promised = self.length * float(self.gradient @ self.direction)
            if not loss <= self.loss + ENOUGH * promised:
                self.length /= 2
                self.done = self.length < 1e-12
                return
            step, change = self.point - self.at, gradient - self.gradient
            gained = self.loss - loss
            if step @ change > 1e-10 * np.linalg.norm(step) * np.linalg.norm(change):
                self.pairs = [*self.pairs, (step, change)][-self.memory :]
            self.at = self.point
            self.done = gained <= 1e-10 * max(1.0, abs(loss))
        self.loss, self.gradient = loss, gradient
        self.done = self.done or float(np.abs(gradient).max()) < self.tolerance
        self.direction = self._turned(gradient)
        if self.direction @ gradient >= 0:  # not downhill: forget the curvature
            self.pairs, self.direction = [], -gradient
        # Without curvature the slope's length says nothing about how far to go.
        self.length = 1.0 if self.pairs else min(1.0, 1.0 / max(float(np.abs(gradient).sum()), 1e-12))

    def _turned(self, gradient: np.ndarray) -> np.ndarray:
        """The two-loop recursion."""
        q, kept = gradient.copy(), []
        for step, change in reversed(self.pairs):
            a = (step @ q) / (step @ change)
            q -= a * change
            kept.append(a)
        if self.pairs:
            step, change = self.pairs[-1]
            q *= (step @ change) / (change @ change)
        for (step, change), a in zip(self.pairs, reversed(kept)):
            q += (a - (change @ q) / (step @ change)) * step
        return -q


@dataclass
class Refit:
    """The fitted models; per arm its loss before and after, and how many passes it took part in."""

    models: list[ArmModel]
    before: dict[int, float]
    after: dict[int, float]
    passes: int


def refit(
    examples: DataFrame,
    policy: Policy,
    start: list[ArmModel] | None = None,
    max_passes: int = 60,
    memory: int = 10,
    tolerance: float = 1e-5,
) -> Refit:
    """Fits every arm that has examples; the others keep the weights they start with.

    ``examples`` are read once per pass, so they should be a landed table. Moments and step counts of
    the optimizer begin anew.
    """
    models = [ArmModel(m.layers) for m in (start or initial_models(policy))]
    runs: dict[int, Descent] | None = None
    before: dict[int, float] = {}
    passes = 0
    while passes < max_passes:
        if runs is None:
            points = dict(enumerate(models))
        else:
            going = {arm: run for arm, run in runs.items() if not run.done}
            points = {arm: ArmModel(models[arm].shaped(run.point)) for arm, run in going.items()}
        if not points:
            break
        found = evaluate(examples, points, policy)
        passes += 1
        if runs is None:
            runs = {arm: Descent(models[arm].flat(), memory, tolerance) for arm in found}
            before = {arm: loss for arm, (loss, _) in found.items()}
        for arm, (loss, gradient) in found.items():
            runs[arm].tell(loss, gradient)
    for arm, run in (runs or {}).items():
        models[arm] = ArmModel(models[arm].shaped(run.at))
    after = {arm: run.loss for arm, run in (runs or {}).items()}
    return Refit(models, before, after, passes)


def with_fit(examples: DataFrame, fitted: Refit) -> DataFrame:
    """The examples with the fitted models' verdict on their arm: whether its loss is no worse than that
    of the best constant answer (plus a thousandth, which one-sided arms need)."""
    share = examples.groupBy("arm_idx").agg(F.avg("label").alias("p"))
    parts = [F.when(x > 0, -x * F.log(x)).otherwise(0.0) for x in (F.col("p"), 1 - F.col("p"))]
    loss = F.create_map(*[F.lit(x) for pair in fitted.after.items() for x in pair]) if fitted.after else None
    reached = loss[F.col("arm_idx")] if loss is not None else F.lit(None).cast("double")
    beats = (reached <= parts[0] + parts[1] + 0.001).alias("beats_constant")
    return examples.join(share.select("arm_idx", beats), "arm_idx")
