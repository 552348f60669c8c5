"""The arm models as a small table: one multi-layer perceptron per arm.

Three arms hold about 11,000 numbers, whatever the size of the data, so they may pass through
the driver and be shipped to the tasks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..schemas import MODEL
from ..settings import Policy

# Adam constants.
BETA_1, BETA_2, EPSILON = 0.9, 0.999, 1e-8


def layer_widths(policy: Policy) -> tuple[int, ...]:
    return (policy.n_features, *policy.hidden, 1)


def _unit(seed: str, arm: int, layer: int, i: int, j: int) -> float:
    digest = hashlib.md5(f"{seed}{arm}:{layer}:{i}:{j}".encode()).hexdigest()
    return (int(digest[:8], 16) % 2001 - 1000) / 1000


def initial_layer(policy: Policy, arm: int, layer: int) -> np.ndarray:
    """Seeded uniform weights, shape (inputs + 1, outputs); the last row holds the biases.

    The bound is sqrt(6 / (inputs + outputs)), as usual for rectified units.
    """
    widths = layer_widths(policy)
    n_in, n_out = widths[layer], widths[layer + 1]
    bound = (6.0 / (n_in + n_out)) ** 0.5
    rows = [*range(n_in), -1]
    return np.array([[_unit(policy.seed, arm, layer, i, j) * bound for j in range(n_out)] for i in rows])


@dataclass
class ArmModel:
    """Weights of one arm and the state of its optimizer."""

    layers: list[np.ndarray]
    m: list[np.ndarray] = field(default_factory=list)
    v: list[np.ndarray] = field(default_factory=list)
    step: int = 0

    def __post_init__(self):
        self.m = self.m or [np.zeros_like(w) for w in self.layers]
        self.v = self.v or [np.zeros_like(w) for w in self.layers]

    @property
    def n_features(self) -> int:
        return self.layers[0].shape[0] - 1

    def flat(self) -> np.ndarray:
        """All weights in a row, layer by layer."""
        return np.concatenate([w.ravel() for w in self.layers])

    def shaped(self, flat: np.ndarray) -> list[np.ndarray]:
        """A row of numbers cut into the shapes of the layers."""
        cuts = np.cumsum([w.size for w in self.layers])[:-1]
        return [part.reshape(w.shape) for part, w in zip(np.split(flat, cuts), self.layers)]

    def adam(self, gradients: list[np.ndarray], learning_rate: float) -> ArmModel:
        """A new model, one Adam step further."""
        step = self.step + 1
        rate = learning_rate * (1 - BETA_2**step) ** 0.5 / (1 - BETA_1**step)
        m = [BETA_1 * a + (1 - BETA_1) * g for a, g in zip(self.m, gradients)]
        v = [BETA_2 * a + (1 - BETA_2) * g * g for a, g in zip(self.v, gradients)]
        layers = [w - rate * a / (np.sqrt(b) + EPSILON) for w, a, b in zip(self.layers, m, v)]
        return ArmModel(layers, m, v, step)


def initial_models(policy: Policy) -> list[ArmModel]:
    """Untrained, seeded models."""
    n_layers = len(layer_widths(policy)) - 1
    return [
        ArmModel([initial_layer(policy, arm, layer) for layer in range(n_layers)])
        for arm in range(len(policy.arms))
    ]


def fresh_models(policy: Policy) -> list[ArmModel]:
    """Models as a new job starts with: one step on an empty vector seen with either label."""
    from .network import loss_gradient, penalized

    empty = np.zeros((2, policy.n_features))
    labels = np.array([0.0, 1.0])
    return [
        model.adam(
            penalized(model, loss_gradient(model, empty, labels), 2, policy.l2),
            policy.learning_rate,
        )
        for model in initial_models(policy)
    ]


def to_table(
    spark: SparkSession, models: list[ArmModel], policy: Policy, version: int
) -> DataFrame:
    """Models as a table (``schemas.MODEL``)."""
    rows = [
        (
            version,
            arm,
            policy.arms[arm],
            model.n_features,
            layer,
            model.layers[layer].ravel(),
            model.m[layer].ravel(),
            model.v[layer].ravel(),
            model.step,
        )
        for arm, model in enumerate(models)
        for layer in range(len(model.layers))
    ]
    names = [c.split(" ")[0] for c in MODEL.split(", ")]
    # An Arrow table reaches the JVM without a Python task.
    table = pa.table([pa.array(column) for column in zip(*rows)], names=names)
    return spark.createDataFrame(table, MODEL)


def from_rows(rows, policy: Policy) -> list[ArmModel] | None:
    """Models of one version; None when they do not fit the arms or the vector size."""
    widths = layer_widths(policy)
    n_layers = len(widths) - 1
    by_place = {(r["arm_idx"], r["layer"]): r for r in rows}
    wanted = {(a, k) for a in range(len(policy.arms)) for k in range(n_layers)}
    fits = set(by_place) == wanted and all(
        r["n_features"] == policy.n_features
        and r["action"] == policy.arms[r["arm_idx"]]
        and len(r["weights"]) == (widths[r["layer"]] + 1) * widths[r["layer"] + 1]
        for r in rows
    )
    if not fits:
        return None

    def parts(arm, column):
        return [
            np.array(by_place[arm, k][column]).reshape(widths[k] + 1, widths[k + 1])
            for k in range(n_layers)
        ]

    return [
        ArmModel(parts(a, "weights"), parts(a, "adam_m"), parts(a, "adam_v"), by_place[a, 0]["step"])
        for a in range(len(policy.arms))
    ]
