"""Forward pass and gradient of one arm over a block of vectors."""

from __future__ import annotations

import numpy as np

from ..settings import FALLBACK_SCORE
from .weights import ArmModel


def dense(buckets, n_features: int) -> np.ndarray:
    """0/1 matrix from lists of set slots."""
    block = np.zeros((len(buckets), n_features))
    sizes = [len(b) for b in buckets]
    if sum(sizes):
        block[np.repeat(np.arange(len(buckets)), sizes), np.concatenate(buckets).astype(int)] = 1.0
    return block


def activations(model: ArmModel, block: np.ndarray) -> list[np.ndarray]:
    """Input, rectified hidden layers and the output probability."""
    out = [block]
    for layer in model.layers[:-1]:
        out.append(np.maximum(out[-1] @ layer[:-1] + layer[-1], 0.0))
    last = model.layers[-1]
    logit = out[-1] @ last[:-1] + last[-1]
    # The two-sided form never overflows.
    out.append(0.5 * (1.0 + np.tanh(0.5 * logit)))
    return out


def probability(model: ArmModel, block: np.ndarray) -> np.ndarray:
    """Chance of a reward for each vector, six digits; a model that fails scores 0.5."""
    chance = np.round(activations(model, block)[-1][:, 0], 6)
    return np.where(np.isfinite(chance), chance, FALLBACK_SCORE)


def loss_sum(model: ArmModel, block: np.ndarray, labels: np.ndarray) -> float:
    """Summed log loss, from the logits, so that it stays finite."""
    hidden = activations(model, block)[-2]
    last = model.layers[-1]
    logit = (hidden @ last[:-1] + last[-1])[:, 0]
    return float((np.logaddexp(0.0, logit) - labels * logit).sum())


def loss_gradient(model: ArmModel, block: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Summed gradient of the log loss, in the shape of the layers."""
    seen = activations(model, block)
    delta = seen[-1] - labels[:, None]
    gradients = []
    for k in range(len(model.layers) - 1, -1, -1):
        gradients.append(np.vstack([seen[k].T @ delta, delta.sum(axis=0)]))
        if k:
            delta = (delta @ model.layers[k][:-1].T) * (seen[k] > 0)
    return gradients[::-1]


def penalized(
    model: ArmModel, summed: list[np.ndarray], n: int, l2: float
) -> list[np.ndarray]:
    """Mean gradient with the weight penalty; biases carry none."""
    out = []
    for layer, gradient in zip(model.layers, summed):
        penalty = np.vstack([l2 * layer[:-1], np.zeros((1, layer.shape[1]))])
        out.append((gradient + penalty) / n)
    return out
