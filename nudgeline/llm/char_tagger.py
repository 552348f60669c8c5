"""A character tagger in numpy: a bidirectional LSTM scores the tags of every character, a linear-chain
CRF scores neighbouring tags, and both are trained together on the likelihood of whole windows.

Characters are folded to few symbols (letters in lower case, one symbol for all digits), so a number's
shape counts and not its digits. Tags are outside, and begin and inside of each kind; an inside tag
follows only a tag of its own kind.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Symbols: 0 pads a window, then one for all digits, a-z, the other printable ASCII signs, white space
# and all characters beyond ASCII.
_DIGIT, _LETTER, _SIGN, _SPACE, _OTHER, N_SYMBOLS = 1, 2, 28, 62, 63, 64


def _symbol_table() -> np.ndarray:
    table = np.full(128, _OTHER, np.int64)
    table[[9, 10, 11, 12, 13, 32]] = _SPACE
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    table[signs] = _SIGN + np.arange(len(signs))
    for first in (65, 97):
        table[first : first + 26] = _LETTER + np.arange(26)
    table[48:58] = _DIGIT
    return table


_TABLE = _symbol_table()


def symbols(windows: list[str], width: int) -> np.ndarray:
    """Symbol numbers, one row per window, padded at the end."""
    out = np.zeros((len(windows), width), np.int64)
    for i, window in enumerate(windows):
        codes = np.frombuffer(window.encode("utf-32-le", "surrogatepass"), "<u4")
        out[i, : len(codes)] = np.where(codes < 128, _TABLE[np.minimum(codes, 127)], _OTHER)
    return out


def tag_rules(n_kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Which tag may follow which, and which may come first."""
    n = 1 + 2 * n_kinds
    allowed = np.ones((n, n), bool)
    for kind in range(n_kinds):
        begin, inside = 1 + 2 * kind, 2 + 2 * kind
        allowed[:, inside] = False
        allowed[[begin, inside], inside] = True
    first = np.ones(n, bool)  # a window may begin inside a span
    return allowed, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


_FORBIDDEN = -1e4


@dataclass
class Tagger:
    """Weights by name: for each direction ``in`` (symbol, 4h), ``rec`` (h, 4h) and ``bias``; ``out``
    (2h, tags), ``out_bias``; ``next`` (tag, tag) and ``first`` (tag) of the CRF."""

    weights: dict[str, np.ndarray]
    n_kinds: int

    @classmethod
    def fresh(cls, n_kinds: int, hidden: int, seed: int) -> Tagger:
        draw = np.random.default_rng(seed)
        n = 1 + 2 * n_kinds
        weights = {}
        for side in ("left", "right"):
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1.0  # remember at first
            weights |= {
                f"{side}_in": draw.normal(0, 0.3, (N_SYMBOLS, 4 * hidden)),
                f"{side}_rec": draw.normal(0, hidden**-0.5, (hidden, 4 * hidden)),
                f"{side}_bias": bias,
            }
        weights |= {
            "out": draw.normal(0, (2 * hidden) ** -0.5, (2 * hidden, n)),
            "out_bias": np.zeros(n),
            "next": np.zeros((n, n)),
            "first": np.zeros(n),
        }
        return cls(weights, n_kinds)

    def compact(self) -> Tagger:
        """The same in single precision."""
        return Tagger({k: w.astype(np.float32) for k, w in self.weights.items()}, self.n_kinds)

    # -- scores ----------------------------------------------------------------------------------

    def _direction(self, side: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states (time, row, h) in reading order of ``x`` (row, time), and what the way back
        needs."""
        w_in, rec, bias = (self.weights[f"{side}_{k}"] for k in ("in", "rec", "bias"))
        n, width = x.shape
        h = rec.shape[0]
        state = np.zeros((n, h), rec.dtype)
        cell = np.zeros((n, h), rec.dtype)
        out = np.empty((width, n, h), rec.dtype)
        kept = []
        read = w_in[x.T] + bias
        for t in range(width):
            z = read[t] + state @ rec
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            before, last = cell, state
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            state = o * squashed
            out[t] = state
            kept.append((i, f, o, g, before, squashed, last))
        return out, kept

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Score of each tag (time, row, tag)."""
        left, kept_left = self._direction("left", x)
        right, kept_right = self._direction("right", x[:, ::-1])
        both = np.concatenate([left, right[::-1]], axis=2)
        scores = both @ self.weights["out"] + self.weights["out_bias"]
        return scores, (both, kept_left, kept_right)

    def _chain(self) -> tuple[np.ndarray, np.ndarray]:
        allowed, first = tag_rules(self.n_kinds)
        step = np.where(allowed, self.weights["next"], _FORBIDDEN).astype(self.weights["next"].dtype)
        return step, np.where(first, self.weights["first"], _FORBIDDEN).astype(step.dtype)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of each row (Viterbi)."""
        scores, _ = self.emissions(x)
        step, first = self._chain()
        width, n, _ = scores.shape
        best = first + scores[0]
        back = np.empty(scores.shape, np.int8)
        for t in range(1, width):
            ways = best[:, :, None] + step
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[t]
        tags = np.empty((n, width), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(width - 1, 0, -1):
            tags[:, t - 1] = back[t, rows, tags[:, t]]
        return tags

    # -- learning --------------------------------------------------------------------------------

    def _back(self, side: str, x: np.ndarray, kept: list, d_out: np.ndarray, grads: dict) -> None:
        rec = self.weights[f"{side}_rec"]
        h = rec.shape[0]
        d_state = np.zeros_like(d_out[0])
        d_cell = np.zeros_like(d_out[0])
        every = np.empty((len(kept), len(x), 4 * h), rec.dtype)
        for t in range(len(kept) - 1, -1, -1):
            i, f, o, g, before, squashed, _ = kept[t]
            d_state = d_state + d_out[t]
            d_cell = d_cell + d_state * o * (1 - squashed**2)
            dz = np.concatenate(
                [
                    d_cell * g * i * (1 - i),
                    d_cell * before * f * (1 - f),
                    d_state * squashed * o * (1 - o),
                    d_cell * i * (1 - g**2),
                ],
                axis=1,
            )
            every[t] = dz
            d_state = dz @ rec.T
            d_cell = d_cell * f
        flat = every.reshape(-1, 4 * h)
        lasts = np.stack([k[-1] for k in kept]).reshape(-1, h)
        seen = (x.T.reshape(-1, 1) == np.arange(N_SYMBOLS)).astype(rec.dtype)
        grads[f"{side}_in"], grads[f"{side}_rec"] = seen.T @ flat, lasts.T @ flat
        grads[f"{side}_bias"] = flat.sum(axis=0)

    def loss_gradient(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the rows' tags, and its gradient."""
        scores, (both, kept_left, kept_right) = self.emissions(x)
        step, first = self._chain()
        width, n, n_tags = scores.shape
        rows = np.arange(n)
        ahead = np.empty_like(scores)
        ahead[0] = first + scores[0]
        for t in range(1, width):
            ahead[t] = _log_sum(ahead[t - 1][:, :, None] + step, 1) + scores[t]
        total = _log_sum(ahead[-1], 1)
        behind = np.zeros_like(scores)
        for t in range(width - 2, -1, -1):
            behind[t] = _log_sum(step[None] + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
        d_scores = np.exp(ahead + behind - total[None, :, None])
        d_next = np.zeros_like(step)
        for t in range(1, width):
            joint = ahead[t - 1][:, :, None] + step + (scores[t] + behind[t])[:, None, :]
            d_next += np.exp(joint - total[:, None, None]).sum(axis=0)
        own = first[tags[:, 0]] + scores[np.arange(width)[:, None], rows, tags.T].sum(axis=0)
        own = own + step[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        d_first = d_scores[0].sum(axis=0)
        np.add.at(d_first, tags[:, 0], -1.0)
        np.add.at(d_next, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1.0)
        d_scores[np.arange(width)[:, None], rows, tags.T] -= 1.0
        flat = d_scores.reshape(-1, n_tags)
        h = both.shape[2] // 2
        grads = {
            "out": both.reshape(-1, 2 * h).T @ flat,
            "out_bias": flat.sum(axis=0),
            "next": np.where(tag_rules(self.n_kinds)[0], d_next, 0.0),
            "first": d_first,
        }
        d_both = d_scores @ self.weights["out"].T
        self._back("left", x, kept_left, d_both[:, :, :h], grads)
        self._back("right", x[:, ::-1], kept_right, d_both[::-1, :, h:], grads)
        return float((total - own).mean()), {k: g / n for k, g in grads.items()}


def train(
    x: np.ndarray,
    tags: np.ndarray,
    n_kinds: int,
    hidden: int = 24,
    steps: int = 400,
    batch: int = 48,
    rate: float = 0.02,
    seed: int = 1,
) -> Tagger:
    """Adam over random batches with a falling rate; gradients are cut at a norm of 5."""
    model = Tagger.fresh(n_kinds, hidden, seed).compact()
    draw = np.random.default_rng(seed)
    m = {k: np.zeros_like(w) for k, w in model.weights.items()}
    v = {k: np.zeros_like(w) for k, w in model.weights.items()}
    for step in range(1, steps + 1):
        rows = draw.integers(0, len(x), batch)
        _, grads = model.loss_gradient(x[rows], tags[rows])
        norm = sum(float((g**2).sum()) for g in grads.values()) ** 0.5
        cut = min(1.0, 5.0 / max(norm, 1e-12))
        now = rate * (1.0 - 0.95 * step / steps)
        for k, g in grads.items():
            g = g * cut
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            change = (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            model.weights[k] = (model.weights[k] - now * change).astype(np.float32)
    return model
