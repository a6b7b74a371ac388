"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by Adam, decoding by Viterbi.

Texts come as windows of character classes (window x place); tags are numbers, 0 for none. Weights of one direction
are the rows of a class and of a hidden unit, for the input, forget, output and cell gates side by side.
"""

from __future__ import annotations

import numpy as np

HIDDEN, EPOCHS, BATCH, RATE = 16, 14, 64, 0.02
FORBIDDEN = -1e4


def start_weights(classes: int, tags: int, hidden: int = HIDDEN, seed: int = 0) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    near = lambda *shape: (draw.normal(size=shape) / np.sqrt(hidden)).astype(np.float32)
    out = {"out": near(2 * hidden, tags), "bias": np.zeros(tags, dtype=np.float32), "step": np.zeros((tags, tags), dtype=np.float32)}
    for way in "fb":
        out[f"in_{way}"], out[f"rec_{way}"] = near(classes, 4 * hidden), near(hidden, 4 * hidden)
        out[f"in_{way}"][:, hidden : 2 * hidden] += 1.0  # remember at first
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _read(classes: np.ndarray, w_in: np.ndarray, w_rec: np.ndarray, keep: bool = False):
    """Hidden states (place x window x unit) along the columns of ``classes``; with ``keep`` also gates and cells."""
    places, windows, hidden = classes.shape[1], classes.shape[0], len(w_rec)
    states = np.zeros((places + 1, windows, hidden), dtype=np.float32)
    gates = np.zeros((places, windows, 4 * hidden), dtype=np.float32) if keep else None
    cells = np.zeros((places + 1, windows, hidden), dtype=np.float32) if keep else None
    cell = np.zeros((windows, hidden), dtype=np.float32)
    for t in range(places):
        z = w_in[classes[:, t]] + states[t] @ w_rec
        z[:, : 3 * hidden] = _sigmoid(z[:, : 3 * hidden])
        z[:, 3 * hidden :] = np.tanh(z[:, 3 * hidden :])
        cell = z[:, hidden : 2 * hidden] * cell + z[:, :hidden] * z[:, 3 * hidden :]
        states[t + 1] = z[:, 2 * hidden : 3 * hidden] * np.tanh(cell)
        if keep:
            gates[t], cells[t + 1] = z, cell
    return (states, gates, cells) if keep else states


def _read_back(classes, w_rec, states, gates, cells, d_states, g_in, g_rec) -> None:
    """Adds the gradients of one direction to ``g_in`` and ``g_rec``."""
    hidden = len(w_rec)
    d_h, d_c = np.zeros_like(states[0]), np.zeros_like(states[0])
    for t in range(classes.shape[1] - 1, -1, -1):
        i, f, o, g = (gates[t][:, k * hidden : (k + 1) * hidden] for k in range(4))
        d_h = d_h + d_states[t]
        tanh_c = np.tanh(cells[t + 1])
        d_c = d_c + d_h * o * (1 - tanh_c * tanh_c)
        d_z = np.concatenate([d_c * g * i * (1 - i), d_c * cells[t] * f * (1 - f), d_h * tanh_c * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
        np.add.at(g_in, classes[:, t], d_z)
        g_rec += states[t].T @ d_z
        d_h, d_c = d_z @ w_rec.T, d_c * f


def emissions(weights: dict[str, np.ndarray], classes: np.ndarray) -> np.ndarray:
    """Tag scores: window x place x tag."""
    forward = _read(classes, weights["in_f"], weights["rec_f"])[1:]
    backward = _read(classes[:, ::-1], weights["in_b"], weights["rec_b"])[:0:-1]
    return np.ascontiguousarray((np.concatenate([forward, backward], axis=2) @ weights["out"] + weights["bias"]).transpose(1, 0, 2))


def viterbi(scores: np.ndarray, step: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """The best tags (window x place) under transitions ``step``; ``allowed`` has 0 or FORBIDDEN for each pair."""
    windows, places, tags = scores.shape
    move = (step + allowed)[None]
    best, back = scores[:, 0] + allowed[0], np.zeros((places, windows, tags), dtype=np.int8)
    for t in range(1, places):
        all_ = best[:, :, None] + move
        back[t] = all_.argmax(axis=1)
        best = np.take_along_axis(all_, back[t][:, None, :].astype(np.int64), axis=1)[:, 0] + scores[:, t]
    out = np.zeros((windows, places), dtype=np.int8)
    out[:, -1] = best.argmax(axis=1)
    row = np.arange(windows)
    for t in range(places - 1, 0, -1):
        out[:, t - 1] = back[t][row, out[:, t]]
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def crf(scores: np.ndarray, tags: np.ndarray, step: np.ndarray, allowed: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient of scores, gradient of step): the mean negative log-likelihood of ``tags``, by forward-backward."""
    windows, places, _ = scores.shape
    move, row = step + allowed, np.arange(windows)
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0] + allowed[0]
    for t in range(1, places):
        ahead[:, t] = _log_sum(ahead[:, t - 1][:, :, None] + move, 1) + scores[:, t]
    for t in range(places - 2, -1, -1):
        behind[:, t] = _log_sum(move + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
    total = _log_sum(ahead[:, -1], 1)
    gold = scores[row[:, None], np.arange(places), tags].sum(axis=1) + move[tags[:, :-1], tags[:, 1:]].sum(axis=1)
    d_scores = np.exp(ahead + behind - total[:, None, None])
    d_step = np.zeros_like(step)
    for t in range(1, places):
        d_step += np.exp(ahead[:, t - 1][:, :, None] + move + (scores[:, t] + behind[:, t])[:, None, :] - total[:, None, None]).sum(axis=0)
    d_scores[row[:, None], np.arange(places), tags] -= 1
    np.subtract.at(d_step, (tags[:, :-1], tags[:, 1:]), 1)
    return float((total - gold).mean()), d_scores / windows, d_step / windows


def gradients(weights: dict[str, np.ndarray], classes: np.ndarray, tags: np.ndarray, allowed: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The loss of labelled windows and its gradient for each table of weights."""
    turned = classes[:, ::-1]
    ahead, behind = _read(classes, weights["in_f"], weights["rec_f"], True), _read(turned, weights["in_b"], weights["rec_b"], True)
    both = np.concatenate([ahead[0][1:], behind[0][:0:-1]], axis=2)
    loss, d_scores, d_step = crf((both @ weights["out"] + weights["bias"]).transpose(1, 0, 2).astype(np.float64), tags, weights["step"].astype(np.float64), allowed)
    d_scores = d_scores.transpose(1, 0, 2).astype(np.float32)
    grads = {k: np.zeros_like(v) for k, v in weights.items()}
    grads["step"] += d_step.astype(np.float32)
    grads["out"] += np.einsum("tbh,tbk->hk", both, d_scores)
    grads["bias"] += d_scores.sum(axis=(0, 1))
    d_both = d_scores @ weights["out"].T
    hidden = len(weights["rec_f"])
    _read_back(classes, weights["rec_f"], *ahead, d_both[:, :, :hidden], grads["in_f"], grads["rec_f"])
    _read_back(turned, weights["rec_b"], *behind, d_both[::-1, :, hidden:], grads["in_b"], grads["rec_b"])
    return loss, grads


def train(classes: np.ndarray, tags: np.ndarray, n_classes: int, allowed: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights fitted to labelled windows (classes and tags, window x place) by Adam with a falling rate."""
    weights = start_weights(n_classes, len(allowed), hidden, seed)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    draw, n = np.random.default_rng(seed), len(classes)
    steps, at = epochs * -(-n // BATCH), 0
    for _ in range(epochs):
        order = draw.permutation(n)
        for lo in range(0, n, BATCH):
            mine = order[lo : lo + BATCH]
            _, grads = gradients(weights, classes[mine], tags[mine], allowed)
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            at += 1
            rate = RATE * (1 - (at - 1) / steps)
            for k, g in grads.items():
                g *= min(1.0, 5.0 / max(size, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                weights[k] -= rate * (first[k] / (1 - 0.9**at)) / (np.sqrt(second[k] / (1 - 0.99**at)) + 1e-8)
    return weights
