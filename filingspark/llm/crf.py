"""Linear-chain conditional random fields: forward-backward over many sequences at once, and fitting.

All sequences stand one after another in one array; `first` marks where each begins. The array is
cut into blocks of equal length. One pass multiplies each block's transfer matrices, side by side
for all blocks; a short loop then carries the forward and backward vectors from block to block, and
a last pass fills them in. At a sequence's first position the transition matrix is replaced by one
whose rows are all the start distribution, which cuts the chain there. The result is exact.

A chain too long to hold is labelled in parts (`posteriors`): a first pass carries the forward
vector over all parts, a second one goes through them from the last and carries the backward vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

BLOCK = 48


def _blocks(scores: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Emissions and heads in blocks, the two exponentials, and each block's transfer matrix."""
    n, k = scores.shape
    t_mat, s_vec = np.exp(trans - trans.max()), np.exp(start - start.max())
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    b = -(-n // BLOCK)
    full = np.ones((b * BLOCK, k))
    full[:n] = e
    heads = np.ones(b * BLOCK, dtype=bool)
    heads[:n] = first
    inside = np.zeros(b * BLOCK, dtype=bool)
    inside[:n] = True
    full, heads, inside = full.reshape(b, BLOCK, k), heads.reshape(b, BLOCK), inside.reshape(b, BLOCK)
    m = np.tile(np.eye(k), (b, 1, 1))
    for t in range(BLOCK):
        step = m @ t_mat
        if (h := np.flatnonzero(heads[:, t])).size:
            step[h] = m[h].sum(axis=2, keepdims=True) * s_vec
        step *= full[:, t, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        if t >= BLOCK - (b * BLOCK - n):  # what fills the last block up changes nothing
            step[-1] = m[-1]
        m = step
    return e, full, heads, inside, t_mat, s_vec, m


def _enter(m: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forward vector before each block, and behind the last."""
    enter = np.empty((len(m), len(v)))
    for i in range(len(m)):
        enter[i] = v
        v = v @ m[i]
        v = v / v.sum()
    return enter, v


def carried(scores: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The forward vector behind the last position, from that before the first."""
    return _enter(_blocks(scores, first, trans, start)[-1], v)[1] if len(scores) else v


def marginals(scores: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Label marginals [N, L] from log scores [N, L]; with pairs also the expected transitions."""
    k = scores.shape[1]
    if not len(scores):
        return np.zeros((0, k)), np.zeros((k, k)) if pairs else None
    out, xi, _ = _marginals(scores, first, trans, start, np.full(k, 1.0 / k), np.full(k, 1.0 / k), pairs)
    return out, xi


def posteriors(part: Callable[[int], tuple[np.ndarray, np.ndarray]], parts: int, trans: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number, marginals) of the parts, the last first. part(i): the scores and firsts of a part;
    it is called twice for each if there are several."""
    k = len(start)
    v = np.full(k, 1.0 / k)
    enters = [v]
    for i in range(parts - 1):
        v = carried(*part(i), trans, start, v)
        enters.append(v)
    leave = np.full(k, 1.0 / k)
    for i in range(parts - 1, -1, -1):
        scores, first = part(i)
        if len(scores):
            out, _, leave = _marginals(scores, first, trans, start, enters[i], leave, False)
            yield i, out


def _marginals(scores: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, v: np.ndarray, w: np.ndarray, pairs: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Marginals, expected transitions, and the backward vector before the first position. v, w: the
    forward vector before the first position, the backward one behind the last."""
    n, k = scores.shape
    e, full, heads, inside, t_mat, s_vec, m = _blocks(scores, first, trans, start)
    b = len(m)
    enter, _ = _enter(m, v)
    leave = np.empty((b, k))
    v = w
    for i in range(b - 1, -1, -1):
        leave[i] = v
        v = m[i] @ v
        v = v / v.sum()
    before = v
    alpha, beta = np.empty((b, BLOCK, k)), np.empty((b, BLOCK, k))
    v = enter
    for t in range(BLOCK):
        new = v @ t_mat
        if (h := np.flatnonzero(heads[:, t])).size:
            new[h] = s_vec
        new *= full[:, t]
        v = alpha[:, t] = new / new.sum(axis=1, keepdims=True)
    v = leave
    for t in range(BLOCK - 1, -1, -1):
        beta[:, t] = v
        w = full[:, t] * v
        new = w @ t_mat.T
        if (h := np.flatnonzero(heads[:, t])).size:
            new[h] = 1.0
        new /= new.sum(axis=1, keepdims=True)
        v = np.where(inside[:, t, None], new, v)
    alpha, beta = alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n]
    out = alpha * beta
    out /= out.sum(axis=1, keepdims=True)
    if not pairs:
        return out, None, before
    inner = np.flatnonzero(~first[1:]) + 1
    xi = alpha[inner - 1][:, :, None] * t_mat * (e[inner] * beta[inner])[:, None, :]
    xi /= xi.sum(axis=(1, 2), keepdims=True)
    return out, xi.sum(axis=0), before


def fit(emit: Callable[[list[np.ndarray]], np.ndarray], pull: Callable[[np.ndarray], list[np.ndarray]], weights: list[np.ndarray], labels: np.ndarray, first: np.ndarray, k: int, *, rounds: int, rate: float, l2: float) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Maximise the conditional likelihood with full-batch Adam steps. emit gives scores from the
    weights; pull carries a gradient of the scores back to the weights."""
    n = max(1, len(labels))
    truth = np.eye(k)[labels]
    inner = np.flatnonzero(~first[1:]) + 1
    counts = np.zeros((k, k))
    np.add.at(counts, (labels[inner - 1], labels[inner]), 1)
    starts = truth[first].sum(axis=0)
    params = [*weights, np.zeros((k, k)), np.zeros(k)]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for i in range(1, rounds + 1):
        p, xi = marginals(emit(params[:-2]), first, params[-2], params[-1], pairs=True)
        grads = [*pull((truth - p) / n), (counts - xi) / n, (starts - p[first].sum(axis=0)) / n]
        for j, g in enumerate(grads):
            g = g - (l2 / n) * params[j]
            m1[j] = 0.9 * m1[j] + 0.1 * g
            m2[j] = 0.99 * m2[j] + 0.01 * g * g
            params[j] = params[j] + (rate * (1 - 0.9 * (i - 1) / rounds) * (m1[j] / (1 - 0.9**i)) / (np.sqrt(m2[j] / (1 - 0.99**i)) + 1e-12)).astype(params[j].dtype)
    return params[:-2], params[-2], params[-1]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; x has a column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + (l2 * len(y) + 1e-6) * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - l2 * len(y) * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w
