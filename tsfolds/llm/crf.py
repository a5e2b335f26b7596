"""Linear-chain conditional random field in numpy, over many sequences at once.

Sequences lie one after another: ``first`` holds their offsets (one more than sequences).  Step ``t``
handles the ``t``-th element of all sequences that are longer than ``t`` together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    weights: np.ndarray  # features x states
    trans: np.ndarray  # states x states, from row to column


def _steps(first: np.ndarray):
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    starts, size = first[:-1][order], size[order]
    if not len(size) or not size[0]:
        return []
    live = np.searchsorted(-size, -np.arange(size[0]), side="left")  # sequences longer than t
    return [starts[: live[t]] + t for t in range(size[0])]


def forward_backward(emit: np.ndarray, first: np.ndarray, trans: np.ndarray):
    """(marginals, log-likelihood normaliser of all sequences, expected transitions), with each element's
    forward and backward vectors scaled to sum 1."""
    steps = _steps(first)
    top = emit.max(axis=1, keepdims=True) if len(emit) else np.zeros((0, 1))
    psi = np.maximum(np.exp(emit - top), 1e-200)
    e = np.exp(trans)
    alpha, beta, scale = psi.copy(), np.ones_like(psi), np.ones(len(psi))
    for t, rows in enumerate(steps):
        a = psi[rows] if t == 0 else (alpha[steps[t - 1][: len(rows)]] @ e) * psi[rows]
        scale[rows] = a.sum(axis=1)
        alpha[rows] = a / scale[rows][:, None]
    pairs = np.zeros_like(e)
    for prev, rows in zip(steps[-2::-1], steps[:0:-1], strict=False):
        prev = prev[: len(rows)]
        after = psi[rows] * beta[rows] / scale[rows][:, None]
        beta[prev] = after @ e.T
        pairs += alpha[prev].T @ after
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True) if len(p) else 1
    return p, float(np.log(scale).sum() + top.sum()), pairs * e


def viterbi(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best state of each element (of equal paths, the one with the smaller states)."""
    steps = _steps(first)
    best, back = emit.copy(), np.zeros(emit.shape, np.int8)
    for prev, rows in zip(steps, steps[1:], strict=False):
        through = best[prev[: len(rows)]][:, :, None] + trans[None]
        back[rows] = through.argmax(axis=1)
        best[rows] += through.max(axis=1)
    state = np.zeros(len(emit), np.int8)
    last = first[1:][np.diff(first) > 0] - 1
    state[last] = best[last].argmax(axis=1)
    for prev, rows in zip(steps[-2::-1], steps[:0:-1], strict=False):
        state[prev[: len(rows)]] = back[rows, state[rows]]
    return state


def fit(x: np.ndarray, y: np.ndarray, first: np.ndarray, states: int, start: Model | None = None, rounds: int = 120, rate: float = 0.15, ridge: float = 1e-3, forbidden: np.ndarray | None = None, begin: np.ndarray | None = None) -> Model:
    """Maximum likelihood with a ridge, by Adam over all sequences.  ``forbidden`` transitions keep a weight of -50;
    ``begin`` is added to the scores of a sequence's first element."""
    n = max(1, len(x))
    w = start.weights.copy() if start else np.zeros((x.shape[1], states))
    t = start.trans.copy() if start else np.zeros((states, states))
    if forbidden is not None:
        t[forbidden] = -50.0
    inner = np.ones(max(0, len(y) - 1), bool)
    inner[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(y))] - 1] = False
    seen = np.zeros_like(t)
    np.add.at(seen, (y[:-1][inner], y[1:][inner]), 1)
    gold = np.eye(states)[y]
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    heads = first[:-1][np.diff(first) > 0]
    for i in range(1, rounds + 1):
        emit = x @ w
        if begin is not None:
            emit[heads] += begin
        p, _, pairs = forward_backward(emit, first, t)
        gw, gt = x.T @ (gold - p) / n - ridge * w, (seen - pairs) / n - ridge * t
        if forbidden is not None:
            gt[forbidden] = 0
        for par, g, m, v in ((w, gw, mw, vw), (t, gt, mt, vt)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            par += rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return Model(w, t)
