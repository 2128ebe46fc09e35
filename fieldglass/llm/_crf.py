"""Linear-chain conditional random fields in numpy, many chains at once.

Chains lie one behind the other; a flag marks each chain's first unit.  There
the transition matrix is replaced by the start vector, which forgets what came
before, so a batch of chains is one sequence of matrices.  It is cut into
blocks: the blocks' matrix products are made in step, a short pass links the
blocks, and the messages within blocks are made in step again.  This is exact.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


def _scaled(a: np.ndarray, axes) -> np.ndarray:
    return a / np.maximum(a.sum(axis=axes, keepdims=True), 1e-300)


def forward_backward(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, expect: bool = False):
    """Marginals of every unit; with ``expect`` also expected transitions.

    emit: (n, k) log potentials; first: n flags; trans, start: log potentials.
    """
    n, k = emit.shape
    if not n:
        return (emit, np.zeros((k, k))) if expect else emit
    nb = -(-n // BLOCK)
    e = np.ones((nb * BLOCK, k))
    e[:n] = np.exp(emit - emit.max(axis=1, keepdims=True))
    f = np.ones(nb * BLOCK, bool)
    f[:n] = first
    f[0] = True
    e = np.ascontiguousarray(e.reshape(nb, BLOCK, k).transpose(1, 0, 2))
    f = np.ascontiguousarray(f.reshape(nb, BLOCK).T)
    t, s = np.exp(trans), np.exp(start)
    # products of the blocks' matrices
    p = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for i in range(BLOCK):
        q = (p.reshape(-1, k) @ t).reshape(nb, k, k)
        if f[i].any():
            q[f[i]] = p[f[i]].sum(axis=2, keepdims=True) * s
        p = _scaled(q * e[i][:, None, :], (1, 2))
    enter = np.empty((nb, k))
    leave = np.empty((nb, k))
    v = np.full(k, 1 / k)
    for b in range(nb):
        enter[b] = v
        v = v @ p[b]
        v = v / v.sum()
    v = np.ones(k)
    for b in range(nb - 1, -1, -1):
        leave[b] = v
        v = p[b] @ v
        v = v / v.sum()
    alpha = np.empty((BLOCK, nb, k))
    a = enter
    for i in range(BLOCK):
        m = a @ t
        if f[i].any():
            m[f[i]] = a[f[i]].sum(axis=1, keepdims=True) * s
        a = _scaled(m * e[i], 1)
        alpha[i] = a
    beta = np.empty((BLOCK, nb, k))
    b_ = leave
    for i in range(BLOCK - 1, -1, -1):
        beta[i] = b_
        w = b_ * e[i]
        m = w @ t.T
        if f[i].any():
            m[f[i]] = (w[f[i]] @ s)[:, None]
        b_ = _scaled(m, 1)
    flat = lambda x: x.transpose(1, 0, 2).reshape(-1, k)[:n]
    alpha, beta = flat(alpha), flat(beta)
    gamma = _scaled(alpha * beta, 1)
    if not expect:
        return gamma
    inner = np.flatnonzero(~np.asarray(first[1:], bool)) + 1
    left = alpha[inner - 1]
    right = beta[inner] * flat(e)[inner]
    z = ((left @ t) * right).sum(axis=1, keepdims=True)
    return gamma, (left / np.maximum(z, 1e-300)).T @ right * t


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        """Go uphill."""
        self.t += 1
        for name, g in grads.items():
            m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * g
            v = self.v[name] = 0.99 * self.v.get(name, 0) + 0.01 * g * g
            params[name] += self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def ragged_sum(table: np.ndarray, index: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of table rows index[begin[i] : begin[i + 1]]; none of the runs is empty."""
    return np.add.reduceat(table[index], begin[:-1], axis=0) if len(begin) > 1 else np.zeros((0, table.shape[1]))


def ragged_back(grad: np.ndarray, index: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    rows = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    return np.stack([np.bincount(index, weights=grad[rows, j], minlength=size) for j in range(grad.shape[1])], axis=1)
