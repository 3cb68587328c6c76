"""A bidirectional gated recurrent layer in numpy: forward pass, and gradients through time.

Arrays are laid out (units, batch). The input enters as columns of a table of projected inputs: one
column of 3*H values (update, reset, candidate) for each symbol, so that a step only gathers.
Positions beyond a sequence's length leave the state as it is. All are of the type of the recurrent
weights: 8 bytes where training must come out alike whatever the order of sums (it magnifies their
rounding), 4 bytes otherwise.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def init(rng: np.random.Generator, hidden: int) -> np.ndarray:
    return (rng.standard_normal((3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)


def forward(table: np.ndarray, u: np.ndarray, idx: np.ndarray, live: np.ndarray | None, reverse: bool, keep: bool = False):
    """States (T, H, B) of one direction over idx (T, B); live (T, B) masks positions, None: all count.

    With keep, also what backward() needs.
    """
    steps, batch = idx.shape
    hidden = u.shape[1]
    out = np.empty((steps, hidden, batch), u.dtype)
    h = np.zeros((hidden, batch), u.dtype)
    kept = []
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        x = table.take(idx[t], axis=1)
        zr = u[: 2 * hidden] @ h
        zr += x[: 2 * hidden]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:hidden], zr[hidden:]
        rh = r * h
        n = u[2 * hidden :] @ rh
        n += x[2 * hidden :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        if live is not None:
            m = live[t]
            new = np.where(m, new, h)
        if keep:
            kept.append((t, h, z, r, n, rh))
        h = new
        out[t] = h
    return (out, kept) if keep else out


def backward(u: np.ndarray, kept: list, grad: np.ndarray, live: np.ndarray | None):
    """Gradients of u and of the gathered inputs (T, 3H, B), given grad (T, H, B) of the states."""
    hidden = u.shape[1]
    du = np.zeros_like(u)
    dx = np.zeros((grad.shape[0], 3 * hidden, grad.shape[2]), u.dtype)
    carry = np.zeros(grad.shape[1:], u.dtype)
    for t, h, z, r, n, rh in reversed(kept):
        d = grad[t] + carry
        through = 0.0
        if live is not None:
            m = live[t].astype(u.dtype)
            through, d = d * (1 - m), d * m
        dz = d * (h - n) * z * (1 - z)
        dn = d * (1 - z) * (1 - n * n)
        drh = u[2 * hidden :].T @ dn
        dr = drh * h * r * (1 - r)
        x = dx[t]
        x[:hidden], x[hidden : 2 * hidden], x[2 * hidden :] = dz, dr, dn
        du[: 2 * hidden] += x[: 2 * hidden] @ h.T
        du[2 * hidden :] += dn @ rh.T
        carry = d * z + drh * r + u[: 2 * hidden].T @ x[: 2 * hidden] + through
    return du, dx


def scatter(dx: np.ndarray, idx: np.ndarray, symbols: int) -> np.ndarray:
    """Sums gathered gradients (T, 3H, B) back into the table (3H, symbols)."""
    flat = idx.ravel()
    rows = dx.transpose(1, 0, 2).reshape(dx.shape[1], -1)
    return np.stack([np.bincount(flat, weights=row, minlength=symbols) for row in rows]).astype(dx.dtype)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.rate, self.n = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.n += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, clip / (norm + 1e-12))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            params[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.99**self.n)) + 1e-8)).astype(params[k].dtype)
