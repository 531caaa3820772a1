"""Independent single-machine solvers of the converged problems (numpy only), used as
the fixed points the distributed ADMM runs must reach."""

import numpy as np


def ridge(blocks, lam):
    """argmin sum_i 1/(2 n_i) ||X_i w - b_i||^2 + lam ||w||^2 (closed form)."""
    p = blocks[0][0].shape[1]
    A = sum(X.T @ X / len(b) for X, b in blocks) + 2 * lam * np.eye(p)
    q = sum(X.T @ b / len(b) for X, b in blocks)
    return np.linalg.solve(A, q)


def lasso(blocks, lam, iters=20000):
    """argmin sum_i 1/(2 n_i) ||X_i w - b_i||^2 + lam ||w||_1 by proximal gradient."""
    p = blocks[0][0].shape[1]
    A = sum(X.T @ X / len(b) for X, b in blocks)
    q = sum(X.T @ b / len(b) for X, b in blocks)
    step = 1.0 / np.linalg.eigvalsh(A).max()
    w = np.zeros(p)
    for _ in range(iters):
        v = w - step * (A @ w - q)
        w = np.sign(v) * np.maximum(np.abs(v) - step * lam, 0.0)
    return w


def logistic_sum_l2(X, y01, lam, weights=None):
    """argmin sum_r c_r log(1 + exp(-y w.x)) + lam ||w||^2 by Newton (c_r = 1 by default)."""
    c = np.ones(len(y01)) if weights is None else weights
    ypm = 2 * y01 - 1
    w = np.zeros(X.shape[1])
    for _ in range(100):
        m = ypm * (X @ w)
        s = 1 / (1 + np.exp(m))
        g = -X.T @ (c * ypm * s) + 2 * lam * w
        H = X.T @ (X * (c * s * (1 - s))[:, None]) + 2 * lam * np.eye(X.shape[1])
        d = np.linalg.solve(H, g)
        w -= d
        if np.linalg.norm(d) < 1e-12:
            break
    return w


def logistic_sum_l1(X, y01, lam, iters=20000):
    """argmin sum log(1 + exp(-y w.x)) + lam ||w||_1 by proximal gradient."""
    ypm = 2 * y01 - 1
    L = 0.25 * np.linalg.eigvalsh(X.T @ X).max()
    w = np.zeros(X.shape[1])
    for _ in range(iters):
        m = ypm * (X @ w)
        g = -X.T @ (ypm / (1 + np.exp(m)))
        v = w - g / L
        w = np.sign(v) * np.maximum(np.abs(v) - lam / L, 0.0)
    return w


def squared_hinge_l2(X, y01, lam, cee=1.0):
    """argmin C sum max(1 - y w.x, 0)^2 + lam ||w||^2 by generalised Newton."""
    ypm = 2 * y01 - 1
    w = np.zeros(X.shape[1])
    for _ in range(200):
        h = 1 - ypm * (X @ w)
        act = h > 0
        g = -2 * cee * X[act].T @ (ypm[act] * h[act]) + 2 * lam * w
        H = 2 * cee * X[act].T @ X[act] + 2 * lam * np.eye(X.shape[1])
        d = np.linalg.solve(H, g)
        w -= d
        if np.linalg.norm(d) < 1e-12:
            break
    return w
