"""Eigenvectors of a symmetric matrix by mixed precision: a float32 solution corrected by Ogita-Aishima iterations.

One iteration takes approximate eigenvectors X of A (columns) and, with matrix products only, finds the correction
E of X' = X + X E. With R = I - X'X and S = X'AX, the eigenvalues are S_ii / (1 - R_ii); for eigenvalues that are
told apart E_ij = (S_ij + e_j R_ij) / (e_j - e_i), for others E_ij = R_ij / 2, which only restores orthogonality.
The error falls quadratically once it is small against the gaps.

Eigenvalues that lie closer together than the error are a cluster: their columns span the right space, but which
vectors in it belong to which eigenvalue is open. A sub-solve settles that: the matrix minus the middle of the
cluster is projected on the space, the small matrix (scaled by itself, so its differences have all digits) is
solved, and the columns are turned. Iterations and sub-solves alternate until nothing improves. Truly equal eigenvalues keep any
orthonormal basis of their space.

All products are in long double, so the vectors are right to double precision.
"""

from __future__ import annotations

import numpy as np

LONG = np.longdouble


def correction(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, LONG]:
    """Corrected vectors, eigenvalues, the matrix of eigenvalues that count as equal, and the bound used for that."""
    r = np.eye(len(a), dtype=LONG) - x.T @ x
    s = x.T @ (a @ x)
    e = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(e)
    # the spectral norm is at most the largest row sum of a symmetric matrix
    bound = 2 * (np.abs(off).sum(1).max() + np.abs(a).sum(1).max() * np.abs(r).sum(1).max())
    gap = e[None, :] - e[:, None]
    close = np.abs(gap) <= bound
    step = np.where(close, r / 2, (s + e[None, :] * r) / np.where(close, 1, gap))
    return x + x @ step, e, close, bound


def clusters(e: np.ndarray, bound) -> list[np.ndarray]:
    """Groups of two or more neighbouring eigenvalues no further apart than the bound."""
    order = np.argsort(e)
    cut = np.flatnonzero(np.diff(e[order]) > bound) + 1
    return [g for g in np.split(order, cut) if len(g) > 1]


def sub_solve(a: np.ndarray, x: np.ndarray, e: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The columns of a cluster, turned inside their space."""
    part = x[:, group]
    shifted = part.T @ (a @ part - part * e[group].mean())
    scale = np.abs(shifted).max()
    if scale == 0:
        return part
    _, turn = np.linalg.eigh(((shifted + shifted.T) / (2 * scale)).astype(np.float64))
    # a double has fewer digits than the columns
    return part @ orthogonal(turn.astype(LONG))


def orthogonal(x: np.ndarray) -> np.ndarray:
    """One Newton step towards orthonormal columns; x is close to that already."""
    return x @ (1.5 * np.eye(len(x), dtype=LONG) - 0.5 * (x.T @ x))


def residual(a: np.ndarray, x: np.ndarray, e: np.ndarray) -> tuple:
    """The largest entry of AX - Xe and of X'X - I, relative to the matrix."""
    norm = np.abs(a).sum(1).max()
    return np.abs(a @ x - x * e).max() / (norm or 1), np.abs(x.T @ x - np.eye(len(a))).max()


def refined_eigen(a: np.ndarray, most_rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors (columns) of a symmetric matrix, in long double."""
    a = a.astype(LONG)
    scale = np.abs(a).max() if a.size else LONG(0)
    if not scale:
        return np.zeros(len(a), LONG), np.eye(len(a), dtype=LONG)
    a = a / scale
    _, first = np.linalg.eigh(a.astype(np.float32))
    x = first.astype(LONG)
    best = None
    for _ in range(most_rounds):
        x, e, _, bound = correction(a, x)
        for group in clusters(e, bound):
            x[:, group] = sub_solve(a, x, e, group)
        # rounding, divided by a small gap, stays in E and would leave the columns askew
        x = orthogonal(x)
        e = ((x * (a @ x)).sum(0)) / (x * x).sum(0)
        now = max(residual(a, x, e))
        if best is not None and now >= best[0] / 2:
            break
        best = (now, x.copy(), e)
    _, x, e = best if best is not None and best[0] <= now else (now, x, e)
    order = np.argsort(-e, kind="stable")
    x = x[:, order]
    return e[order] * scale, x / np.sqrt((x * x).sum(0))
