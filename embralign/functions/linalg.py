"""Closed forms that finish metrics from moments: small d x d problems on the driver."""

from __future__ import annotations

import numpy as np

TINY = 1e-12


def sym_power(a: np.ndarray, power: float, floor: float = 0.0) -> np.ndarray:
    w, v = np.linalg.eigh((a + a.T) / 2)
    w = np.maximum(w, floor)
    return (v * np.where(w > 0, w, 1) ** power * (w > 0 if power < 0 else 1)) @ v.T if power < 0 else (v * w**power) @ v.T


def sym_log(a: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh((a + a.T) / 2)
    return (v * np.log(np.maximum(w, 1e-300))) @ v.T


def digamma(n: int) -> float:
    """At a positive integer: ten steps up, then the asymptotic series."""
    y = n + 10.0
    return float(np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8) - (1.0 / np.arange(n, n + 10)).sum())


def reduced(c: np.ndarray, threshold: float) -> np.ndarray:
    """Leading eigenvectors of a centred Gram matrix that explain the threshold of the variance."""
    w, v = np.linalg.eigh(c)
    w, v = np.maximum(w[::-1], 0), v[:, ::-1]
    total = w.sum()
    k = int(np.searchsorted(np.cumsum(w / total), threshold)) + 1 if total > 0 else 1
    return v[:, : min(k, len(w))]


def canonical(c11: np.ndarray, c22: np.ndarray, c12: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Canonical correlations of the reduced spaces, and the variance of the first's canonical projections."""
    v1, v2 = reduced(c11, threshold), reduced(c22, threshold)
    s11, s22, s12 = (a / (n - 1) for a in (v1.T @ c11 @ v1, v2.T @ c22 @ v2, v1.T @ c12 @ v2))
    i11 = sym_power(s11 + 1e-8 * np.eye(len(s11)), -0.5)
    i22 = sym_power(s22 + 1e-8 * np.eye(len(s22)), -0.5)
    u, r, _ = np.linalg.svd(i11 @ s12 @ i22)
    a = i11 @ u
    weights = np.einsum("ij,ik,kj->j", a, s11, a) * (n - 1) / n
    return np.clip(r, 0, 1), weights


def gaussian_kl(m1: np.ndarray, s1: np.ndarray, m2: np.ndarray, s2: np.ndarray) -> float:
    d, diff = len(m1), m2 - m1
    inv = np.linalg.inv(s2)
    value = 0.5 * (np.trace(inv @ s1) + diff @ inv @ diff - d + np.linalg.slogdet(s2)[1] - np.linalg.slogdet(s1)[1])
    return float(max(value, 0.0))


def ridge(c11: np.ndarray, c12: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge coefficients (intercept unpenalised); alpha 0 is least squares of smallest norm."""
    if alpha == 0:
        return np.linalg.pinv(c11, rcond=1e-12, hermitian=True) @ c12
    return np.linalg.solve(c11 + alpha * np.eye(len(c11)), c12)


def r2_columns(residual: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 - residual / total by column; a constant column is 1 if met exactly, else 0."""
    flat = total < 1e-12
    return np.where(flat, np.where(residual < 1e-12, 1.0, 0.0), 1 - residual / np.where(flat, 1, total))
