"""Exact products of integer matrices by Strassen's seven half-size products.

All is 64-bit arithmetic modulo 2^64, so a product is right wherever its own entries fit, whatever the sums in between.
"""

from __future__ import annotations

import numpy as np

LEAF = 16


def _padded(a: np.ndarray, rows: int, columns: int) -> np.ndarray:
    if a.shape == (rows, columns):
        return a
    out = np.zeros((rows, columns), np.int64)
    out[: a.shape[0], : a.shape[1]] = a
    return out


def multiply(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The int64 product of a (m x k) and b (k x n); odd halves are padded with zeros."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    p, q, r = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    a, b = _padded(a, 2 * p, 2 * q), _padded(b, 2 * q, 2 * r)
    a11, a12, a21, a22 = a[:p, :q], a[:p, q:], a[p:, :q], a[p:, q:]
    b11, b12, b21, b22 = b[:q, :r], b[:q, r:], b[q:, :r], b[q:, r:]
    m1 = multiply(a11 + a22, b11 + b22, leaf)
    m2 = multiply(a21 + a22, b11, leaf)
    m3 = multiply(a11, b12 - b22, leaf)
    m4 = multiply(a22, b21 - b11, leaf)
    m5 = multiply(a11 + a12, b22, leaf)
    out = np.empty((2 * p, 2 * r), np.int64)
    out[:p, :r] = m1 + m4 - m5 + multiply(a12 - a22, b21 + b22, leaf)
    out[:p, r:] = m3 + m5
    out[p:, :r] = m2 + m4
    out[p:, r:] = m1 - m2 + m3 + multiply(a21 - a11, b11 + b12, leaf)
    return out[:m, :n]
