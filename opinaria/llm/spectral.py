"""Leading eigenvectors of a symmetric matrix by polar decompositions (QDWH) and divide and conquer.

The polar factor of A - sI is the matrix sign function: half of it plus half of I projects onto the
invariant subspace of the eigenvalues above s. Bases of it and of its complement split A into two
smaller matrices, and so on down to single components. Only parts that hold wanted components are
split further.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
MOST_ROUNDS = 40


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley steps with QR.

    ``least`` is a lower bound of the least singular value, from which the weights follow. A
    direction that is singular to working precision stays between -1 and 1; the caller sees that.
    """
    size = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.zeros_like(a)
    x, eye = a / norm, np.eye(size)
    try:
        least = 1.0 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        least = EPS
    least = min(1.0, max(EPS, least if np.isfinite(least) else EPS))
    for _ in range(MOST_ROUNDS):
        square = least * least
        d = np.cbrt(4.0 * (1.0 - square) / (square * square))
        root = np.sqrt(1.0 + d)
        a1 = root + 0.5 * np.sqrt(8.0 - 4.0 * d + 8.0 * (2.0 - square) / (square * root))
        b1 = (a1 - 1.0) ** 2 / 4.0
        c1 = a1 + b1 - 1.0
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c1) * x, eye]))
        new = (b1 / c1) * x + ((a1 - b1 / c1) / np.sqrt(c1)) * (q[:size] @ q[size:].T)
        new = (new + new.T) / 2.0
        least = min(1.0, least * (a1 + b1 * square) / (1.0 + c1 * square))
        change = np.linalg.norm(new - x)
        x = new
        if abs(1.0 - least) <= 10 * EPS and change <= np.cbrt(5 * EPS):
            break
    return x


def range_basis(projector: np.ndarray, rank: int) -> np.ndarray:
    """An orthonormal basis of a projector's range: pivoted choice of columns, then a second pass."""
    rest, chosen = projector.copy(), []
    for _ in range(rank):
        at = int(np.argmax(np.einsum("ij,ij->j", rest, rest)))
        column = rest[:, at] / np.linalg.norm(rest[:, at])
        chosen.append(column)
        rest -= np.outer(column, column @ rest)
    q, _ = np.linalg.qr(np.stack(chosen, axis=1))
    q, _ = np.linalg.qr(projector @ q)
    return q


def divide(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None for a multiple of the identity.

    Shifts near an eigenvalue separate badly, so several are tried and the cleanest cut counts.
    """
    size, scale = len(a), np.linalg.norm(a)
    diagonal = np.diagonal(a)
    mean = diagonal.mean()
    spread = np.linalg.norm(a - mean * np.eye(size))
    if spread <= 4 * size * EPS * scale:
        return None
    unit = spread / np.sqrt(size)
    best = None
    for shift in (np.median(diagonal), mean, *(mean + f * unit for f in (0.25, -0.25, 0.5, -0.5, 0.75, -0.75, 0.1, -0.1))):
        projector = (polar_factor(a - shift * np.eye(size)) + np.eye(size)) / 2.0
        rank = round(float(np.trace(projector)))
        if not 0 < rank < size:
            continue
        above = range_basis(projector, rank)
        below = range_basis(np.eye(size) - above @ above.T, size - rank)
        left_over = np.linalg.norm(below.T @ a @ above)
        if best is None or left_over < best[0]:
            best = left_over, above, below
        if left_over <= 10 * size * EPS * scale:
            break
    return None if best is None else best[1:]


def eigen(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues, falling, and their unit vectors as columns; at least ``wanted`` of them."""
    size = len(a)
    if size == 0:
        return np.zeros(0), np.zeros((0, 0))
    cut = divide(a) if size > 1 else None
    if cut is None:
        return np.full(size, np.diagonal(a).mean()), np.eye(size)
    above, below = cut
    values, vectors = eigen(_part(a, above), wanted)
    vectors = above @ vectors
    if len(values) < wanted:
        more, rest = eigen(_part(a, below), wanted - above.shape[1])
        values, vectors = np.concatenate([values, more]), np.concatenate([vectors, below @ rest], axis=1)
    return values, vectors


def _part(a: np.ndarray, basis: np.ndarray) -> np.ndarray:
    part = basis.T @ a @ basis
    return (part + part.T) / 2.0


def leading(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues that are not zero to working precision, and their vectors.

    The entry of a vector that is largest in magnitude is positive.
    """
    values, vectors = eigen((a + a.T) / 2.0, wanted)
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[order], vectors[:, order]
    kept = values > len(a) * EPS * max(float(np.trace(a)), 0.0)
    values, vectors = values[kept], vectors[:, kept]
    if vectors.size:
        signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
        vectors = vectors * signs
    return values, vectors
