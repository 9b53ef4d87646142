"""Largest eigenpairs of a symmetric matrix by contour integration (FEAST), checked by inertia.

The spectral projector of an interval is a contour integral of the resolvent. A quadrature of it,
one complex shifted solve per node, applied to a few vectors gives a basis of the interval's
eigenvectors, from which Rayleigh-Ritz extracts them. How many there must be is known beforehand:
by Sylvester's law of inertia the factors of a shifted matrix tell how many eigenvalues lie below
the shift.
"""

from __future__ import annotations

import numpy as np

#: Nodes on the half circle, and eigenvalues that an interval holds at most unless they coincide.
NODES = 8
PER_INTERVAL = 10
ROUNDS = 30
#: Share of the trace that counts as no variance, and residual (of the trace) of a finished pair.
FLAT = 1e-12
RESIDUAL = 1e-14
PIVOT = (1 + 17**0.5) / 8


def below(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are smaller than ``shift``: negative pivots of a symmetric elimination.

    The largest entry left decides between a pivot of one row and one of two rows; the latter has
    one negative eigenvalue.
    """
    rest = matrix - shift * np.eye(len(matrix))
    found = 0
    while len(rest):
        size = len(rest)
        diagonal = np.abs(np.diag(rest))
        p = int(diagonal.argmax())
        off = np.abs(rest - np.diag(np.diag(rest)))
        i, j = divmod(int(off.argmax()), size)
        if diagonal[p] >= PIVOT * off[i, j]:
            if diagonal[p] == 0:
                return found
            found += bool(rest[p, p] < 0)
            taken = [p]
        else:
            found += 1
            taken = [i, j]
        left = np.delete(np.arange(size), taken)
        side = rest[np.ix_(left, taken)]
        rest = rest[np.ix_(left, left)] - side @ np.linalg.solve(rest[np.ix_(taken, taken)], side.T)
        rest = (rest + rest.T) / 2
    return found


def middle(matrix: np.ndarray, low: float, high: float, wanted: tuple[int, int]) -> tuple[float, int]:
    """A shift between ``low`` and ``high`` with as many eigenvalues below it as ``wanted`` allows.

    Where eigenvalues coincide there may be none; then it is the nearest shift under them.
    """
    width = (high - low) * 1e-10 + max(abs(low), abs(high)) * 1e-13
    count = below(matrix, low)
    while high - low > width:
        shift = (low + high) / 2
        now = below(matrix, shift)
        if wanted[0] <= now <= wanted[1]:
            return shift, now
        if now < wanted[0]:
            low, count = shift, now
        else:
            high = shift
    return low, count


def intervals(matrix: np.ndarray, low: float, high: float, before: int, after: int) -> list[tuple]:
    """``(low, high, eigenvalues inside)`` of adjoining intervals with few eigenvalues each."""
    count = after - before
    if count <= PER_INTERVAL:
        return [(low, high, count)] if count else []
    slack = max(count // 4, 1)
    half = before + count // 2
    shift, now = middle(matrix, low, high, (half - slack, half + slack))
    if not before < now < after or not low < shift < high:
        return [(low, high, count)]  # they coincide
    return intervals(matrix, low, shift, before, now) + intervals(matrix, shift, high, now, after)


def project(matrix: np.ndarray, low: float, high: float, vectors: np.ndarray) -> np.ndarray:
    """Vectors filtered by the quadrature of the projector onto eigenvalues from low to high."""
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    out = np.zeros_like(vectors)
    for node, weight in zip(nodes, weights, strict=True):
        turn = (high - low) / 2 * np.exp(-0.5j * np.pi * (node - 1))
        shifted = ((low + high) / 2 + turn) * np.eye(len(matrix)) - matrix
        out += weight / 2 * np.real(turn * np.linalg.solve(shifted, vectors.astype(complex)))
    return out


def inside(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs between low and high. Subspaces grow until none is missed."""
    size, scale = len(matrix), float(np.trace(np.abs(matrix))) or 1.0
    width = min(size, count + count // 2 + 4)
    while True:
        vectors, settled = np.random.default_rng(12).standard_normal((size, width)), False
        for _ in range(ROUNDS):
            basis = np.linalg.qr(vectors if width == size else project(matrix, low, high, vectors))[0]
            values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
            vectors = basis @ turned
            chosen = (values >= low) & (values < high)
            residual = np.abs(matrix @ vectors - vectors * values).max(0)
            done = chosen.sum() == count and residual[chosen].max() <= RESIDUAL * scale
            if done and settled:  # a round after the one that sufficed leaves rounding errors only
                return values[chosen], vectors[:, chosen]
            settled = done
            if width == size:
                break
        if width == size:  # all of space: what is left is the rounding of the interval's ends
            near = np.argsort(np.abs(values - np.clip(values, low, high)), kind="stable")[:count]
            return values[near], vectors[:, near]
        width = min(size, 2 * width)


def largest(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a positive semidefinite matrix, falling, and unit vectors.

    Eigenvalues under ``FLAT`` of the trace are none; so there may be fewer.
    """
    size = len(matrix)
    trace = float(np.trace(matrix)) if size else 0.0
    if not trace > 0:
        return np.zeros(0), np.zeros((size, 0))
    matrix = (matrix + matrix.T) / 2
    high = float(np.abs(matrix).sum(1).max()) * (1 + 1e-9)  # no eigenvalue is beyond a row's sum
    low = FLAT * trace
    before = below(matrix, low)
    count = min(count, size - before)
    if size - before > count:
        low, before = middle(matrix, low, high, (max(size - count - 4, before), size - count))
    found = [inside(matrix, *each) for each in intervals(matrix, low, high, before, size)]
    basis = np.linalg.qr(np.concatenate([vectors for _, vectors in found], 1))[0]
    values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
    if len(values) != size - before:
        raise ArithmeticError("eigenpairs are missing")
    order = np.argsort(-values, kind="stable")[:count]
    return values[order], basis @ turned[:, order]
