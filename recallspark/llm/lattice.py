"""Nearest points of the E8 lattice, and lattice cells of vectors by random projections."""

from __future__ import annotations

import numpy as np

from .bagminhash import MASK, U, mix

TABLES = 40
BLOCKS = 2  #: E8 codes that together are a cell
PROBES = 4  #: cells of a vector in a table, its own among them
#: Scale of a unit vector: a pair of cosine 0.9 meets in some table with a probability of 0.97, one of
#: 0.95 with 0.9999, unrelated ones with 1e-4.
WIDTH = 0.65


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest point of D8 (whole numbers of even sum) to each row."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest point of E8, nearest point of its other half), both doubled so that they are whole numbers."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    first = (((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None]
    return np.where(first, 2 * a, 2 * b).astype(np.int64), np.where(first, 2 * b, 2 * a).astype(np.int64)


def projections(dimensions: int, seed: int = 20) -> np.ndarray:
    """TABLES x BLOCKS random projections to eight dimensions, the same on every machine."""
    bits = mix(np.arange(TABLES * BLOCKS * 8 * dimensions * 2, dtype=U) + U(seed << 40))
    u = ((bits >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
    normal = np.sqrt(-2 * np.log(u[0::2])) * np.cos(2 * np.pi * u[1::2])
    return normal.reshape(TABLES, BLOCKS, 8, dimensions)


def _hash(points: np.ndarray, table: int, dimensions: int) -> np.ndarray:
    h = np.full(len(points), (table * 4096 + dimensions + 1) * 0x9E3779B97F4A7C15 & MASK, U)
    for k in range(points.shape[1]):
        h = mix(h ^ points[:, k].astype(np.int64).view(U))
    return (h >> U(32)).astype(np.uint32)


def cells(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """len(unit) x TABLES x PROBES cell numbers (32 bits, in each table its own) of unit vectors, a vector's own cell first.

    The others are the neighbouring cells: the nearest point of the lattice's other half taken in one
    code, or in both.
    """
    out = np.zeros((len(unit), TABLES, PROBES), np.uint32)
    for t in range(TABLES):
        codes = [nearest(unit @ planes[t, b].T * WIDTH) for b in range(BLOCKS)]
        for p in range(PROBES):
            pick = [codes[b][p >> b & 1] for b in range(BLOCKS)]
            out[:, t, p] = _hash(np.hstack(pick), t, unit.shape[1])
    return out
