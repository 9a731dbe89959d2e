"""SetSketch registers of hashed sets, in numpy.

Each element has ``M`` points on a line, spaced exponentially: the j-th falls into the j-th of ``M`` intervals that an
exponential variable hits equally often, truncated to it, and goes to a register of its own. A register keeps its smallest
point, as a power of ``BASE``. So registers of unions are register-wise maxima, and two sets agree in a register about as
often as they share elements.
"""

from __future__ import annotations

import numpy as np

from tallyloom.llm.common import mix

#: Registers, a power of two; powers closer to 1 agree less often by chance.
M, BASE, RATE, TOP = 256, 1.001, 20.0, (1 << 16) - 2
STEP = np.uint64(0x9E3779B97F4A7C15)


def edges() -> np.ndarray:
    """Ends of the M intervals of an exponential variable of this rate; the last has no end."""
    k = np.arange(M + 1)
    with np.errstate(divide="ignore"):
        return np.log1p(k / (M - k)) / RATE


EDGES = edges()


def registers(elements: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """M registers for each set; ``elements`` holds the hashed sets one after the other, ``starts`` where each begins.
    No set may be empty. An element's points are made one interval at a time and only while they can still matter."""
    sets = len(starts)
    smallest = np.full((sets, M), np.inf)
    owner = np.repeat(np.arange(sets), np.diff(np.append(starts, len(elements))))
    first = mix(elements ^ STEP)
    at, stride = first % np.uint64(M), (mix(first ^ STEP) % np.uint64(M // 2)) * np.uint64(2) + np.uint64(1)
    flat = smallest.reshape(-1)
    for j in range(M):
        with np.errstate(over="ignore"):
            u = (mix(elements + np.uint64(j + 1) * STEP) >> np.uint64(11)) * (1.0 / (1 << 53))
        low = np.exp(-RATE * EDGES[j])
        point = -np.log(low - u * (low - np.exp(-RATE * EDGES[j + 1]) if j < M - 1 else low)) / RATE
        slot = owner * M + ((at + np.uint64(j) * stride) % np.uint64(M)).astype(np.int64)
        np.minimum.at(flat, slot, point)
        open_ = smallest.max(1) > EDGES[j + 1]  # a later point can still be smaller than what some register has
        if not open_.any():
            break
        if not open_.all():
            keep = open_[owner]
            elements, owner, at, stride = elements[keep], owner[keep], at[keep], stride[keep]
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


GRID = np.linspace(0, 1, 201)


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sets by maximum likelihood: from how many registers are larger on either side and how
    many are equal, given both sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)  # no similarity is above the ratio of the sizes
    j = GRID[None, :] * most

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    larger, smaller = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
    equal = np.clip(1 - larger - smaller, 1e-12, 1)
    fit = more * np.log(larger) + less * np.log(smaller) + (M - more - less) * np.log(equal)
    return np.take_along_axis(j, fit.argmax(1)[:, None], 1)[:, 0]
