"""DartMinHash: sparse weighted minwise signatures of many sets at a time.

Every element owns one random set of darts over (weight, rank): a Poisson process of density 1, the same wherever the
element occurs. A set catches the darts below its element's weight. Each dart belongs to one of ``k`` coordinates, and a
coordinate keeps the caught dart of lowest rank. Two sets agree in a coordinate with the probability of their weighted
Jaccard similarity.

Ranks are thrown in bands that double in width, for the sets that still have an empty coordinate only. A set of n elements
so costs n plus about k ln k darts, not n times k hashes.
"""

from __future__ import annotations

import math

import numpy as np

from crowdtide.llm.arrays import mix

#: Upper end of the first band of ranks.
FIRST = 1 / 16


def _poisson_levels(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson count, as thresholds of a 64-bit hash."""
    p, total, out, n = math.exp(-mean), 0.0, [], 0
    while total < 1 - 1e-15 and n < 64:
        total += p
        out.append(min(total, 1 - 2**-53))
        n += 1
        p *= mean / n
    return (np.array(out) * 2.0**64).astype(np.uint64)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(element: np.ndarray, weight: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """One row of ``k`` dart ids (uint64) per set; sets without elements get zeros.

    ``element``: uint64 hashes, distinct within a set. ``weight``: positive. ``offsets``: where each set begins and ends.
    """
    n_sets = len(offsets) - 1
    owner = np.repeat(np.arange(n_sets), np.diff(offsets))
    out = np.zeros((n_sets, k), np.uint64)
    filled = np.zeros((n_sets, k), bool)
    # elements by whole layers of weight; the last layer may be a part of one
    layers = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(element)), layers)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(layers) - layers, layers)
    cell = mix(element[at] + layer.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    below = np.minimum(weight[at] - layer, 1.0)
    cell_owner = owner[at]
    low, high, band = 0.0, FIRST, 0
    active = np.diff(offsets) > 0
    while len(cell):
        pieces = max(1, int(high - low))
        mean = (high - low) / pieces
        levels = _poisson_levels(mean)
        for piece in range(pieces):
            own = mix(cell ^ np.uint64(((band << 32) + piece) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            count = np.searchsorted(levels, own, side="right") if len(levels) > 4 else sum((own >= t).astype(np.int64) for t in levels)
            hit = np.flatnonzero(count)
            times = np.repeat(hit, count[hit])
            number = np.arange(len(times)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
            dart = mix(own[times] + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
            caught = _uniform(mix(dart ^ np.uint64(0x5851F42D4C957F2D))) < below[times]
            times, dart = times[caught], dart[caught]
            slot = cell_owner[times] * k + (mix(dart ^ np.uint64(0x14057B7EF767814F)) >> np.uint64(32)).astype(np.int64) % k
            fresh = ~filled.reshape(-1)[slot]
            slot, dart = slot[fresh], dart[fresh]
            rank = dart >> np.uint64(1)  # uniform within the band, and in order
            order = np.lexsort((rank, slot))
            slot, dart = slot[order], dart[order]
            first = np.ones(len(slot), bool)
            first[1:] = slot[1:] != slot[:-1]
            out.reshape(-1)[slot[first]] = dart[first]
            filled.reshape(-1)[slot[first]] = True
        active &= ~filled.all(axis=1)
        keep = active[cell_owner]
        cell, below, cell_owner = cell[keep], below[keep], cell_owner[keep]
        low, high, band = high, high * 2, band + 1
    return out
