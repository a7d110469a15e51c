"""BagMinHash: signatures whose share of equal components estimates the weighted Jaccard similarity of multisets.

Each element has a Poisson process over time and over its weight axis; the points below the element's weight count. A point falls
on a random component, and a component keeps its earliest point. Weights are whole numbers, so the axis is cut at 1, 2, 4, 8, ...;
the process of an interval is split in halves, down to unit length, only where a weight ends inside it or once its earliest point is
used: the point goes to one half, the other half gets a fresh process that starts then. All random numbers are hashes of element and
interval, so two multisets see the same points where both have weight. A process whose next point is later than all components of
its document is dropped; most elements of a long document thus cost one point.

Everything is done for all elements of many documents at once, step by step in time.
"""

from __future__ import annotations

import numpy as np

from hushframe.llm.common import U64, mix

_CHILD, _COMPONENT, _NEXT = U64(0xD1B54A32D192ED03), U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25)


def _exponential(bits: np.ndarray) -> np.ndarray:
    return -np.log(((bits >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, owners: int, size: int) -> np.ndarray:
    """owners x size earliest times; inf for a document without elements.

    element: 64-bit hashes, distinct within a document; weight: 1 or more; owner: the document of each.
    """
    best = np.full(owners * size, np.inf)
    latest = np.full(owners, np.inf)
    parts = []
    low, high = 0, 1
    while True:
        own = np.flatnonzero(weight > low)
        if not len(own):
            break
        seed = mix(element[own] ^ mix(np.full(1, high, U64)))
        width = high - low
        parts.append((owner[own], seed, np.full(len(own), low), np.full(len(own), high), weight[own], _exponential(seed) / width, mix(seed ^ _COMPONENT)))
        low, high = high, 2 * high
    if not parts:
        return best.reshape(owners, size)
    doc, seed, low, high, most, time, point = (np.concatenate(x) for x in zip(*parts))
    used, drawn = np.zeros(len(doc), bool), np.zeros(len(doc), U64)
    draws = 2
    while len(doc):
        # use the points of intervals within the weight
        ready = ~used & (high <= most)
        np.minimum.at(best, doc[ready] * size + (point[ready] % U64(size)).astype(np.int64), time[ready])
        used = used | ready
        leaf = high - low == 1
        # unit intervals whose point is used: the next `draws` points at once
        a = np.flatnonzero(leaf & used)
        if len(a):
            steps = mix(seed[a][:, None] + _NEXT * (drawn[a][:, None] + np.arange(1, draws + 1, dtype=U64)[None, :]))
            times = time[a][:, None] + np.cumsum(_exponential(steps), axis=1)
            points = mix(steps ^ _COMPONENT)
            early = times <= latest[doc[a]][:, None]
            np.minimum.at(best, (np.repeat(doc[a], draws).reshape(-1, draws) * size + (points % U64(size)).astype(np.int64))[early], times[early])
            leaves = (doc[a], seed[a], low[a], high[a], most[a], times[:, -1], points[:, -1], np.ones(len(a), bool), drawn[a] + U64(draws))
        # others: halves, one of which has the point
        b = np.flatnonzero(~leaf)
        halves = []
        if len(b):
            middle = (low[b] + high[b]) // 2
            right = (mix(seed[b] ^ _CHILD) & U64(1)).astype(bool)
            for side in (False, True):
                own = mix(seed[b] * U64(2) + U64(side) + _CHILD)
                has = right == side
                start, stop = np.where(side, middle, low[b]), np.where(side, high[b], middle)
                fresh = time[b] + _exponential(own) / (stop - start)
                keep = start < most[b]
                halves.append(tuple(x[keep] for x in (doc[b], own, start, stop, most[b], np.where(has, time[b], fresh), np.where(has, point[b], mix(own ^ _COMPONENT)), np.where(has, used[b], False), drawn[b])))
        waiting = np.flatnonzero(leaf & ~used)  # units beyond the weight: none, as such halves aren't kept
        assert not len(waiting)
        latest = best.reshape(owners, size).max(axis=1)
        parts = halves + ([leaves] if len(a) else [])
        if not parts:
            break
        doc, seed, low, high, most, time, point, used, drawn = (np.concatenate(x) for x in zip(*parts))
        alive = time <= latest[doc]
        doc, seed, low, high, most, time, point, used, drawn = (x[alive] for x in (doc, seed, low, high, most, time, point, used, drawn))
        draws = min(64, 2 * draws)
    return best.reshape(owners, size)
