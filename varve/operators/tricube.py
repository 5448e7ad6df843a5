"""Array arithmetic of local regression, used inside Spark tasks on bounded arrays.

A target is a place ``x`` with the radius of its neighbourhood. With ``u`` the signed distance of a
source from the target in radii, a fit needs five weighted sums: of 1, u, u*u, y and u*y.
"""

from __future__ import annotations

from math import comb

import numpy as np

# Distances up to NEAR count as none, from FAR on as outside.
NEAR, FAR = 0.001, 0.999
# Spread of the weighted sources, in squared radii, from which rounding cannot be told apart.
FLAT = 1e-13
LEAST_SPREAD = 1e-12
CELLS = 1 << 15
POWERS = 12
BLOCK = 64


def pair_sums(x, radius, source_x, weight, weight_y):
    """The five sums, one source after the other."""
    sums = np.zeros((5, len(x)))
    step = max(1, CELLS // max(1, len(source_x)))
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        sums[:, part] = weighted_sums(*pair_weights(x[part], radius[part], source_x), weight, weight_y)
    return sums


def pair_weights(x, radius, source_x):
    """What the sums take of each source for each target, whatever the weight of the source: 1, u and u*u, weighed."""
    with np.errstate(divide="ignore", invalid="ignore"):
        u = (source_x[None, :] - x[:, None]) / radius[:, None]
    u[np.isnan(u)] = 0.0
    d = np.abs(u)
    inside = d < FAR
    u[~inside] = 0.0
    d[~inside] = 1.0
    tricube = (1.0 - d * d * d) ** 3
    tricube[d <= NEAR] = 1.0
    lever = tricube * u
    return tricube, lever, lever * u


def weighted_sums(tricube, lever, square, weight, weight_y):
    return np.stack([tricube @ weight, lever @ weight, square @ weight, tricube @ weight_y, lever @ weight_y])


def _powers(values):
    powers = np.ones((*values.shape, POWERS))
    for p in range(1, POWERS):
        np.multiply(powers[..., p - 1], values, out=powers[..., p])
    return powers


def moments(x, center, half, weight, weight_y):
    """Power sums of the sources about ``center`` in units of ``half``: of the weights, then of y."""
    z = _powers((x - center) / half)
    return np.concatenate([weight @ z, weight_y @ z])


def _expansion(side):
    """Coefficients that turn powers of t into those of z for tricube(u) * u**q, u = t + e * z.

    On one side of the target (``side`` -1 or 1) the tricube weight is a polynomial in u of degree
    9, so its expansion is finite and exact; for ``side`` 0 the weight is 1.
    """
    weight = {0: 1, 3: -3 * side, 6: 3 * side * side, 9: -side}
    table = np.zeros((POWERS, 3 * POWERS))
    for q in range(3):
        for degree, factor in weight.items():
            for j in range(degree + q + 1):
                table[degree + q - j, q * POWERS + j] += factor * comb(degree + q, j)
    return table


EXPANSIONS = {side: _expansion(side) for side in (-1, 0, 1)}


def node_sums(x, radius, side, center, half, node_moments):
    """The five sums from whole nodes of sources, each on one ``side`` of every target."""
    sums = np.zeros((5, len(x)))
    for which, table in EXPANSIONS.items():
        chosen = np.flatnonzero(side == which)
        step = max(1, CELLS // (POWERS * max(1, len(x))))
        for at in range(0, len(chosen), step):
            nodes = chosen[at : at + step]
            t = _powers((center[nodes] - x[:, None]) / radius[:, None])
            e = _powers(half[nodes] / radius[:, None])
            of_weight, of_y = node_moments[nodes, :POWERS], node_moments[nodes, POWERS:]
            for q in range(3):
                terms = (t @ table[:, q * POWERS : (q + 1) * POWERS]) * e
                sums[q] += np.einsum("tnj,nj->t", terms, of_weight)
                if q < 2:
                    sums[3 + q] += np.einsum("tnj,nj->t", terms, of_y)
    return sums


def fitted(sums, radius, own_y):
    """Value at each target of the line through its weighted neighbours."""
    total = sums[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean, square, mean_y, cross = sums[1:] / total
        spread = square - mean * mean
        slope = (cross - mean * mean_y) * radius**2 / np.maximum(spread * radius**2, LEAST_SPREAD)
        fit = mean_y - mean * np.where(spread <= FLAT, 0.0, slope)
    return np.where(total > 0, fit, own_y)


def neighbours(n, frac):
    return min(max(int(frac * n + 1e-10), 2), n)


def all_sums(places, radius, weight, weight_y):
    """The five sums at every place of a sorted series, by pairs near a change of the weights and by
    whole blocks elsewhere."""
    starts = np.arange(0, len(places), BLOCK)
    blocks = [slice(a, a + BLOCK) for a in starts]
    low = places[starts]
    high = places[np.append(starts[1:], len(places)) - 1]
    center, half = (low + high) / 2, np.where(high > low, (high - low) / 2, 1.0)
    power_sums = np.stack([moments(places[b], c, h, weight[b], weight_y[b]) for b, c, h in zip(blocks, center, half)])
    sums = np.empty((5, len(places)))
    for part in blocks:
        edges = places[part] + np.outer((-FAR, -NEAR, NEAR, FAR), radius[part])
        after = np.searchsorted(low, edges.max(axis=1), side="right")
        until = np.maximum(np.searchsorted(low, edges.min(axis=1), side="right") - 1, 0)
        side = np.full(len(blocks), 2)
        side[: until[0]] = side[after[3] :] = 3
        for zone, which in enumerate((-1, 0, 1)):
            side[after[zone] : until[zone + 1]] = which
        near = np.repeat(side == 2, BLOCK)[: len(places)]
        whole = side < 2
        sums[:, part] = pair_sums(places[part], radius[part], places[near], weight[near], weight_y[near])
        sums[:, part] += node_sums(places[part], radius[part], side[whole], center[whole], half[whole], power_sums[whole])
    return sums


def chosen(places, delta):
    """Where the line is fitted: the first place, and each last one within ``delta``, or next one, of it."""
    at = [0]
    while at[-1] < len(places) - 1:
        at.append(max(at[-1] + 1, int(np.searchsorted(places, places[at[-1]] + delta, side="right")) - 1))
    return np.array(at)


def smooth(x, y, copies, frac, passes, delta=0.0):
    """Distinct x of one bounded series, in order, and the robust local regression at each."""
    x, y = np.repeat(x, copies), np.repeat(y, copies)
    places, group, counts = np.unique(x, return_inverse=True, return_counts=True)
    own_y = np.full(len(places), np.inf)
    np.minimum.at(own_y, group, y)
    n = len(x)
    k = neighbours(n, frac)
    ordered = np.repeat(places, counts)
    left = np.searchsorted((ordered[: n - k] + ordered[k:]) / 2, places, side="left")
    radius = np.maximum(places - ordered[left], ordered[left + k - 1] - places)
    at = chosen(places, delta) if delta > 0 else None
    # The pairs of a few places stay the same in all passes.
    pairs = pair_weights(places, radius, places) if len(places) <= 4 * BLOCK else None
    robust = np.ones(n)
    for again in range(passes + 1):
        weight, weight_y = np.bincount(group, robust), np.bincount(group, robust * y)
        sums = weighted_sums(*pairs, weight, weight_y) if pairs else all_sums(places, radius, weight, weight_y)
        fit = fitted(sums, radius, own_y)
        if delta > 0:
            fit = np.interp(places, places[at], fit[at])
        if again < passes:
            rest = np.abs(y - fit[group])
            middle = np.median(rest)
            ratio = rest / (6 * middle) if middle > 0 else (rest > 0).astype(float)
            robust = np.where(ratio <= NEAR, 1.0, np.where(ratio >= FAR, 0.0, (1 - ratio * ratio) ** 2))
    return places, fit
