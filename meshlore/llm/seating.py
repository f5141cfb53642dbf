"""Blocked Gibbs draws of the number of tables that a dish has in a restaurant.

In a Pitman-Yor restaurant with discount d, all c customers of a dish leave and are
seated anew, given everybody else.  The arrangements of c customers at t tables
weigh S_d(c, t), a generalised Stirling number; each further table costs
(s + d T) P, with T the restaurant's tables and P the parent's probability of the
dish, which grows with every table (a table is a customer of the parent).  So

    p(t) ~ S_d(c, t) * product over i = 1 .. t - 1 of (base + d i) (p0 + p1 i)

with base = s + d T without the dish's own tables.  Up to ``EXACT`` customers the
draw takes all terms.  Beyond, log S_d(c, t) follows from its generating function
(1 - (1 - z)^d)^t by the saddle point z, which gives mode and spread of t; a draw is
then a rounded normal, or takes the terms for few tables where the mode is small.
The work per dish is thereby bounded, however many customers it has.

Random numbers are hashes of the dish's key and the round: draws don't depend on
where a dish is processed.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from .blocks import mix64

#: Customers up to which all numbers of tables are weighed.
EXACT = 64

#: With a mode below this many tables the draw weighs 1 .. 2 * ``FEW`` tables.
FEW = 48

_CELLS = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def uniforms(key: np.ndarray, salt: int) -> np.ndarray:
    """One number in (0, 1) for each key and salt."""
    mixed = mix64(key + mix64(np.full(1, salt, np.uint64) * _GOLDEN + _GOLDEN))
    return ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


@lru_cache(maxsize=8)
def _small(d: float) -> np.ndarray:
    """log S_d(c, t) for c, t <= ``EXACT`` (minus infinity where it is 0)."""
    table = np.full((EXACT + 1, EXACT + 1), -np.inf)
    table[1, 1] = 0.0
    for c in range(1, EXACT):
        t = np.arange(1, c + 1)
        table[c + 1, 1 : c + 1] = np.logaddexp(table[c, 0:c], np.log(c - d * t) + table[c, 1 : c + 1])
        table[c + 1, c + 1] = 0.0
    return table


@lru_cache(maxsize=8)
def _large(d: float) -> tuple[np.ndarray, np.ndarray]:
    """log c at some customers, and log S_d(c, t) - log S_d(c, 1) there for t = 1 .. 2 * ``FEW``."""
    most = 1 << 13
    kept = np.unique(np.geomspace(EXACT, most, 80).astype(np.int64))
    t = np.arange(1, 2 * FEW + 1)
    row, out = np.zeros(len(t)), []
    row[0] = 1.0
    for c in range(1, most + 1):
        if c >= EXACT and c == kept[len(out)]:
            out.append(np.log(np.maximum(row, 1e-300)) - np.log(row[0]))
        grown = (c - d * t) * row
        grown[1:] += row[:-1]
        row = grown / grown.max()
    return np.log(kept.astype(np.float64)), np.array(out)


@lru_cache(maxsize=8)
def _saddle(d: float) -> tuple[np.ndarray, np.ndarray]:
    """log(c / a), ascending, against log(1 - z), where c = a z (1 - z)^(d - 1)."""
    y = np.concatenate([np.geomspace(1e-14, 1e-3, 2000), np.linspace(1.1e-3, 1 - 1e-6, 6000)])
    ratio = np.log1p(-y) + (d - 1) * np.log(y)
    return ratio[::-1], np.log(y)[::-1]


def tables(customers: np.ndarray, base: np.ndarray, p0: np.ndarray, p1: np.ndarray, d: float, chance: np.ndarray) -> np.ndarray:
    """Tables drawn for each dish (0 where it has no customers); ``chance`` are uniform numbers."""
    out = np.minimum(customers, 1).astype(np.int64)
    c = np.minimum(customers, EXACT + 1)
    order = np.argsort(c, kind="stable")
    edges = np.searchsorted(c[order], np.arange(2, EXACT + 3))
    logs = _small(d)
    for size in range(2, EXACT + 1):
        step = max(1, _CELLS // size)
        for low in range(int(edges[size - 2]), int(edges[size - 1]), step):
            at = order[low : min(low + step, int(edges[size - 1]))]
            out[at] = _weighed(np.broadcast_to(logs[size, 1 : size + 1], (len(at), size)), base[at], p0[at], p1[at], d, chance[at])
    many = order[int(edges[EXACT - 1]) :]
    if len(many):
        out[many] = _many(customers[many], base[many], p0[many], p1[many], d, chance[many])
    return out


def _weighed(logs: np.ndarray, base: np.ndarray, p0: np.ndarray, p1: np.ndarray, d: float, chance: np.ndarray) -> np.ndarray:
    """Draws from all terms; row r of ``logs`` has log S for 1, 2, .. tables."""
    i = np.arange(1, logs.shape[1])
    weight = np.array(logs)
    if len(i):
        weight[:, 1:] += np.cumsum(np.log((base[:, None] + d * i) * (p0[:, None] + p1[:, None] * i)), axis=1)
    weight -= weight.max(axis=1, keepdims=True)
    weight = np.cumsum(np.exp(weight), axis=1)
    return 1 + (weight < chance[:, None] * weight[:, -1:]).sum(axis=1)


def _many(c: np.ndarray, base: np.ndarray, p0: np.ndarray, p1: np.ndarray, d: float, chance: np.ndarray) -> np.ndarray:
    """Draws for dishes of more than ``EXACT`` customers."""
    ratios, log_y = _saddle(d)
    c = c.astype(np.float64)
    t = np.clip(1.0 + base * p0 / d, 1.0, c)
    for _ in range(40):
        a = (base + d * t) * (p0 + p1 * t)
        y = np.exp(np.interp(np.log(c / a), ratios, log_y))
        t = np.sqrt(t * np.clip(a / d * -np.expm1(d * np.log(y)), 1.0, c))
    f, f1, f2, z = -np.expm1(d * np.log(y)), d * y ** (d - 1), d * (1 - d) * y ** (d - 2), 1 - y
    slope = c * (z * f1 * f1 - f * (f1 + z * f2)) / (z * f1) ** 2
    bend = f1 / f / slope - 1 / t + d / (base + d * t) + p1 / (p0 + p1 * t)
    spread = np.sqrt(1 / np.maximum(-bend, 1e-12))
    out = np.clip(np.rint(t + np.minimum(spread, t) * _normal(chance)), 1, c).astype(np.int64)
    few = np.flatnonzero(t < FEW)
    if len(few):
        at, logs = _large(d)
        for low in range(0, len(few), _CELLS // (2 * FEW)):
            rows = few[low : low + _CELLS // (2 * FEW)]
            place = np.clip(np.searchsorted(at, np.log(c[rows])) - 1, 0, len(at) - 2)
            # Ratios to one table settle with c^-d; beyond the last customers they are taken from there.
            x, x0, x1 = c[rows] ** -d, np.exp(-d * at[place]), np.exp(-d * at[place + 1])
            part = np.clip((x - x0) / (x1 - x0), 0.0, 1.0)[:, None]
            out[rows] = _weighed((1 - part) * logs[place] + part * logs[place + 1], base[rows], p0[rows], p1[rows], d, chance[rows])
    return out


def _normal(chance: np.ndarray) -> np.ndarray:
    """Normal deviates of uniform numbers (Winitzki's inverse error function, within 0.2 %)."""
    x = 2 * chance - 1
    log = np.log(np.maximum(1 - x * x, 1e-300))
    first = 2 / (math.pi * 0.147) + log / 2
    return np.sign(x) * np.sqrt(2 * np.maximum(np.sqrt(first * first - log / 0.147) - first, 0.0))
