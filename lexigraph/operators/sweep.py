"""Hyperparameter sweeps: proposals by expected improvement under a Gaussian process, judged in Hyperband brackets. Only settings and their scores (one row a run) are on the driver; a run is a Spark job."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np


class Range(NamedTuple):
    lo: float
    hi: float
    whole: bool = False
    log: bool = False


def value(space, u: float):
    """The value of a parameter at a place in [0, 1]."""
    if not isinstance(space, Range):
        return space[min(int(u * len(space)), len(space) - 1)]
    lo, hi = (math.log(space.lo), math.log(space.hi)) if space.log else (space.lo, space.hi)
    if space.whole and not space.log:
        return min(int(space.lo + u * (space.hi - space.lo + 1)), int(space.hi))
    x = lo + u * (hi - lo)
    x = math.exp(x) if space.log else x
    return round(x) if space.whole else x


def place(space, v) -> float:
    """A place that gives the value."""
    if not isinstance(space, Range):
        return (space.index(v) + 0.5) / len(space)
    if space.whole and not space.log:
        return (v - space.lo + 0.5) / (space.hi - space.lo + 1)
    return (math.log(v / space.lo) / math.log(space.hi / space.lo)) if space.log else (v - space.lo) / (space.hi - space.lo)


def kernel(a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
    """Matern 5/2."""
    r = np.sqrt(5 * ((a[:, None] - b) ** 2).sum(-1)) / scale
    return (1 + r + r * r / 3) * np.exp(-r)


class Surrogate:
    """A Gaussian process over scores with mean 0 and deviation 1; of the length scales the one of greatest likelihood."""

    def __init__(self, x: np.ndarray, y: np.ndarray, noise: float = 1e-6, scales=(0.1, 0.2, 0.4, 0.8, 1.6)):
        self.x, self.shift = x, y.mean()
        self.size = y.std() or 1.0
        z = (y - self.shift) / self.size
        best = None
        for s in scales:
            low = np.linalg.cholesky(kernel(x, x, s) + noise * np.eye(len(x)))
            a = np.linalg.solve(low.T, np.linalg.solve(low, z))
            likely = -0.5 * z @ a - np.log(np.diag(low)).sum()
            if best is None or likely > best[0] + 1e-12:
                best = likely, s, low, a
        _, self.scale, self.low, self.a = best

    def at(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = kernel(x, self.x, self.scale)
        v = np.linalg.solve(self.low, k.T)
        return self.shift + self.size * (k @ self.a), self.size * np.sqrt(np.maximum(1 - (v * v).sum(0), 1e-18))


def expected_improvement(mean: np.ndarray, deviation: np.ndarray, best: float) -> np.ndarray:
    """Of a score that is to fall below the best one."""
    z = (best - mean) / deviation
    cdf = 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
    return (best - mean) * cdf + deviation * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def halton(n: int, dims: int, skip: int = 0) -> np.ndarray:
    """Evenly spread points of the unit cube, the same in every run."""
    primes = [p for p in range(2, 200) if all(p % q for q in range(2, p))][:dims]
    out = np.zeros((n, dims))
    for j, p in enumerate(primes):
        for i in range(n):
            k, f = i + 1 + skip, 1.0
            while k:
                f /= p
                out[i, j] += f * (k % p)
                k //= p
    return out


def propose(space: dict, seen: list[tuple[dict, float]], candidates: int = 512, first: int = 4) -> dict:
    """The next setting: of evenly spread candidates not tried yet the one of greatest expected improvement; before there are `first` scores the next point of the sequence."""
    names = list(space)
    cube = halton(candidates, len(names), skip=len(seen))
    settings = [{n: value(space[n], u) for n, u in zip(names, row, strict=True)} for row in cube]
    tried = {tuple(s.items()) for s, _ in seen}
    fresh = [s for s in settings if tuple(s.items()) not in tried] or settings
    if len(seen) < first:
        return fresh[0]
    at = lambda s: [place(space[n], s[n]) for n in names]
    known = {tuple(s.items()): y for s, y in seen}
    y = np.array(list(known.values()))
    model = Surrogate(np.array([at(dict(k)) for k in known]), y)
    gain = expected_improvement(*model.at(np.array([at(s) for s in fresh])), y.min())
    return fresh[int(np.argmax(np.round(gain, 12)))]


def brackets(most: float, least: float, eta: int = 3) -> list[list[tuple[int, float]]]:
    """Hyperband's rounds (runs, budget) for each bracket, the widest first; the last one gives whole budgets at once."""
    deep = int(math.floor(math.log(most / least) / math.log(eta) + 1e-9))
    out = []
    for s in range(deep, -1, -1):
        n = math.ceil((deep + 1) * eta**s / (s + 1))
        out.append([(max(1, n // eta**i), most / eta ** (s - i)) for i in range(s + 1)])
    return out


def sweep(space: dict, score: Callable[[dict, float], float], most: float = 1.0, least: float = 1 / 9, eta: int = 3) -> list[dict]:
    """All runs in order: bracket, round, budget, setting, score (to fall), kept. The surrogate learns from each setting's score at its greatest budget; a round keeps the best, the first tried of equal ones. score(setting, budget) may be a Spark job over a share of the rows."""
    runs, latest = [], {}
    for b, rounds in enumerate(brackets(most, least, eta)):
        field = []
        for i, (n, budget) in enumerate(rounds):
            if i == 0:
                while len(field) < n:  # one after the other, so each proposal knows the scores before
                    setting = propose(space, [(dict(k), v[1]) for k, v in latest.items()])
                    field.append(setting)
                    runs.append({"bracket": b, "round": 0, "budget": budget, "setting": setting, "score": float(score(setting, budget)), "kept": False})
                    note(latest, runs[-1])
            else:
                for setting in field:
                    runs.append({"bracket": b, "round": i, "budget": budget, "setting": setting, "score": float(score(setting, budget)), "kept": False})
                    note(latest, runs[-1])
            now = runs[-len(field) :]
            goes = rounds[i + 1][0] if i + 1 < len(rounds) else 1
            for r in sorted(now, key=lambda r: r["score"])[:goes]:
                r["kept"] = True
            field = [r["setting"] for r in now if r["kept"]]
    return runs


def note(latest: dict, run: dict) -> None:
    key = tuple(run["setting"].items())
    if key not in latest or run["budget"] >= latest[key][0]:
        latest[key] = run["budget"], run["score"]
