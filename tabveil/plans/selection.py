"""Which marginals to keep: plans over tens of attributes, on the driver."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from itertools import combinations
from math import pi, sqrt

import numpy as np

from tabveil.domain import Domain

Marginal = tuple[str, ...]


def neighbours(marginals: Iterable[Marginal], nodes: Iterable[str] = ()) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {n: set() for n in nodes}
    for m in marginals:
        for a in m:
            out.setdefault(a, set()).update(x for x in m if x != a)
    return out


def greedy(pairs: Sequence[tuple[str, str, int, float]], n: int, rho: float, method: str = "A3", sensitivity: float = 1.0, threshold: float = 20_000) -> list[Marginal]:
    """Pairs (first, second, cells, error) in the order in which keeping them costs least.

    Each round adds the pair that makes the noise of the kept ones plus the error of the others smallest, and it is
    added only if this is below the error of all pairs. Rounds go on while the cost falls by more than `threshold`; the
    pair of the last round stays. Sums are kept up to date, so a round costs one pass over the open pairs.
    """
    power = [c ** (2 / 3) for _, _, c, _ in pairs]
    errors = [e * n for *_, e in pairs]
    total = sum(errors)
    open_ = list(range(len(pairs)))
    cubes = cells = 0.0
    left, before, out = total, total, []
    while open_:

        def cost(j: int) -> float:
            if method == "A3":
                s = cubes + power[j]
                noise = sqrt(s / (pi * rho)) * s
            elif method in ("A1", "A2"):
                noise = sqrt(sensitivity**2 * (len(out) + 1) / (2 * rho)) * (cells + pairs[j][2])
            else:
                raise ValueError(f"unknown allocation {method}")
            return noise + left - errors[j]

        best = min(open_, key=lambda j: (cost(j), j))
        now = cost(best)
        if now >= total:
            break
        open_.remove(best)
        out.append(pairs[best][:2])
        cubes, cells, left = cubes + power[best], cells + pairs[best][2], left - errors[best]
        if before - now <= threshold:
            break
        before = now
    return out


def attach_isolated(chosen: Sequence[Marginal], attrs: Sequence[str], pairs: Sequence[tuple[str, str, int, float]], how: str = "connect") -> list[Marginal]:
    """Add each attribute that no pair has: alone, or with the chosen attribute it depends on most."""
    held = {a for m in chosen for a in m}
    out = list(chosen)
    for a in attrs:
        if a not in held:
            near = [p for p in pairs if a in p[:2] and held & set(p[:2])] if how == "connect" else []
            out.append(max(near, key=lambda p: p[3])[:2] if near else (a,))
    return out


def cliques(marginals: Sequence[Marginal]) -> dict[int, list[Marginal]]:
    """All cliques by size, each grown from smaller ones by a common later neighbour."""
    near = neighbours(marginals)
    rank = {a: k for k, a in enumerate(near)}
    level = [(a,) for a in near]
    out = defaultdict(list)
    while level:
        out[len(level[0])] = level
        level = [(*c, b) for c in level for b in sorted(set.intersection(*(near[a] for a in c)), key=rank.__getitem__) if rank[b] > rank[c[-1]]]
    return dict(out)


def combine(marginals: Sequence[Marginal], domain: Domain, cells: int = 5000) -> list[Marginal]:
    """Larger marginals for whole cliques, largest first, and the pairs that none of them covers."""
    taken: list[Marginal] = []
    held: set[str] = set()
    found = cliques(marginals)
    for size in sorted((s for s in found if s > 2), reverse=True):
        for c in found[size]:
            if len(held & set(c)) <= 2 and domain.size(c) < cells:
                taken.append(c)
                held |= set(c)
    return taken + missing(marginals, taken)


def missing(marginals: Sequence[Marginal], combined: Sequence[Marginal]) -> list[Marginal]:
    covered = {frozenset(p) for c in combined for p in combinations(c, 2)}
    return [m for m in marginals if len(m) != 2 or frozenset(m) not in covered]


@dataclass
class Layer:
    """Attributes that are added after synthesis, each given its only neighbour."""

    ancestor: dict[str, str] = field(default_factory=dict)
    marginal: dict[str, Marginal] = field(default_factory=dict)


def clip(marginals: Sequence[Marginal], attrs: Sequence[str] = ()) -> tuple[list[Layer], list[Marginal]]:
    """Take attributes with one neighbour off the graph, again and again; what remains is synthesised.

    Of two attributes that have only each other, the first in order is taken off, and the other stands alone.
    """
    rest = [tuple(m) for m in marginals]
    layers: list[Layer] = []
    alone: list[Marginal] = []
    while True:
        near = neighbours(rest, attrs)
        layer = Layer()
        for a in near:
            if len(near[a]) == 1:
                (b,) = near[a]
                pair = next((m for m in rest if set(m) == {a, b}), None)
                if pair is None:
                    continue
                if b in layer.ancestor:  # it was taken off a moment ago, with this one as its ancestor
                    alone.append((a,))
                    continue
                layer.ancestor[a], layer.marginal[a] = b, pair
        if not layer.ancestor:
            return layers, rest + alone
        layers.append(layer)
        rest = [m for m in rest if m not in layer.marginal.values()]


def components(marginals: Sequence[Marginal], attrs: Sequence[str] = ()) -> list[tuple[set[str], list[Marginal]]]:
    """Attributes that marginals connect, with those marginals."""
    near = neighbours(marginals, attrs)
    out, seen = [], set()
    for a in near:
        if a not in seen:
            part, todo = {a}, [a]
            while todo:
                todo += (new := near[todo.pop()] - part)
                part |= new
            seen |= part
            out.append((part, [m for m in marginals if set(m) <= part]))
    return out


def cover(marginals: Sequence[Marginal], target: str) -> list[Marginal]:
    """Marginals with the target attribute, each time the one that adds most attributes."""
    everything = {a for m in marginals for a in m}
    held, out = {target}, []
    rest = [m for m in marginals if target in m]
    while held != everything and rest:
        best = max(rest, key=lambda m: len(set(m) - held))
        if not set(best) - held:
            break
        out.append(best)
        held |= set(best)
        rest.remove(best)
    return out


def mean_correlation(x: np.ndarray, shape: Sequence[int], place: int) -> float:
    """The mean of Pearson's correlations of the other attributes' codes with that at `place`, each cell weighted by its share; 0 without one."""
    codes = [c.ravel() for c in np.indices(tuple(shape))]
    w = x / x.sum() if x.sum() > 0 else np.full(len(x), 1 / len(x))
    centred = [c - (w * c).sum() for c in codes]
    size = [np.sqrt((w * c * c).sum()) for c in centred]
    found = [(w * c * centred[place]).sum() / (s * size[place]) for k, (c, s) in enumerate(zip(centred, size, strict=True)) if k != place and s > 0 and size[place] > 0]
    return float(np.mean(found)) if found else 0.0


def rank(marginals: Sequence[Marginal], correlation: dict[Marginal, float]) -> list[Marginal]:
    """Fewer attributes first, then the higher correlation with the target attribute."""
    return sorted(marginals, key=lambda m: (len(m), -correlation[m]))
