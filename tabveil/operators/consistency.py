"""Agreement of noisy marginals on the attributes they share."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.domain import Domain
from tabveil.operators.marginals import rolled_weight
from tabveil.operators.nonneg import apply_array

View = tuple[str, ...]


def step(marginals: Mapping[View, DataFrame], on: Sequence[str], domain: Domain, rho: Mapping[View, float], faithful: bool = False) -> dict[View, DataFrame]:
    """Bring the roll-ups of all marginals onto `on` to their weighted mean (an empty `on`: the total).

    A view weighs its rho over the cells that fall together. `faithful` scales the step by rho once more, as the
    original rule does; without it the roll-ups agree after one step.
    """
    on = list(on)
    sums = []
    for v, m in marginals.items():
        w = rolled_weight(domain, v, on)
        sums.append(m.groupBy(*on).agg(F.sum("count").alias("s")).select(*on, F.lit(",".join(v)).alias("view"), "s", F.lit(w).alias("w"), F.lit(float(rho[v])).alias("r")))
    every = reduce(DataFrame.unionByName, sums)
    weight = F.col("r") * F.col("w")
    target = every.groupBy(*on).agg((F.sum(F.col("s") * weight) / F.sum(weight)).alias("t"))
    joined = every.join(target, on) if on else every.crossJoin(F.broadcast(target))
    delta = joined.select(*on, "view", ((F.col("t") - F.col("s")) * F.col("w") * (F.col("r") if faithful else F.lit(1.0))).alias("d"))
    out = {}
    for v, m in marginals.items():
        mine = F.broadcast(delta.where(F.col("view") == ",".join(v)).drop("view"))
        out[v] = (m.join(mine, on, "left") if on else m.crossJoin(mine)).withColumn("count", F.col("count") + F.coalesce("d", F.lit(0.0))).drop("d")
    return out


@dataclass(frozen=True)
class Subset:
    """Attributes that must agree, after those subsets of them that come first."""

    attrs: frozenset[str]
    after: frozenset[frozenset[str]]


def lattice(views: Iterable[View]) -> list[Subset]:
    """All intersections of views that two or more of them contain, smaller ones first."""
    views = [frozenset(v) for v in views]
    found = set(views)
    while more := {a & b for a in found for b in views if a & b} - found:
        found |= more
    shared = sorted((s for s in found if sum(s <= v for v in views) > 1), key=lambda s: (len(s), sorted(s)))
    return [Subset(s, frozenset(t for t in shared if t < s)) for s in shared]


def consist(views: Mapping[View, np.ndarray], domain: Domain, rho: Mapping[View, float], method: str = "N3", rounds: int = 501, tolerance: float = 1e-6, faithful: bool = False) -> tuple[dict[View, np.ndarray], int, float]:
    """Iterate steps and non-negativity on dense arrays until no count is negative and all roll-ups agree.

    Works on the driver: the arrays are marginals, whose cells are capped. Returns the views, the rounds and
    the largest remaining disagreement.
    """
    shape = {v: domain.project(v).shape for v in views}
    now = {v: np.asarray(x, float).reshape(shape[v]).copy() for v, x in views.items()}
    order = [Subset(frozenset(), frozenset()), *lattice(views)]

    def agree() -> float:
        worst = 0.0
        for s in order:
            held = [v for v in now if s.attrs <= set(v)]
            mean = None
            if len(held) < 2:
                continue
            names = domain.canonical(s.attrs)
            rolled = [_roll(now[v], v, names) for v in held]
            mean = sum(rolled) / len(rolled)
            worst = max(worst, *(float(np.abs(r - mean).max()) for r in rolled))
        return worst

    it, gap = 0, float("inf")
    for it in range(rounds):
        for s in order:
            names = domain.canonical(s.attrs)
            held = [v for v in now if s.attrs <= set(v)]
            if len(held) < 2:
                continue
            rolled = {v: _roll(now[v], v, names) for v in held}
            w = {v: rolled_weight(domain, v, names) for v in held}
            target = sum(rolled[v] * w[v] * rho[v] for v in held) / sum(w[v] * rho[v] for v in held)
            for v in held:
                delta = (target - rolled[v]) * w[v] * (rho[v] if faithful else 1.0)
                axes = [names.index(a) if a in names else None for a in v]
                spread = delta.transpose([x for x in axes if x is not None]) if names else delta
                now[v] += spread.reshape([n if a in names else 1 for a, n in zip(v, shape[v], strict=True)])
        negative = any((x < 0).any() for x in now.values())
        if not negative:
            gap = agree()
            if faithful or gap <= tolerance * max(1.0, max(float(x.sum()) for x in now.values())):
                break
        now = {v: apply_array(x.ravel(), method, it).reshape(shape[v]) for v, x in now.items()}
        gap = agree()
        if gap <= tolerance:
            break
    return {v: x.ravel() for v, x in now.items()}, it + 1, gap


def _roll(x: np.ndarray, attrs: View, names: Sequence[str]) -> np.ndarray:
    """Sum over the other attributes; axes in the order of `names`."""
    kept = [a for a in attrs if a in names]
    out = x.sum(axis=tuple(i for i, a in enumerate(attrs) if a not in names))
    return out.transpose([kept.index(a) for a in names]) if kept else out
