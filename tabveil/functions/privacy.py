"""Zero-concentrated differential privacy: noise scales, budgets, a ledger of releases, and noise columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from math import log, pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaussian_sigma(epsilon: float, delta: float, sensitivity: float = 1.0, k: int = 1) -> float:
    """Standard deviation that gives k releases (epsilon, delta)."""
    if epsilon <= 0 or not 0 < delta < 1 or k < 1:
        raise ValueError("epsilon and k must be positive, delta between 0 and 1")
    t = 2 * k * sensitivity**2 * log(1 / delta)
    return (sqrt(t) + sqrt(t + 2 * k * sensitivity**2 * epsilon)) / (2 * epsilon)


def delta_for(n: int, power: int = 2) -> float:
    """1 / n**power, for n records."""
    return 1.0 / max(n, 2) ** power


def split(epsilon: float, ratio: float = 0.1) -> tuple[float, float]:
    """The shares of a budget for choosing marginals and for the rest."""
    return epsilon * ratio, epsilon * (1 - ratio)


def rho_for(epsilon: float, delta: float, sensitivity: float = 1.0) -> float:
    return sensitivity**2 / (2 * gaussian_sigma(epsilon, delta, sensitivity) ** 2)


def allocate(cells: Mapping[str, int], method: str, rho: float, epsilon: float, sensitivity: float = 1.0) -> dict[str, dict[str, float]]:
    """Noise for each view. A1: Laplace, epsilon shared equally; A2: Gaussian, rho shared equally; A3: by the root of the cells."""
    if method == "A1":
        return {v: {"epsilon": epsilon / len(cells), "rho": 1.0, "scale": sensitivity * len(cells) / epsilon} for v in cells}
    if method not in ("A2", "A3"):
        raise ValueError(f"unknown allocation {method}")
    share = {v: sqrt(n) if method == "A3" else 1.0 for v, n in cells.items()}
    total = sum(share.values())
    return {v: {"epsilon": 0.0, "rho": rho * s / total, "scale": sqrt(sensitivity**2 * total / (2 * rho * s))} for v, s in share.items()}


@dataclass
class Ledger:
    """Every release with what it costs; `spent` adds up zCDP costs, and pure ones as epsilon**2 / 2."""

    rho: float
    entries: list[tuple[str, float]] = field(default_factory=list)

    def charge(self, what: str, rho: float = 0.0, epsilon: float = 0.0) -> None:
        self.entries.append((what, rho + epsilon**2 / 2))

    @property
    def spent(self) -> float:
        return sum(x for _, x in self.entries)

    @property
    def over(self) -> bool:
        return self.spent > self.rho * (1 + 1e-9)


def _share(key: Column, salt: str) -> Column:
    """An integer below 2**48 from a key's digest."""
    return F.conv(F.substring(F.sha2(F.concat(key, F.lit(salt)), 256), 1, 12), 16, 10).cast("double")


def keyed_normal(key: Column) -> Column:
    """A standard normal value that depends on a text alone. For tests: whoever knows the key can take it off."""
    u, v = (_share(key, "|a") + 0.5) / F.lit(2.0**48), _share(key, "|b") / F.lit(2.0**48)
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.lit(pi) * v)


def keyed_laplace(key: Column) -> Column:
    """A standard Laplace value that depends on a text alone."""
    u = (_share(key, "|a") + 0.5) / F.lit(2.0**48) - 0.5
    return -F.signum(u) * F.ln(1 - 2 * F.abs(u))


def noise(scale: float, kind: str = "gauss", mode: str = "random", key: Column | None = None, seed: int | None = None) -> Column:
    """Noise for a count. mode none: 0; random: drawn anew, with `seed` only where runs must be repeatable; keyed: by `key`."""
    if mode == "none":
        return F.lit(0.0)
    if mode == "keyed":
        return (keyed_normal(key) if kind == "gauss" else keyed_laplace(key)) * F.lit(scale)
    if kind == "gauss":
        return F.randn(seed) * F.lit(scale)
    u = F.rand(seed) - 0.5
    return -F.signum(u) * F.ln(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300))) * F.lit(scale)
