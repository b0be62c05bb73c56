"""Attributes and their numbers of codes: the schema that all operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from math import prod


def _names(attrs: str | Iterable[str]) -> tuple[str, ...]:
    return (attrs,) if isinstance(attrs, str) else tuple(attrs)


@dataclass(frozen=True)
class Domain:
    """An ordered set of attributes with sizes."""

    attrs: tuple[str, ...]
    shape: tuple[int, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "attrs", _names(self.attrs))
        object.__setattr__(self, "shape", tuple(int(n) for n in self.shape))
        if len(self.attrs) != len(self.shape):
            raise ValueError("as many sizes as attributes are needed")
        if len(set(self.attrs)) != len(self.attrs):
            raise ValueError("an attribute is named twice")

    @classmethod
    def from_dict(cls, sizes: Mapping[str, int]) -> Domain:
        return cls(tuple(sizes), tuple(sizes.values()))

    @property
    def sizes(self) -> dict[str, int]:
        return dict(zip(self.attrs, self.shape, strict=True))

    def resized(self, attr: str, n: int) -> Domain:
        if attr not in self:
            raise KeyError(attr)
        return Domain.from_dict(self.sizes | {attr: n})

    def project(self, attrs: str | Iterable[str]) -> Domain:
        return Domain(names := _names(attrs), tuple(self[a] for a in names))

    transpose = project

    def invert(self, attrs: str | Iterable[str]) -> tuple[str, ...]:
        gone = set(_names(attrs))
        return tuple(a for a in self.attrs if a not in gone)

    def marginalize(self, attrs: str | Iterable[str]) -> Domain:
        return self.project(self.invert(attrs))

    def axes(self, attrs: str | Iterable[str]) -> tuple[int, ...]:
        return tuple(self.attrs.index(a) for a in _names(attrs))

    def canonical(self, attrs: str | Iterable[str]) -> tuple[str, ...]:
        """The attributes in this domain's order."""
        chosen = set(_names(attrs))
        return tuple(a for a in self.attrs if a in chosen)

    def merge(self, other: Domain) -> Domain:
        """Both domains' attributes; this one's sizes win."""
        return Domain.from_dict({**other.sizes, **self.sizes}).project(self.attrs + other.invert(self.attrs))

    def contains(self, other: Domain) -> bool:
        return set(other.attrs) <= set(self.attrs)

    def size(self, attrs: str | Iterable[str] | None = None) -> int:
        """Number of cells."""
        return prod(self.shape if attrs is None else self.project(attrs).shape)

    def sort(self, how: str = "size") -> Domain:
        return self.project(sorted(self.attrs, key=self.sizes.__getitem__ if how == "size" else str))

    def weights(self, attrs: str | Iterable[str]) -> tuple[int, ...]:
        """Row-major multipliers of the attributes' codes; a cell's id must fit a long."""
        shape = self.project(attrs).shape
        if prod(shape) >= 1 << 63:
            raise ValueError("the marginal has too many cells for a long id")
        return tuple(prod(shape[i + 1 :]) for i in range(len(shape)))

    def __contains__(self, attr: object) -> bool:
        return attr in self.attrs

    def __getitem__(self, attr: str) -> int:
        return self.sizes[attr]

    def __iter__(self) -> Iterator[str]:
        return iter(self.attrs)

    def __len__(self) -> int:
        return len(self.attrs)

    def __str__(self) -> str:
        return "Domain(" + ", ".join(f"{a}: {n}" for a, n in self.sizes.items()) + ")"
