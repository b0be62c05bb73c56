"""Slow, plain versions of the corpus operators, written from their contracts."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text: str | None) -> tuple[int, int, int, str]:
    text = text or ""
    found = []
    ascii_fold = text.translate(FOLD)
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", ascii_fold):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    kinds = ("assign", "access", "hex")
    joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found))
    return tuple(sum(f[1] == k for f in found) for k in range(3)) + (sha(joined),)


def shingles(text: str | None, n: int) -> set[tuple[str, ...]]:
    w = WORD.findall((text or "").translate(FOLD))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def jaccard(rows: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = [(i, shingles(t, n)) for i, t in rows]
    inverted = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            inverted[x].append(k)
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (_, s) in enumerate(sets):
        shared = Counter(j for x in s for j in inverted[x] if j < k)
        for j, c in shared.items():
            if 100 * c >= percent * (len(s) + len(sets[j][1]) - c):
                a, b = find(j), find(k)
                root[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return {i: (len(s), least[find(k)]) for k, (i, s) in enumerate(sets)}


def suffix(rows: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple[int, int, int, str]]:
    texts = {i: (t or "").encode() for i, t in rows}
    seen: dict[bytes, int] = {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - length + 1):
            seen.setdefault(texts[i][p : p + length], i)
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


def leaks(rows: list[tuple[int, str | None]], items: list[tuple[int, str | None]], percent: int = 80, window: int = 20) -> set[tuple[int, int]]:
    """Every item at every place of every document, without seeds."""
    out = set()
    lists = [(i, WORD.findall((t or "").lower())) for i, t in items]
    for d, t in rows:
        w = WORD.findall((t or "").lower())
        place = defaultdict(list)
        for k, x in enumerate(w):
            place[x].append(k)
        for i, b in lists:
            if not b:
                continue
            span = min(len(b), window)
            hits: dict[int, list[int]] = defaultdict(list)
            for j, x in enumerate(b):
                for k in place.get(x, ()):
                    hits[k - j].append(j)
            for js in hits.values():
                if len(js) * 100 >= span * percent:
                    same = [0] * len(b)
                    for j in js:
                        same[j] = 1
                    if any(sum(same[s : s + span]) * 100 >= span * percent for s in range(len(b) - span + 1)):
                        out.add((d, i))
                        break
    return out


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            inside.update(range(i, i + 5))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w)


def boilerplate(rows: list[tuple[int, str | None, str | None]], least: int = 20, share: float = 0.01, left: int = 30) -> dict[int, bool]:
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", "", x).lower()
    count: Counter = Counter()
    hosts: Counter = Counter(s for _, _, s in rows)
    for _, t, s in rows:
        count.update({(s, norm(x)) for x in (t or "").split("\n") if WORD.search(x)})
    out = {}
    for i, t, s in rows:
        q = quality(t)
        gone = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if WORD.search(x) and count[s, norm(x)] > max(least, share * hosts[s]))
        out[i] = not q[-1] and q[0] - gone >= 10 and 100 * (q[0] - gone) >= left * q[0]
    return out


def lines(rows: list[tuple[int, str | None]], least: int = 40, copies: int = 5) -> dict[int, tuple[int, int, str]]:
    key = lambda x: x.strip(" \t\n\v\f\r").translate(FOLD)
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders[key(x)].add(i)
    out = {}
    for i, t in rows:
        every = (t or "").split("\n")
        keep = [x for x in every if len(key(x)) < least or len(holders[key(x)]) < copies or max(holders[key(x)]) == i]
        out[i] = (len(every), len(every) - len(keep), sha("\n".join(keep)))
    return out


def backoff(rows: list[tuple[int, str | None]], order: int = 3, factor: float = 0.4, least: int = 1) -> dict[int, tuple[int, float]]:
    texts = {i: WORD.findall((t or "").translate(FOLD)) for i, t in rows}
    counts: Counter = Counter()
    for w in texts.values():
        for n in range(1, order + 1):
            counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(map(len, texts.values()))
    out = {}
    for i, w in texts.items():
        score = 0.0
        for k in range(len(w)):
            for n in range(min(order, k + 1), 0, -1):
                gram = tuple(w[k - n + 1 : k + 1])
                if n == 1:
                    score += math.log(counts[gram] / total)
                elif counts[gram] >= least:
                    score += math.log(counts[gram] / counts[gram[:-1]])
                    break
                else:
                    score += math.log(factor)
        out[i] = (len(w), score)
    return out


def rest(rows: list[tuple[int, str | None]], order: int = 3, factor: float = 0.4) -> dict[int, float]:
    """Scores of each text under the counts of all other rows; a word that they don't have counts once."""
    out = {}
    for i, t in rows:
        counts: Counter = Counter()
        for k, other in rows:
            if k != i:
                w = WORD.findall((other or "").translate(FOLD))
                for n in range(1, order + 1):
                    counts.update(tuple(w[j : j + n]) for j in range(len(w) - n + 1))
        total = max(1, sum(c for g, c in counts.items() if len(g) == 1))
        w, score = WORD.findall((t or "").translate(FOLD)), 0.0
        for k in range(len(w)):
            for n in range(min(order, k + 1), 0, -1):
                gram = tuple(w[k - n + 1 : k + 1])
                if n == 1:
                    score += math.log(max(1, counts[gram]) / total)
                elif counts[gram]:
                    score += math.log(counts[gram] / counts[gram[:-1]])
                    break
                else:
                    score += math.log(factor)
        out[i] = score
    return out


def due(share: float, slope: float, steps: int = 20_000) -> float:
    """The t at which the sum of 1 + slope * (2t - 1) over small steps reaches `share`."""
    total = 0.0
    for k in range(steps):
        more = (1 + slope * (2 * (k + 0.5) / steps - 1)) / steps
        if total + more >= share:
            return (k + (share - total) / more) / steps
        total += more
    return 1.0


def ftrl(examples: list[tuple[dict[int, float], float]], order: list[list[int]], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> dict[int, float]:
    """Weights after passes over sparse examples, one coordinate at a time."""
    z: dict = defaultdict(float)
    n: dict = defaultdict(float)

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for one in order:
        for e in one:
            x, y = examples[e]
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
    return {k: weight(k) for k in z}


def targets(sizes: dict[str | None, int], weights=(1, 2, 3), limit: float = 3.0) -> dict[str | None, float]:
    """Rounds of sharing by weight, each source stopping at its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        each = left / sum(w[s] for s in open_)
        full = {s for s in open_ if each * w[s] > limit * sizes[s]}
        if not full:
            return out | {s: each * w[s] for s in open_}
        for s in full:
            out[s] = limit * sizes[s]
            left -= out[s]
        open_ -= full
    return out
