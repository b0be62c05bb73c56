"""Secret scan: fixed base patterns, and formats inferred from the credentials that those label.

Credentials found by the base patterns in all documents are the labelled examples, by kind, up to a number drawn by hash.
For each kind a prefix tree of them is folded into a probabilistic automaton: two states merge if the shares of
every symbol and of ending agree within Hoeffding's bound, all the way down. Every other run of credential
characters, in every whole text, is scored by each automaton against a character model of ordinary text; runs
that some format explains better by a fixed likelihood ratio become further spans. Ordinary text is learned from runs too
short to be judged, so credentials that no pattern labels neither raise the limit nor teach the model.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.llm.blobs import docs_of
from tabveil.llm.text import buffers, code_points, slabs

KINDS = ("assign", "access", "hex", "format")
LEAST = 12  # characters of a candidate
RATIO = 0.25  # nats a character by which a format must explain a run better than ordinary text: 20 to 1 over 12 characters
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
HEX = re.compile(rb"[0-9a-f]{16,}")
BLOCK = 2048  # characters of a long run that are taken together
ALPHABET = np.zeros(256, bool)
ALPHABET[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.=-"]] = True


def base(text: bytes) -> list[tuple[int, int, int, int, int]]:
    """(kind, from, to, value from, value to) in bytes, for each base match."""
    out = [(0, m.start(), m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text.lower()) if m.end(2) - m.start(2) >= 12]
    out += [(1, m.start(), m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)] if b"AKIA" in text else []
    out += [(2, m.start(), m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of LEAST or more credential characters."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ALPHABET[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:]
    last = inside[:-1] & (~inside[1:] | edge[1:])
    start, end = np.flatnonzero(first[:-1]), np.flatnonzero(last) + 1
    ok = end - start >= LEAST
    start, end = start[ok], end[ok]
    return start, end, np.searchsorted(offs, start, "right") - 1


class Automaton:
    """A probabilistic automaton as tables: the next state and the log probability of each byte in each state."""

    def __init__(self, strings: list[bytes], alpha: float = 0.01) -> None:
        self.count, self.final, self.next = [0], [0], [{}]
        for s in strings:
            at = 0
            for c in s:
                self.count[at] += 1
                if c not in self.next[at]:
                    self.next[at][c] = (len(self.count), 0)
                    self.count.append(0)
                    self.final.append(0)
                    self.next.append({})
                to, n = self.next[at][c]
                self.next[at][c] = (to, n + 1)
                at = to
            self.count[at] += 1
            self.final[at] += 1
        self.bound = np.sqrt(0.5 * np.log(2 / alpha))
        self.states = self._fold()
        self._tables()

    def _near(self, a: int, n: int, b: int, m: int) -> bool:
        return not n or not m or abs(a / n - b / m) < self.bound * (n**-0.5 + m**-0.5)

    def _alike(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.count[p], self.count[q]
            if not self._near(self.final[p], n, self.final[q], m):
                return False
            for c in self.next[p].keys() | self.next[q].keys():
                x, y = self.next[p].get(c), self.next[q].get(c)
                if not self._near(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y and x[0] != y[0]:
                    todo.append((x[0], y[0]))
        return True

    def _merge(self, p: int, q: int) -> None:
        """Add the tree below q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.count[p] += self.count[q]
            self.final[p] += self.final[q]
            for c, (to, n) in self.next[q].items():
                if c in self.next[p]:
                    have, k = self.next[p][c]
                    self.next[p][c] = (have, k + n)
                    if have != to:
                        todo.append((have, to))
                else:
                    self.next[p][c] = (to, n)

    def _fold(self) -> list[int]:
        red = [0]
        while True:
            blue = [(-n, to, p, c) for p in red for c, (to, n) in self.next[p].items() if to not in red]
            if not blue:
                return red
            _, q, p, c = min(blue)  # the state with most evidence first
            home = next((r for r in red if self._alike(r, q)), None)
            if home is None:
                red.append(q)
            else:
                self.next[p][c] = (home, self.next[p][c][1])
                self._merge(home, q)

    def _tables(self) -> None:
        place = {s: k for k, s in enumerate(self.states)}
        self.to = np.zeros((len(place), 256), np.int32)
        self.log = np.full((len(place), 256), np.log(1e-5))
        self.end = np.full(len(place), np.log(1e-5))
        for s, k in place.items():
            n = max(self.count[s], 1)
            for c, (to, m) in self.next[s].items():
                self.to[k, c], self.log[k, c] = place[to], np.log((m + 1e-3) / (n + 0.1))
            if self.final[s]:
                self.end[k] = np.log((self.final[s] + 1e-3) / (n + 0.1))


def smooth(pairs: np.ndarray) -> np.ndarray:
    """Log probabilities of each byte after each other from counts of pairs, mixed with equal shares so that they don't fall with the size of the text."""
    n = int(ALPHABET.sum())
    return np.log(0.99 * (pairs + 1 / n) / (pairs.sum(1, keepdims=True) + 1) + 0.01 / n)


def ordinary(strings: list[bytes]) -> np.ndarray:
    """Log probabilities of each byte after each other, from ordinary runs."""
    pairs = np.zeros((256, 256))
    for s in strings:
        x = np.frombuffer(b"\n" + s, np.uint8)
        np.add.at(pairs, (x[:-1], x[1:]), 1)
    return smooth(pairs)


def short_pairs(data: np.ndarray, offs: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Counts of pairs of bytes in runs of credential characters under LEAST; `free` marks the bytes outside base matches."""
    use = ALPHABET[data] & free
    start, end, _ = runs(data, offs)
    long = np.zeros(len(data) + 1, np.int32)
    long[start] += 1
    long[end] -= 1
    use &= np.cumsum(long[:-1]) == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.full(len(data), 10, np.int32)
    joined = use[1:] & use[:-1] & ~edge[1:-1]
    before[1:][joined] = data[:-1][joined]
    return np.bincount((before[use] << 8) | data[use], minlength=1 << 16)


Tables = tuple[np.ndarray, np.ndarray, np.ndarray]  # next states, log probabilities, log probabilities of ending


def walk(x: np.ndarray, to: np.ndarray, log: np.ndarray) -> tuple[int, float]:
    """State and sum of log probabilities after a long run, the same as step by step from state 0.

    The run is cut into blocks. Each block is walked from every state side by side, and walks that meet in a state go on as
    one, as most do within a few characters; then the blocks' maps from state to (state, sum) are composed.
    """
    n, state, total = len(to), 0, 0.0
    for lo in range(0, len(x), 1024 * BLOCK):
        part = x[lo : lo + 1024 * BLOCK]
        m = len(part) // BLOCK
        cells = part[: m * BLOCK].reshape(m, BLOCK)
        block, at = np.repeat(np.arange(m), n), np.tile(np.arange(n, dtype=np.int32), m)
        walks, sums = np.arange(m * n).reshape(m, n), np.zeros((m, n))
        done, step = 0, 4
        while m and done < BLOCK:
            more = np.zeros(len(at))
            for j in range(done, min(done + step, BLOCK)):
                c = cells[block, j]
                more += log[at, c]
                at = to[at, c]
            done, step = done + step, 2 * step
            sums += more[walks]
            met, same = np.unique(block * n + at, return_inverse=True)
            walks, block, at = same[walks], met // n, (met % n).astype(np.int32)
        ends = at[walks]
        for k in range(m):
            total += sums[k, state]
            state = int(ends[k, state])
        for c in part[m * BLOCK :]:
            total += log[state, c]
            state = int(to[state, c])
    return state, total


def likelihood(data: np.ndarray, start: np.ndarray, end: np.ndarray, machines: list[Tables], plain: np.ndarray) -> np.ndarray:
    """For each run the best format's log likelihood a character, over that of ordinary text."""
    if not len(start) or not machines:
        return np.full(len(start), -np.inf)
    out = np.empty(len(start))
    for k in np.flatnonzero(end - start > 2 * BLOCK):
        x = data[start[k] : end[k]]
        ordinary_sum = plain[10, x[0]] + plain[x[:-1], x[1:]].sum()
        best = max(total + ends[state] for (to, log, ends) in machines for state, total in [walk(x, to, log)])
        out[k] = (best - ordinary_sum) / len(x)
    few = np.flatnonzero(end - start <= 2 * BLOCK)
    start, size = start[few], end[few] - start[few]
    by = np.argsort(-size, kind="stable")
    start, size = start[by], size[by]
    states = [np.zeros(len(by), np.int32) for _ in machines]
    sums = [np.zeros(len(by)) for _ in machines]
    base_sum, before = np.zeros(len(by)), np.full(len(by), 10, np.uint8)
    at = 0
    live = len(by)
    while live:
        c = data[start[:live] + at]
        base_sum[:live] += plain[before[:live], c]
        before[:live] = c
        for k, (to, log, _) in enumerate(machines):
            s = states[k][:live]
            sums[k][:live] += log[s, c]
            states[k][:live] = to[s, c]
        at += 1
        live = int(np.searchsorted(-size, -at, "left"))
    best = np.max([s + ends[q] for s, q, (_, _, ends) in zip(sums, states, machines, strict=True)], 0)
    out[few[by]] = (best - base_sum) / size
    return out


def train(docs: DataFrame, examples: int = 600, longest: int = 256) -> tuple[list[Tables], np.ndarray]:
    """Automata's tables and the model of ordinary text.

    Learns from all documents: of the distinct credentials of each kind the `examples` of least hash among those of at most
    `longest` bytes (a bounded sample of whole labelled credentials; longer ones are still found), of ordinary text the counts of all pairs of bytes in runs under LEAST characters. A task sends at most `examples` rows a kind and one a pair.
    """

    def label(batches):
        least: list[dict[bytes, bytes]] = [{} for _ in KINDS[:3]]
        pairs = np.zeros(1 << 16, np.int64)

        def cut(k):
            least[k] = {h: least[k][h] for h in sorted(least[k])[:examples]}

        for batch in batches:
            data, offs = buffers(batch["text"])
            for a, b in slabs(offs):
                part, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                free = np.ones(len(part), bool)
                for lo, hi in zip(o[:-1], o[1:], strict=True):
                    text = part[lo:hi].tobytes()
                    for kind, s, e, vs, ve in base(text):
                        if ve - vs <= longest:
                            value = text[vs:ve]
                            least[kind][blake2b(value, digest_size=8).digest()] = value
                        free[lo + s : lo + e] = False
                        if len(least[kind]) > 8 * examples:
                            cut(kind)
                pairs += short_pairs(part, o, free)
        for k in range(3):
            cut(k)
        values = [(k, h, v, 1) for k, found in enumerate(least) for h, v in found.items()]
        values += [(3, int(x).to_bytes(2, "big"), None, int(pairs[x])) for x in np.flatnonzero(pairs)]
        kind, key, value, n = zip(*values, strict=True) if values else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.binary()), pa.array(value, pa.binary()), pa.array(n, pa.int64())], names=["kind", "key", "value", "n"])

    found = docs.select("text").mapInArrow(label, "kind int, key binary, value binary, n long")
    found = found.groupBy("kind", "key").agg(F.min("value").alias("value"), F.sum("n").alias("n")).persist()
    # at most `examples` rows a kind, and a row a pair of bytes
    by_kind = [[bytes(r["value"]) for r in found.where(F.col("kind") == k).orderBy("key").limit(examples).collect()] for k in range(3)]
    pairs = np.zeros((256, 256))
    for r in found.where("kind = 3").select("key", "n").collect():
        pairs[r["key"][0], r["key"][1]] = r["n"]
    found.unpersist()
    machines = [(m.to, m.log, m.end) for m in (Automaton(v) for v in by_kind if v)]
    return machines, smooth(pairs)


def scan(docs: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(doc_id, spans) for every row; spans is a list of (kind, start, end) in code points, sorted by start and kind.

    Kinds assign, access and hex are the base patterns, format what the inferred automata add: runs that one explains
    better than ordinary text does by `ratio` nats a character or more, however many there are. Added spans never
    overlap a base one. Null and empty texts have no spans. Without any labelled credential nothing is added. Equal
    rows get equal results. An empty table gives none.
    """
    docs = docs_of(docs, "doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(train(docs))  # a few hundred states

    def find(batches):
        machines, plain = model.value
        for batch in batches:
            data, offs = buffers(batch["text"])
            for a, b in slabs(offs):
                part, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                spans: list[list[tuple[int, int, int]]] = [[] for _ in range(a, b)]
                taken = np.zeros(len(part) + 1, np.int64)
                for k, (lo, hi) in enumerate(zip(o[:-1], o[1:], strict=True)):
                    for kind, s, e, _, _ in base(part[lo:hi].tobytes()):
                        spans[k].append((int(lo) + s, kind, int(lo) + e))
                        taken[lo + s : lo + e] = 1
                covered = np.concatenate([[0], np.cumsum(taken)])
                s, e, row = runs(part, o)
                free = covered[e] == covered[s]
                s, e, row = s[free], e[free], row[free]
                for k in np.flatnonzero(likelihood(part, s, e, machines, plain) >= ratio):
                    spans[row[k]].append((int(s[k]), 3, int(e[k])))
                out = []
                points = code_points(part) if any(spans) else None
                for lo, found in zip(o, spans, strict=False):
                    out.append([{"kind": KINDS[kind], "start": int(points[s] - points[lo]), "end": int(points[e] - points[lo])} for s, kind, e in sorted(found)])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(out, kind)], names=["doc_id", "spans"])

    return docs.mapInArrow(find, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")
