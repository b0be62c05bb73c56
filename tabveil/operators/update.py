"""Gradual update of records: one step on tables, and whole runs on shards."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from math import exp, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.domain import Domain
from tabveil.operators import rounds as jvm_rounds
from tabveil.operators.marginals import dense, local
from tabveil.operators.quota import fill, ordered

FIXED = {"U8": 1.0, "U9": 0.2, "U10": 0.3, "U11": 0.5, "U12": 0.1}
#: Share of complete copies in even and odd rounds.
POLICIES = {"S1": (0.0, 0.0), "S2": (1.0, 1.0), "S3": (0.5, 0.5), "S4": (0.0, 1.0), "S5": (0.5, 1.0), "S6": (0.5, 0.0)}
SPARSE_CELLS = 25_000  # about half of the records that a shard has by default


def rate(method: str, i: int, first: float = 1.0) -> float:
    """The update rate of round i."""
    if method in FIXED:
        return FIXED[method]
    decay = {"U1": lambda: 1.0, "U2": lambda: 0.98**i, "U3": lambda: 0.98 ** min(i, 100) * 0.99 ** max(0, i - 100), "U4": lambda: 0.84 ** (i // 20), "U5": lambda: exp(-0.008 * i), "U6": lambda: 1 / (1 + 0.02 * i), "U7": lambda: 1 / sqrt(0.12 * i + 1)}
    return first * decay[method]()


def sets(rows: DataFrame, target: DataFrame, domain: Domain, attrs: Sequence[str], alpha: float) -> DataFrame:
    """For each cell: synthetic share __s, target share __a, what it is, and how many rows to add."""
    have = dense(rows, domain, attrs).select("cell", F.col("count").alias("h"))
    total = rows.agg(F.count("*").cast("double").alias("n"))
    df = target.select(*attrs, "cell", F.col("share").alias("__a")).join(have, "cell").crossJoin(F.broadcast(total)).withColumn("__s", F.col("h") / F.col("n"))
    kind = F.when((F.col("__s") == 0) & (F.col("__a") > 0), "zero").when(F.col("__s") < F.col("__a"), "under").when(F.col("__s") > F.col("__a"), "over").otherwise("even")
    df = df.withColumn("kind", kind)
    under = F.rint(F.least((F.col("__a") - F.col("__s")) / F.when(F.col("__s") > 0, F.col("__s")), F.lit(alpha)) * F.col("__s") * F.col("n"))
    add = F.when(F.col("kind") == "zero", F.rint(alpha * F.col("__a") * F.col("n"))).when(F.col("kind") == "under", under).otherwise(0.0)
    return df.select(*attrs, "cell", "__s", "__a", "n", "kind", add.cast("long").alias("num_add"))


def beta(cells: DataFrame) -> DataFrame:
    """One row with beta: over cells give min((s - a) / s, beta) of their rows, as many as are added.

    In the order of (s - a) / s, cells below beta give all of their excess; beta solves the linear piece in which it lies.
    """
    over = cells.where("kind = 'over'").withColumn("x", (F.col("__s") - F.col("__a")) / F.col("__s"))
    need = cells.agg(F.sum("num_add").cast("double").alias("need"))
    w = Window.orderBy("x", "cell")
    before = F.coalesce(F.sum((F.col("__s") - F.col("__a")) * F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum(F.col("__s") * F.col("n")).over(w.rowsBetween(0, Window.unboundedFollowing))
    tried = over.crossJoin(F.broadcast(need)).withColumn("i", F.row_number().over(w)).withColumn("b", (F.col("need") - before) / after)
    return tried.agg(F.coalesce(F.min(F.when(F.col("b") <= F.col("x"), F.struct("i", "b")))["b"], F.max("x"), F.lit(0.0)).alias("beta"))


def reduced(cells: DataFrame) -> DataFrame:
    """The sets with num_reduce, the rows that each over cell gives."""
    give = F.rint(F.least((F.col("__s") - F.col("__a")) / F.when(F.col("__s") > 0, F.col("__s")), F.col("beta")) * F.col("__s") * F.col("n"))
    return cells.crossJoin(F.broadcast(beta(cells))).withColumn("num_reduce", F.when(F.col("kind") == "over", give).otherwise(0.0).cast("long")).drop("beta")


def donors(rows: DataFrame, cells: DataFrame, attrs: Sequence[str], key: Column) -> DataFrame:
    """(row_id, slot): the first num_reduce rows of each over cell in the order of `key`.

    A slot is a rank within a cell plus the sum of earlier cells: no order over all rows is needed.
    """
    w = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    give = cells.where("num_reduce > 0").withColumn("offset", F.coalesce(F.sum("num_reduce").over(w), F.lit(0))).select(*attrs, "num_reduce", "offset")
    placed = ordered(rows, key, list(attrs)).join(F.broadcast(give), list(attrs)).where("place < num_reduce")
    return placed.select("row_id", (F.col("offset") + F.col("place")).cast("long").alias("slot"))


def step(rows: DataFrame, target: DataFrame, domain: Domain, attrs: Sequence[str], alpha: float, complete: float, key: Column) -> DataFrame:
    """One update of all rows for one marginal: donors take the codes of zero cells, then of cells that are under.

    Of an under cell's donors a share `complete` becomes copies of its rows, the others only take its attributes.
    """
    attrs = list(attrs)
    cells = local(reduced(sets(rows, target, domain, attrs, alpha)))
    given = donors(rows, cells, attrs, key)
    copies = F.when(F.col("kind") == "under", F.rint(complete * F.col("num_add"))).otherwise(0).cast("long")
    w = Window.orderBy(F.col("kind") != "zero", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cells.where("num_add > 0").withColumn("first", F.coalesce(F.sum("num_add").over(w), F.lit(0))).select(*(F.col(a).alias(f"__{a}") for a in attrs), "first", (F.col("first") + F.col("num_add")).alias("last"), copies.alias("copies"))
    cuts = cuts.withColumn("since", F.col("first"))
    moved = fill(given, cuts, [*(f"__{a}" for a in attrs), "since", "copies"], "slot")
    moved = moved.withColumn("source", F.when(F.col("slot") - F.col("since") < F.col("copies"), F.col("slot") - F.col("since")))
    others = [c for c in rows.columns if c not in attrs and c != "row_id"]
    if not complete or not others:  # a copy of nothing but the attributes themselves
        out = rows.join(moved.select("row_id", *(f"__{a}" for a in attrs), F.lit(True).alias("__moved")), "row_id", "left")
        return out.select(*(F.when(F.col("__moved"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in attrs else F.col(c) for c in rows.columns))
    sources = ordered(rows, key, attrs, "source").drop("row_id")
    sources = sources.select(*(F.col(a).alias(f"__{a}") for a in attrs), "source", *(F.col(c).alias(f"__{c}") for c in others), F.lit(True).alias("__copied"))
    moved = moved.select("row_id", "source", *(f"__{a}" for a in attrs)).join(sources, [*(f"__{a}" for a in attrs), "source"], "left").drop("source").withColumn("__moved", F.lit(True))
    out = rows.join(moved, "row_id", "left")
    new = {a: F.when(F.col("__moved"), F.col(f"__{a}")).otherwise(F.col(a)) for a in attrs} | {c: F.when(F.col("__copied"), F.col(f"__{c}")).otherwise(F.col(c)) for c in others}
    return out.select(*(F.col(c) if c == "row_id" else new[c].alias(c) for c in rows.columns))


class Shard:
    """Rounds over all marginals on one shard's records: the same step on arrays, a row of `x` for each attribute.

    Cells of all records (a row for each marginal) and counts of all cells are kept; a step brings only those of the
    records that it moves up to date.
    """

    def __init__(self, records: np.ndarray, weights: dict[tuple, np.ndarray], axes: dict[tuple, list[int]], shapes: dict[tuple, tuple[int, ...]], targets: dict[tuple, np.ndarray], seed: int) -> None:
        self.x, self.axes, self.shapes, self.targets = np.ascontiguousarray(records.T, np.int64), axes, shapes, targets
        self.rng = np.random.default_rng(seed)
        self.n = self.x.shape[1]
        self.at = {v: k for k, v in enumerate(targets)}
        weight = np.zeros((len(targets), len(self.x)))
        for v, k in self.at.items():
            weight[k, axes[v]] = weights[v]
        self.weight = weight  # cells are far below 2**53, so that products of doubles are exact
        self.cell = (weight @ self.x).astype(np.int64)
        self.ends = np.cumsum([0, *(len(a) for a in targets.values())])
        self.count = np.bincount((self.cell + self.ends[:-1, None]).ravel(), minlength=self.ends[-1])
        self.want = {v: a * self.n for v, a in targets.items()}

    def counts(self, v: tuple) -> np.ndarray:
        return self.count[self.ends[self.at[v]] : self.ends[self.at[v] + 1]]

    def l1(self, v: tuple) -> float:
        return float(np.abs(self.counts(v) - self.want[v]).sum()) / max(self.n, 1)

    def pick(self, cell: np.ndarray, wanted: np.ndarray, have: np.ndarray) -> np.ndarray:
        """The first wanted[c] rows of each cell c in a random order, cell after cell.

        Rows whose random number is so large that they are hardly ever among the first aren't sorted unless a cell falls short.
        """
        asked = np.flatnonzero(wanted)
        row = np.flatnonzero((wanted > 0)[cell])
        mine = cell[row]
        low = len(row).bit_length()
        high = min(31, 62 - len(wanted).bit_length() - low)
        draw = self.rng.integers(0, 1 << 32, len(row), np.uint32)
        enough = np.ones(len(wanted))
        big = asked[have[asked] > 16]
        enough[big] = np.minimum((wanted[big] + 4 * np.sqrt(wanted[big]) + 4) / have[big], 1)
        for bound in ((enough * (2**32 - 1)).astype(np.uint32), None):
            some = np.arange(len(row)) if bound is None else np.flatnonzero(draw <= bound[mine])
            held = mine[some]
            size = np.bincount(held, minlength=len(wanted))
            if bound is None or (size[asked] >= wanted[asked]).all():
                break
        # cell, random number and place in one number each: values are sorted faster than places
        keys = (held << (high + low)) | ((draw[some].astype(np.int64) << high >> 32) << low) | some
        keys.sort()
        times = wanted[asked]
        first = np.cumsum(size)[asked] - size[asked] - (np.cumsum(times) - times)
        return row[keys[np.repeat(first, times) + np.arange(times.sum())] & ((1 << low) - 1)]

    def one(self, v: tuple, alpha: float, complete: float) -> None:
        cell, have, want = self.cell[self.at[v]], self.counts(v), self.want[v]
        live = None
        if len(have) > self.n // 4:  # cells that neither have records nor would get one change nothing
            live = np.flatnonzero((have > 0) | (alpha * want > 0.5))
            place = np.zeros(len(have), np.int64)
            place[live] = np.arange(len(live))
            cell, have, want = place[cell], have[live], want[live]
        gap = want - have
        add = np.rint(np.where(have > 0, np.minimum(gap, alpha * have), alpha * want))
        add[gap <= 0] = 0
        need = add.sum()
        over = np.flatnonzero(gap < 0)
        if not need or not len(over):
            return
        # cells below the limit give all of their excess; what is left to give falls on the others
        give, held = -gap[over], have[over]
        x, left, base, some = give / held, need, held.sum(), np.arange(len(over))
        limit = x.max()
        while len(some):
            below = x[some] < left / base
            if not below.any():
                limit = left / base
                break
            done, some = some[below], some[~below]
            left, base = left - give[done].sum(), base - held[done].sum()
        add = add.astype(np.int64)
        copies = np.where(have > 0, np.rint(complete * add), 0).astype(np.int64)
        wanted = copies.copy()
        wanted[over] = np.rint(np.minimum(give, limit * held))
        rows = self.pick(cell, wanted, have)
        free = self.rng.permutation(rows[np.repeat(gap < 0, wanted)])
        # zero cells take donors first, then those that are under; an under cell's first ones become copies of its rows
        todo = np.flatnonzero(add)
        empty = have[todo] == 0
        todo = np.concatenate([todo[empty], todo[~empty]])
        times = add[todo]
        to = np.repeat(todo, times)[: len(free)]
        turn = (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))[: len(free)]
        free = free[: len(to)]
        if not len(free):
            return
        whole = np.flatnonzero(turn < copies[to])
        source = rows[(np.cumsum(wanted) - wanted)[to[whole]] + turn[whole]]
        new = np.take(self.x, free, 1)
        new[:, whole] = np.take(self.x, source, 1)
        for k, codes in zip(self.axes[v], np.unravel_index(to if live is None else live[to], self.shapes[v]), strict=True):
            new[k] = codes
        was, now = np.take(self.cell, free, 1), (self.weight @ new).astype(np.int64)
        self.x[:, free] = new
        self.cell[:, free] = now
        np.subtract.at(self.count, (was + self.ends[:-1, None]).ravel(), 1)
        np.add.at(self.count, (now + self.ends[:-1, None]).ravel(), 1)

    def run(self, rounds: int, method: str, first: float, policy: str) -> None:
        for i in range(rounds):
            alpha, complete = rate(method, i, first), POLICIES[policy][i % 2]
            for v in sorted(self.targets, key=lambda v: -self.l1(v)):
                self.one(v, alpha, complete)


def deal(domain: Domain, targets: dict[tuple, np.ndarray], shards: int) -> tuple[str | None, np.ndarray]:
    """The attribute whose codes are dealt to shards, and the shard of each code; None if every shard can have all codes.

    A shard with some records of every code has less than one for most cells of a large marginal, and rounding then keeps it
    from its targets. Shards get whole codes of the largest attribute instead, at random and about the same share of records.
    """
    alike = None, np.zeros(0, np.int64)
    if shards == 1 or max(len(x) for x in targets.values()) <= SPARSE_CELLS:
        return alike
    by = max((a for v in targets for a in v), key=lambda a: domain[a])
    view = next(v for v in targets if by in v)
    share = targets[view].reshape(domain.project(view).shape).sum(tuple(k for k, a in enumerate(view) if a != by))
    if domain[by] < 4 * shards or share.max() * shards > 1:
        return alike
    home, rng = np.zeros(domain[by], np.int64), np.random.default_rng(0)
    codes = rng.permutation(domain[by])
    codes = codes[np.argsort(-share[codes], kind="stable")]
    loads = [(0.0, k) for k in range(shards)]
    for c in codes:
        load, k = heapq.heappop(loads)
        home[c] = k
        heapq.heappush(loads, (load + share[c], k))
    return by, home


def run_shards(rows: DataFrame, domain: Domain, targets: dict[tuple, np.ndarray], shards: int, rounds: int, method: str = "U4", first: float = 1.0, policy: str = "S5", seed: int = 0) -> DataFrame:
    """All rounds on each shard by itself: one shuffle, no job for each round.

    Targets are shares, so shards are exchangeable, or their targets are those of their codes (see `deal`). Marginals (capped
    in cells) go out with the task. The steps are those of Shard, in the JVM (Rounds.java).
    """
    attrs, spark = list(domain.attrs), rows.sparkSession
    ordered_targets = {domain.canonical(v): x.reshape(domain.project(v).shape).transpose([v.index(a) for a in domain.canonical(v)]).ravel() for v, x in targets.items()}
    weight = np.zeros((len(targets), len(attrs)), np.int64)
    for k, v in enumerate(ordered_targets):
        weight[k, list(domain.axes(v))] = domain.weights(v)
    ends = np.cumsum([0, *(len(x) for x in ordered_targets.values())])
    by, home = deal(domain, ordered_targets, shards)
    if by is None:
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards)).cast("int"))
    else:
        homes = spark.createDataFrame(list(enumerate(home.tolist())), f"`{by}` int, shard int")
        dealt = rows.join(F.broadcast(homes), by)
    dealt = dealt.select("shard", "row_id", *(F.col(a).cast("int").alias(a) for a in attrs))
    dealt = dealt.repartition(3 * shards, "shard")  # few tasks get two shards, and none waits for one with many
    alpha, complete = [rate(method, i, first) for i in range(rounds)], [POLICIES[policy][i % 2] for i in range(rounds)]
    return jvm_rounds.run(dealt, domain.shape, -1 if by is None else attrs.index(by), home, weight, ends, np.concatenate(list(ordered_targets.values())), alpha, complete, seed)


def errors(rows: DataFrame, targets: dict[tuple, np.ndarray], domain: Domain) -> dict[tuple, float]:
    """L1 error of each marginal; the marginals come from shared scans."""
    from tabveil.operators.marginals import cell_of, count_sets

    n = rows.count()
    counts = count_sets(rows, list(targets)).persist()
    out = {}
    for v, a in targets.items():
        have = np.zeros(len(a))
        for r in counts.where(F.col("view") == ",".join(v)).select(cell_of(domain, v).alias("c"), "count").collect():  # a marginal's cells
            have[r["c"]] = r["count"]
        out[v] = float(np.abs(have / n - a).sum())
    counts.unpersist()
    return out
