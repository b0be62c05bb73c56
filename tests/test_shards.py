"""Counting of all marginals by one key, and the bookkeeping of shards."""

import numpy as np
from pyspark.sql import functions as F

from tabveil.domain import Domain
from tabveil.operators import marginals, update


def test_cells_of_many_marginals(spark):
    domain = Domain.from_dict({"a": 3, "b": 4, "c": 5, "d": 2})
    df = spark.range(500).select(*((F.pmod(F.xxhash64("id", F.lit(a)), F.lit(domain[a] - (a == "c")))).cast("int").alias(a) for a in domain.attrs))
    sets = [("a", "b"), ("a", "b", "c", "d"), ("c",), ("b", "d"), ("d",)]
    counts, first = marginals.count_cells(df, domain, sets)
    got = np.zeros(first[-1] + 2)
    for r in counts.collect():
        got[r["key"]] = r["count"]
    for v, at in zip(sets, first, strict=True):
        dense = [r["count"] for r in marginals.dense(df, domain, v).orderBy("cell").collect()]
        assert got[at : at + domain.size(v)].tolist() == dense
    assert "Expand" not in counts._jdf.queryExecution().toString()  # code for many grouping sets is too long to be compiled


def shard(n=4000, seed=1):
    rng = np.random.default_rng(seed)
    views = {("a", "b"): [0, 1], ("b", "c"): [1, 2], ("a",): [0]}
    sizes = [6, 40, 3]
    shapes = {v: tuple(sizes[k] for k in axes) for v, axes in views.items()}
    weights = {v: np.array([int(np.prod(s[k + 1 :])) for k in range(len(s))], np.int64) for v, s in shapes.items()}
    full = rng.dirichlet(np.ones(6 * 40 * 3) * 0.2).reshape(sizes)
    targets = {v: full.sum(tuple(k for k in range(3) if k not in axes)).ravel() for v, axes in views.items()}
    return update.Shard(np.column_stack([rng.integers(0, s, n) for s in sizes]), weights, views, shapes, targets, seed)


def test_shard_keeps_its_counts():
    s = shard()
    before = sum(s.l1(v) for v in s.targets)
    s.run(30, "U4", 1.0, "S5")
    for v, k in s.at.items():
        cell = np.ravel_multi_index([s.x[a] for a in s.axes[v]], s.shapes[v])
        assert (s.cell[k] == cell).all() and (s.counts(v) == np.bincount(cell, minlength=len(s.targets[v]))).all()
    assert sum(s.l1(v) for v in s.targets) < before / 8


def test_sparse_cells_are_left_out_without_a_change():
    s = shard(300)  # 240 cells, of which a quarter of the records' number is less: the short way
    before = sum(s.l1(v) for v in s.targets)
    s.run(10, "U4", 1.0, "S5")
    for v, k in s.at.items():
        assert (s.cell[k] == np.ravel_multi_index([s.x[a] for a in s.axes[v]], s.shapes[v])).all()
        assert (s.counts(v) == np.bincount(s.cell[k], minlength=len(s.targets[v]))).all()
    assert sum(s.l1(v) for v in s.targets) < before / 2


def test_picks_are_exact_and_even():
    s = shard()
    rng = np.random.default_rng(5)
    cell = rng.integers(0, 30, 3000)
    have = np.bincount(cell, minlength=30)
    wanted = np.minimum(rng.integers(0, 120, 30), have)
    wanted[::3], wanted[1] = 0, have[1]
    hits = np.zeros(3000)
    for _ in range(300):
        rows = s.pick(cell, wanted, have)
        assert (np.bincount(cell[rows], minlength=30) == wanted).all() and len(np.unique(rows)) == len(rows)
        assert (np.diff(cell[rows]) >= 0).all()
        hits[rows] += 1
    share = (wanted / have)[cell]
    assert (np.abs(hits / 300 - share) <= 6 * np.sqrt(share * (1 - share) / 300) + 1e-12).all()


def test_shards_are_dealt_to_tasks_of_their_own(spark):
    domain = Domain.from_dict({"a": 3, "b": 2})
    rows = spark.range(900).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("a"), (F.col("id") % 2).cast("int").alias("b"))
    out = update.run_shards(rows, domain, {("a", "b"): np.array([0.3, 0.1, 0.1, 0.2, 0.1, 0.2])}, 9, 5)
    assert out.rdd.getNumPartitions() > 9 and out.select("row_id").distinct().count() == 900


def test_shards_of_some_codes_agree_with_all_targets(spark):
    rng = np.random.default_rng(4)
    domain = Domain.from_dict({"a": 4, "s": 3000, "b": 9})
    full = rng.dirichlet(np.ones(4 * 9) * 0.5).reshape(4, 1, 9) * rng.gamma(2, size=(4, 3000, 1)) * rng.gamma(8, size=(1, 3000, 9))
    full /= full.sum()
    targets = {("a", "s"): full.sum(2).ravel(), ("s", "b"): full.sum(0).ravel(), ("a", "b"): full.sum(1).ravel()}
    by, home = update.deal(domain, targets, 8)
    assert by == "s" and set(home) == set(range(8))
    share = np.bincount(home, full.sum((0, 2)))
    assert abs(share - 1 / 8).max() < 0.01
    n = 240_000
    codes = {a: rng.permutation(np.repeat(np.arange(domain[a]), np.diff(np.rint(np.cumsum([0, *full.sum(tuple(k for k in range(3) if k != i))]) * n).astype(int)))) for i, a in enumerate(domain.attrs)}
    import pandas as pd

    rows = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n), **{a: x.astype(np.int32) for a, x in codes.items()}}))
    out = update.run_shards(rows, domain, targets, 8, 60, seed=2).persist()
    after = update.errors(out, targets, domain)
    assert after["a", "b"] < 0.02 and after["a", "s"] < 0.06 and after["s", "b"] < 0.15
    assert out.select("row_id").distinct().count() == n and out.columns == ["row_id", "a", "s", "b"]
    again = update.run_shards(rows.repartition(7), domain, targets, 8, 60, seed=2)
    assert out.exceptAll(again).count() == 0
    out.unpersist()
