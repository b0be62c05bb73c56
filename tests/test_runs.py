"""Whole runs through a store: drivers, dumps, selections used again, ways to start, and what the records keep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabveil import main
from tabveil.config import FieldSpec, RunConfig, from_args
from tabveil.operators import marginals, metrics, update
from tabveil.plans import selection
from tabveil.plans.pipeline import Pipeline
from tabveil.sources.store import RunStore

FIELDS = {"flag": FieldSpec("categorical"), "status": FieldSpec("categorical"), "line": FieldSpec("binned_integer", 1), "dstip": FieldSpec("binned-ip", 30), "price": FieldSpec("float-exponential", 2)}
COLUMNS = {"flag": "l_returnflag", "status": "l_linestatus", "line": "l_linenumber", "dstip": "l_suppkey", "price": "l_extendedprice"}


def config(**more):
    return RunConfig(**{"dataset_name": "lines", "num_synthesize_records": 3000, "update_iterations": 40, "seed": 1, "noise": "keyed", "threshold": 10, "pred_attr": "flag", "epsilon": 8.0} | more)


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*(F.col(c).alias(a) for a, c in COLUMNS.items())).persist()


@pytest.fixture(scope="module")
def folder(spark, raw, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    raw.coalesce(1).write.option("header", True).csv(str(root / "raw"))
    return str(root)


def test_drivers(spark, raw, folder):
    c = config(dump_marginal="status_flag")
    store = main.preprocess(spark, folder, c, f"{folder}/raw", FIELDS)
    assert store.load("codes").count() == raw.count()
    trivial = main.trace(spark, store.path("trivial"), FIELDS)
    assert metrics.jsd(raw, trivial, ["flag", "status"]).first()[0] < 1e-6
    out = main.synthesize(spark, folder, c)
    assert spark.read.parquet(store.path("synthesized")).count() == 3000
    assert store.load_marginals() == out.marginals
    for stage in ("synthesize", "postprocessing"):
        rows = spark.read.option("header", True).csv(store.path(f"dump/{stage}"))
        assert set(rows.columns) == {"flag", "status", "count"} and rows.agg(F.sum(F.col("count").cast("long"))).first()[0] == 3000
    if any({"flag", "status"} == set(m) for m in out.targets):
        for stage in ("construct", "anonymize", "consist"):
            assert spark.read.option("header", True).csv(store.path(f"dump/{stage}")).count() > 0
    got = main.evaluate(spark, folder, c, f"{folder}/raw", FIELDS, models=("dt",))
    assert {(r["source"], r["model"]) for r in got["accuracy"].collect()} == {("raw", "dt"), ("syn", "dt")}
    assert got["sketches"].count() == 4


def test_selections_are_used_again(spark, raw, tmp_path):
    store = RunStore(spark, str(tmp_path), "lines", 8.0)
    first = Pipeline(config(update_iterations=0), store).run(raw, FIELDS)
    store.save_marginals([("flag", "price"), ("line", "dstip")])
    again = Pipeline(config(update_iterations=0, is_cal_marginals=False), store).run(raw, FIELDS)
    assert again.marginals == [("flag", "price"), ("line", "dstip")]
    assert "dependence" in dict(first.ledger.entries) and "dependence" not in dict(again.ledger.entries)
    same = Pipeline(config(update_iterations=0, is_cal_depend=False), store).run(raw, FIELDS)
    assert same.marginals == first.marginals
    with pytest.raises(ValueError):
        Pipeline(config(is_cal_marginals=False)).run(raw, FIELDS)


@pytest.mark.parametrize("how, more", [("singleton", {}), ("marginal_auto", {}), ("marginal_manual", {"initial_marginals": (("flag", "status"),)}), ("random", {})])
def test_ways_to_start(spark, raw, tmp_path, how, more):
    store = RunStore(spark, str(tmp_path), "lines", 8.0)
    store.save_marginals([("flag", "status"), ("flag", "price"), ("line", "dstip")])
    run = Pipeline(config(update_iterations=0, is_cal_marginals=False, append=False, initialize_method=how, **more), store)
    out = run.run(raw, FIELDS)
    assert out.codes.count() == 3000
    near = metrics.jsd(raw, out.table, ["flag", "status"]).first()[0]
    if how.startswith("marginal"):
        assert near < 0.05
    if how == "singleton":  # single attributes are right, and independent
        assert metrics.jsd(raw, out.table, ["status"]).first()[0] < 0.05
        assert abs(out.codes.agg(F.corr("line", "price")).first()[0]) < 0.06
    run.release()


def test_records_keep_what_was_selected(spark, raw):
    run = Pipeline(config(update_iterations=200, num_synthesize_records=6000, append=False, charge_recode=False))
    out = run.run(raw, FIELDS)
    wanted = [m for m in out.marginals if len(m) > 1]
    assert wanted
    assert all(metrics.jsd(raw, out.table, [a]).first()[0] < 0.12 for a in ("flag", "status"))
    one, both = (metrics.jsd(raw, out.table, list(k)).first()[0] for k in (("flag",), ("flag", "status")))
    assert both < 0.15 and one < 0.1
    run.release()


def test_start_is_far_and_updates_come_near(spark):
    rng = np.random.default_rng(2)
    domain = main.codec.Domain.from_dict({"a": 4, "b": 5, "c": 3})
    targets = {("a", "b"): rng.dirichlet(np.ones(20) * 0.3), ("b", "c"): None}
    b = targets["a", "b"].reshape(4, 5).sum(0)
    targets["b", "c"] = (b[:, None] * rng.dirichlet(np.ones(3), 5)).ravel()
    full = {("a",): targets["a", "b"].reshape(4, 5).sum(1), ("b",): b, ("c",): targets["b", "c"].reshape(5, 3).sum(0)} | targets
    run = Pipeline(config())
    rows = run.initialise(spark, domain, full, ["a", "b", "c"], 20_000, list(targets))
    before = update.errors(rows, targets, domain)
    after = update.errors(update.run_shards(rows, domain, targets, 2, 200, seed=3), targets, domain)
    assert all(after[v] < 0.02 < before[v] for v in targets)
    # a pair that no target holds stays as independent as the others make it
    a_c = np.einsum("ab,bc->ac", targets["a", "b"].reshape(4, 5), targets["b", "c"].reshape(5, 3) / np.maximum(b[:, None], 1e-12))
    counts = np.zeros((4, 3))
    for r in marginals.observed(rows, ["a", "c"]).collect():
        counts[r["a"], r["c"]] = r["count"] / 20_000
    assert np.abs(counts - np.outer(full["a",], full["c",])).sum() < 0.03 and a_c.shape == (4, 3)


def test_ranks_and_options():
    x = np.array([0.4, 0.1, 0.1, 0.4])
    assert selection.mean_correlation(x, (2, 2), 0) == pytest.approx(0.6)
    assert selection.rank([("t", "a"), ("t", "b"), ("t", "a", "b")], {("t", "a"): 0.1, ("t", "b"): 0.5, ("t", "a", "b"): 0.9}) == [("t", "b"), ("t", "a"), ("t", "a", "b")]
    c = from_args(["--initialize_method", "marginal_manual", "--initial_marginals", "a_b,c_d"])
    assert c.initial_marginals == (("a", "b"), ("c", "d"))
