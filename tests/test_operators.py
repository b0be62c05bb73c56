"""Golden values, invariants and whole runs."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabveil.config import FieldSpec, RunConfig, from_args, str2bool
from tabveil.domain import Domain
from tabveil.functions import codec, privacy
from tabveil.functions.binning import bin_exponential, bin_integer, bin_port, half_even
from tabveil.operators import consistency, marginals, metrics, nonneg, sketches, update
from tabveil.plans import selection
from tabveil.plans.pipeline import Pipeline
from tabveil.sources.store import RunStore, read_csv, write_csv


def test_domain():
    a, b = Domain.from_dict({"a": 10, "b": 20}), Domain.from_dict({"b": 20, "c": 30})
    assert a.merge(b).sizes == {"a": 10, "b": 20, "c": 30}
    assert a.size() == 200 and a.weights(["a", "b"]) == (20, 1)
    assert a.project("b").shape == (20,) and a.marginalize(["b"]).attrs == ("a",)
    assert a.resized("a", 3)["a"] == 3 and a.contains(a.project("a")) and not a.contains(b)
    with pytest.raises(ValueError):
        Domain(("a",), (1, 2))
    with pytest.raises(ValueError):
        Domain.from_dict({"a": 1 << 40, "b": 1 << 40}).weights(["a", "b"])


def test_config():
    assert from_args([]) == RunConfig()
    assert from_args(["--epsilon", "1.5", "--append", "no"]).append is False
    assert str2bool("Yes") and not str2bool("0")
    with pytest.raises(ValueError):
        FieldSpec("unknown")


def test_binning(spark):
    df = spark.createDataFrame([(0.0,), (9.0,), (10.0,), (25.0,), (30.0,)], ["x"])
    assert [r[0] for r in df.select(bin_integer(F.col("x"), 10)).collect()] == [1, 1, 2, 3, 4]
    df = spark.createDataFrame([(0.0,), (1.0,), (8.0,), (0.001,), (2.0**29,)], ["x"])
    assert [r[0] for r in df.select(bin_exponential(F.col("x"))).collect()] == [0, 0, 3, -9, 30]
    assert spark.range(1).select(bin_port(F.lit(65535))).first()[0] == 7475
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], ["x"])
    assert [r[0] for r in df.select(half_even(F.col("x"))).collect()] == [0, 2, 2]


def test_privacy(spark):
    assert privacy.gaussian_sigma(1.8, 1 / 60000**2) == pytest.approx(3.759379635392181)
    assert privacy.gaussian_sigma(1.8, 1 / 60000**2, 1, 20) == pytest.approx(16.812456835930583)
    z = spark.range(1).select(privacy.keyed_normal(F.lit("7|v|3"))).first()[0]
    assert z == pytest.approx(-0.3273063384351781, abs=1e-12)
    got = privacy.allocate({"a": 4, "b": 16}, "A3", 1.0, 1.0)
    assert got["b"]["rho"] == pytest.approx(2 / 3)
    draw = spark.range(20000).select(privacy.noise(3.0, seed=1).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(draw[0]) < 0.15 and draw[1] == pytest.approx(3, rel=0.05)


def test_golden_cut(spark):
    v = np.array([-1.5, -2.5, 2, 1, 10.0])
    assert nonneg.cut_array(v).tolist() == [0, 0, 0, 0, 9]
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], ["cell", "count"])
    assert [r["count"] for r in nonneg.norm_cut(df).orderBy("cell").collect()] == [0, 0, 0, 0, 9]
    assert [r["count"] for r in nonneg.norm_sub(df).orderBy("cell").collect()] == pytest.approx(nonneg.sub_array(v).tolist())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=1, max_size=30))
def test_totals_stay(values):
    v = np.array(values)
    for f in (nonneg.cut_array, nonneg.sub_array):
        out = f(v)
        assert (out >= -1e-9).all()
        if v.sum() > 0:
            assert out.sum() == pytest.approx(v.sum(), abs=1e-6)


def test_graphs():
    graph = [("A", "B"), ("B", "C"), ("C", "A"), ("B", "D"), ("C", "E")]
    layers, rest = selection.clip(graph)
    assert [x.ancestor for x in layers] == [{"D": "B", "E": "C"}]
    assert rest == [("A", "B"), ("B", "C"), ("C", "A")]
    assert selection.clip([("A", "B")])[0][0].ancestor == {"A": "B"}
    assert selection.cliques(graph)[3] == [("A", "B", "C")]
    assert selection.missing(graph, [("A", "B", "C")]) == [("B", "D"), ("C", "E")]
    assert len(selection.components([("A", "B"), ("C", "D")], "ABCDE")) == 3
    assert selection.cover([("t", "a"), ("t", "a", "b"), ("c", "d")], "t") == [("t", "a", "b")]
    pairs = [("A", "B", 10, 0.9), ("A", "C", 10, 0.5), ("B", "C", 10, 0.0)]
    assert selection.greedy(pairs, 10_000, 1.0, threshold=100) == [("A", "B"), ("A", "C"), ("B", "C")]
    assert selection.greedy([("A", "B", 10**9, 1e-9)], 10, 1.0) == []
    assert selection.attach_isolated([("A", "B")], "ABC", [("A", "C", 4, 0.2), ("B", "C", 4, 0.4)]) == [("A", "B"), ("B", "C")]


def test_consistency():
    dom = Domain.from_dict({"a": 2, "b": 4, "c": 3})
    rng = np.random.default_rng(1)
    views = {("a", "b"): rng.uniform(5, 9, 8), ("a", "c"): rng.uniform(5, 9, 6), ("a",): rng.uniform(20, 30, 2)}
    out, _, gap = consistency.consist(views, dom, dict.fromkeys(views, 0.5))
    assert gap < 1e-4
    assert out["a", "b"].reshape(2, 4).sum(1) == pytest.approx(out["a",], abs=1e-3)
    assert out["a", "c"].reshape(2, 3).sum(1) == pytest.approx(out["a",], abs=1e-3)


def test_codes_out_of_domain(spark):
    df = spark.createDataFrame([(5,)], "a int")
    with pytest.raises(Exception, match="outside the domain"):
        marginals.dense(df, Domain.from_dict({"a": 3}), ["a"]).collect()
    with pytest.raises(ValueError):
        marginals.cells(spark, Domain.from_dict({"a": 10**9}), ["a"])


def test_metrics_of_equal_tables(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("x"), (F.col("id") % 3).alias("y"))
    assert metrics.jsd(df, df, ["x"]).first()[0] == pytest.approx(0)
    assert [r["emd"] for r in metrics.emd(df, df, ["x", "y"]).collect()] == [0, 0]
    apart = metrics.jsd(df.select(F.lit(1).alias("x")), df.select(F.lit(2).alias("x")), ["x"]).first()[0]
    assert apart == pytest.approx(math.sqrt(math.log(2)))


def test_sketches(spark):
    assert sketches.layer_widths(1000, 10) == [1000, 500, 250, 125, 62, 31, 15, 7, 3, 1]
    df = spark.createDataFrame([("10",)], ["x"])
    assert df.select(sketches.sha_bucket(F.lit("1"), F.lit("0"), 1000)).first()[0] == 317
    rows = spark.range(5000).select((F.col("id") % 50).alias("k"))
    est = sketches.estimates(rows, "k", "cms").collect()
    assert all(r["estimate"] >= 100 for r in est)
    signed = sketches.signed_query(rows.select(F.col("k").alias("key")).distinct(), sketches.signed(rows, "k", 5, 1000), 5, 1000)
    assert signed.agg(F.avg("estimate")).first()[0] == pytest.approx(100, rel=0.1)


def test_rates():
    assert update.rate("U4", 45) == pytest.approx(0.84**2) and update.rate("U9", 5) == 0.2
    assert update.rate("U3", 120) == pytest.approx(0.98**100 * 0.99**20)


def test_shard_lowers_error():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (3000, 2))
    target = rng.dirichlet(np.ones(9))
    v = ("a", "b")
    shard = update.Shard(x, {v: np.array([3, 1])}, {v: [0, 1]}, {v: (3, 3)}, {v: target}, 1)
    before = shard.l1(v)
    shard.run(20, "U4", 1.0, "S5")
    assert shard.l1(v) < before / 5


def test_step_copies_rows(spark):
    rows = spark.createDataFrame([(i, 0 if i < 60 else 1, i) for i in range(100)], "row_id long, a int, extra long")
    dom = Domain.from_dict({"a": 2})
    target = marginals.normalize(spark.createDataFrame([(0, 0, 40.0), (1, 1, 60.0)], "a int, cell long, count double"))
    out = update.step(rows, target, dom, ["a"], 1.0, 0.5, F.col("row_id")).persist()
    assert out.count() == 100
    assert out.where("a = 1").count() == 60
    assert out.where("extra <> row_id").count() == 10


def test_round_trip_and_run(spark, sf_dir, tmp_path):
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_linenumber", "l_shipdate", "l_extendedprice")
    fields = {"l_returnflag": FieldSpec("categorical"), "l_linestatus": FieldSpec("categorical"), "l_linenumber": FieldSpec("categorical"), "l_shipdate": FieldSpec("timestamp", 86_400_000_000 * 90, diff_bin=86_400_000_000), "l_extendedprice": FieldSpec("float-exponential", 2)}
    model = codec.fit(raw, fields)
    codes = model.encode(raw)
    assert codes.columns == list(model.domain.attrs) and codes.columns[-1] == "ts_diff"
    store = RunStore(spark, str(tmp_path), "x", 2.0)
    store.save_codec(model)
    store.save("codes", codes)
    store.save_marginals([("a", "b")])
    assert store.load_marginals() == [("a", "b")]
    back = store.decode_saved("codes", seed=1)
    assert {r[0] for r in back.select("l_returnflag").distinct().collect()} == {r[0] for r in raw.select("l_returnflag").distinct().collect()}
    write_csv(back, str(tmp_path / "csv"))
    assert read_csv(spark, str(tmp_path / "csv"), back.schema).count() == raw.count()
    config = RunConfig(num_synthesize_records=2000, update_iterations=5, seed=1, noise="none", threshold=10, pred_attr="l_returnflag")
    got = Pipeline(config).run(raw, fields)
    assert got.table.count() == 2000 and not got.ledger.over
    assert metrics.jsd(raw, got.table, ["l_returnflag"]).first()[0] < 0.1


def test_streaming(spark, sf_dir):
    from tabveil.streaming.counts import running_marginal, running_sketch

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    for name, build in (("m", lambda s: running_marginal(s, ["event_type"])), ("k", lambda s: running_sketch(s, "user_id", 3, 50))):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        q = build(stream).writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert {tuple(r) for r in spark.table("m").collect()} == {tuple(r) for r in rows.groupBy("event_type").count().collect()}
    want = sketches.build(rows, "user_id", 3, 50)
    assert {tuple(r) for r in spark.table("k").collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize("n", [1, 2, 7, 101, 60_000, 600_000])
def test_permutations_of_places_are_independent(spark, n):
    from tabveil.operators import quota

    names = list("abcdef")
    got = quota.permuted(spark.range(n), "id", n, {c: f"0|{c}" for c in names})
    checks = [F.count_distinct(c) for c in names] + [F.min(c) for c in names] + [F.max(c) for c in names]
    assert list(got.agg(*checks).first()) == [n] * 6 + [0] * 6 + [n - 1] * 6
    if n >= 60_000:
        pairs = [F.corr(a, b) for k, a in enumerate(["id", *names]) for b in ["id", *names][k + 1 :]]
        assert max(map(abs, got.agg(*pairs).first())) < 0.02


def test_places_in_buckets_are_those_of_one_window(spark):
    from tabveil.operators import quota

    df = spark.range(3000).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("g"), F.xxhash64("id").alias("h"))
    one = {(r["id"], r["place"]) for r in quota.ordered(df, F.col("h"), ["g"]).collect()}
    assert {(r["id"], r["place"]) for r in quota.ordered(df, F.col("h"), ["g"], at_once=100).collect()} == one
    pairs = quota.ordered(df, F.struct("id", "h"), ["g"], spread=F.col("id"), at_once=50)
    assert {(r["id"], r["place"]) for r in pairs.collect()} == {(r["id"], r["place"]) for r in quota.ordered(df, F.col("id"), ["g"]).collect()}


def test_dictionaries_beyond_the_driver(spark, monkeypatch):
    df = spark.createDataFrame([(x, y) for x, y in zip(["b", None, "a", "c", "b"], [3, 1, 2, 2, None], strict=True)], "x string, y int")
    want = {("b", 1, 3), (None, None, 1), ("a", 0, 2), ("c", 2, 2), ("b", 1, None)}
    for values, literals in ((100_000, 64), (100_000, 0), (2, 64)):
        monkeypatch.setattr(codec, "LOCAL_VALUES", values)
        monkeypatch.setattr(codec, "LITERALS", literals)
        out, sizes = codec.labels(df, {"code": F.col("x")})
        assert sizes == {"code": 3} and {tuple(r) for r in out.select("x", "code", "y").collect()} == want


def test_unknown_codes_are_an_error(spark):
    from tabveil.operators import recode

    mapping = spark.createDataFrame([(0, 0, False)], "old_code int, new_code int, is_group boolean")
    with pytest.raises(Exception, match="lacks"):
        recode.recode(spark.createDataFrame([(0,), (5,)], "a int"), "a", mapping).collect()
