"""One query for each operator on the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabveil.config import FieldSpec, RunConfig
from tabveil.domain import Domain
from tabveil.functions import binning, codec, privacy
from tabveil.operators import consistency, dependence, marginals, metrics, mlbench, nonneg, quota, recode, sketches, update
from tabveil.plans import selection
from tabveil.plans.pipeline import Pipeline
from tabveil.sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r(c, n: int = 9):
    return F.round(c, n)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


LINE = {"rf": "l_returnflag", "ls": "l_linestatus", "ln": "l_linenumber", "q": "l_quantity", "dc": "l_discount"}


def encoded(spark: SparkSession, d: str, table: str, columns: dict[str, str], extra: tuple[str, ...] = ()) -> tuple[DataFrame, Domain]:
    """Label codes under short names, and their domain."""
    df = t(spark, d, table).select(*columns.values(), *extra)
    df, sizes = codec.labels(df, {a: F.col(c) for a, c in columns.items()})
    return df.select(*columns, *extra), Domain.from_dict(sizes)


def line(spark: SparkSession, d: str, *names: str, extra: tuple[str, ...] = ()) -> tuple[DataFrame, Domain]:
    return encoded(spark, d, "lineitem", {a: LINE[a] for a in names}, extra)


def orders(spark: SparkSession, d: str) -> tuple[DataFrame, Domain]:
    df, dom = encoded(spark, d, "orders", {"s": "o_orderstatus", "p": "o_orderpriority"}, ("o_orderkey",))
    return df.withColumnRenamed("o_orderkey", "row_id"), dom


def z_sql(key: str, kind: str = "gauss") -> str:
    """Keyed noise in SQL: two 48-bit numbers from a digest."""
    u = f"((('0x' || substr(sha256({key} || '|a'), 1, 12))::BIGINT + 0.5e0) / 281474976710656e0)"
    v = f"(('0x' || substr(sha256({key} || '|b'), 1, 12))::BIGINT / 281474976710656e0)"
    return f"(sqrt(-2 * ln({u})) * cos(2 * pi() * {v}))" if kind == "gauss" else f"(-sign({u} - 0.5e0) * ln(1 - 2 * abs({u} - 0.5e0)))"


def codes_sql(name: str, table: str, columns: dict[str, str], extra: str = "") -> str:
    return f"{name} AS (SELECT " + ", ".join(f"(dense_rank() OVER (ORDER BY {c}) - 1)::BIGINT AS {a}" for a, c in columns.items()) + f"{', ' + extra if extra else ''} FROM {table})"


ORD = codes_sql("ord", "orders", {"s": "o_orderstatus", "p": "o_orderpriority"}, "o_orderkey AS row_id")
MARG = f"""{ORD}, sz AS (SELECT max(s) + 1 AS ns, max(p) + 1 AS np, count(*) AS n FROM ord),
marg AS (SELECT a.s, b.p, a.s * np + b.p AS cell, coalesce(c.n, 0)::DOUBLE AS count
 FROM (SELECT DISTINCT s FROM ord) a CROSS JOIN (SELECT DISTINCT p FROM ord) b CROSS JOIN sz
 LEFT JOIN (SELECT s, p, count(*) AS n FROM ord GROUP BY s, p) c ON c.s = a.s AND c.p = b.p)"""


def noisy_sql(scale: str, seed: int = 7, kind: str = "gauss") -> str:
    return f"{MARG}, noisy AS (SELECT s, p, cell, count + {scale} * {z_sql(f"('{seed}|sp|' || cell)", kind)} AS count FROM marg)"


def noisy(spark: SparkSession, d: str, scale: float, seed: int = 7, kind: str = "gauss") -> tuple[DataFrame, DataFrame, Domain]:
    df, dom = orders(spark, d)
    m = marginals.dense(df, dom, ["s", "p"])
    key = F.concat(F.lit(f"{seed}|sp|"), F.col("cell").cast("string"))
    return df, m.withColumn("count", F.col("count") + privacy.noise(scale, kind, "keyed", key)), dom


def rounded_cells(m: DataFrame, n: int = 6) -> DataFrame:
    return m.select("s", "p", "cell", r("count", n).alias("count"))


# ---- encoding


@query("SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS code FROM orders")
def enc_label(spark, d):
    return codec.label(t(spark, d, "orders"), "o_orderpriority", to="code").select("o_orderkey", "code")


@query("SELECT l_orderkey, l_linenumber, (dense_rank() OVER (ORDER BY l_suppkey >> 2) - 1)::INT AS code FROM lineitem")
def enc_ip_bin(spark, d):
    return codec.label(t(spark, d, "lineitem"), "l_suppkey", binning.bin_ip(F.col("l_suppkey")), "code").select("l_orderkey", "l_linenumber", "code")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey < 1024 THEN l_partkey ELSE 1024 + (l_partkey - 1024) // 10 END AS bin FROM lineitem)
SELECT l_orderkey, l_linenumber, bin::BIGINT AS bin, (dense_rank() OVER (ORDER BY bin) - 1)::INT AS code FROM b""")
def enc_port_bin(spark, d):
    df = t(spark, d, "lineitem").withColumn("bin", binning.bin_port(F.col("l_partkey")))
    return codec.label(df, "bin", to="code").select("l_orderkey", "l_linenumber", "bin", "code")


@query("SELECT p_partkey, (floor(p_size / 10) + 1)::BIGINT AS code FROM part")
def enc_int_bin(spark, d):
    return t(spark, d, "part").select("p_partkey", binning.bin_integer(F.col("p_size"), 10).alias("code"))


TS = FieldSpec("timestamp", bin=86_400_000_000, diff_bin=3_600_000_000)


def _stamps(spark, d):
    df = t(spark, d, "events")
    model = codec.fit(df, {"ts": TS})
    return df, model


@query("SELECT event_id, (floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 86400000000) + 1)::BIGINT AS code FROM events")
def enc_ts_bin(spark, d):
    df, model = _stamps(spark, d)
    return df.select("event_id", codec.binned(F.col("ts"), TS, "timestamp_ntz", model.firsts["ts"]).alias("code"))


@query("""SELECT code, count(*) AS n FROM (SELECT (floor(((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) % 86400000000) / 3600000000) + 1)::INT AS code FROM events) GROUP BY code""")
def enc_ts_diff(spark, d):
    df, model = _stamps(spark, d)
    return model.encode(df).groupBy(F.col("ts_diff").alias("code")).agg(F.count("*").alias("n"))


def exp_sql(v: str, base: int) -> str:
    return f"CASE WHEN {v} <= 0 THEN 0 ELSE ceil(ln({v}) / ln({base}e0)) END"


@query(f"WITH b AS (SELECT event_id, ({exp_sql('value', 2)})::BIGINT AS bin FROM events) SELECT event_id, bin - (SELECT min(bin) FROM b) AS code FROM b")
def enc_exp_float(spark, d):
    df = t(spark, d, "events").select("event_id", "value")
    model = codec.fit(df, {"value": FieldSpec("float-exponential", 2)})
    return model.encode(df, keep=["event_id"]).select("event_id", F.col("value").cast("long").alias("code"))


@query(f"WITH b AS (SELECT o_orderkey, ({exp_sql('floor(o_totalprice)', 2)})::BIGINT AS bin FROM orders) SELECT o_orderkey, bin - (SELECT min(bin) FROM b) AS code FROM b")
def enc_exp_int(spark, d):
    df = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    model = codec.fit(df, {"o_totalprice": FieldSpec("int-exponential", 2)})
    return model.encode(df, keep=["o_orderkey"]).select("o_orderkey", F.col("o_totalprice").cast("long").alias("code"))


@query("""SELECT 'value' AS "column", count(value) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events
UNION ALL SELECT 'user_id', count(user_id), min(user_id)::DOUBLE, max(user_id)::DOUBLE, round(avg(user_id), 6) FROM events""")
def bin_stats(spark, d):
    return codec.bin_stats(t(spark, d, "events"), ["value", "user_id"]).withColumn("mean", r("mean", 6))


@query("SELECT o_orderkey, o_orderpriority AS raw FROM orders")
def dec_label(spark, d):
    df = t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    model = codec.fit(df, {"o_orderpriority": FieldSpec("categorical")})
    return model.decode(model.encode(df, keep=["o_orderkey"])).select("o_orderkey", F.col("o_orderpriority").alias("raw"))


@query("""WITH ip AS (SELECT 'ip' AS kind, l_suppkey AS raw, (l_suppkey >> 2) << 2 AS low FROM lineitem),
port AS (SELECT 'port' AS kind, l_partkey AS raw, CASE WHEN l_partkey < 1024 THEN l_partkey ELSE 1024 + ((l_partkey - 1024) // 10) * 10 END AS low FROM lineitem),
size AS (SELECT 'int' AS kind, p_size::BIGINT AS raw, (floor(p_size / 10) * 10)::BIGINT AS low FROM part)
SELECT kind, raw::BIGINT AS raw, low::BIGINT AS low, (CASE kind WHEN 'ip' THEN low + 3 WHEN 'int' THEN low + 9 ELSE CASE WHEN low < 1024 THEN low ELSE least(low + 9, 65535) END END)::BIGINT AS high, count(*) AS n
FROM (SELECT * FROM ip UNION ALL SELECT * FROM port UNION ALL SELECT * FROM size) GROUP BY ALL""")
def dec_interval_bounds(spark, d):
    li, part = t(spark, d, "lineitem"), t(spark, d, "part")
    parts = []
    for kind, df, raw, code, spec in (("ip", li, "l_suppkey", binning.bin_ip(F.col("l_suppkey")), ("binned-ip", 30)), ("port", li, "l_partkey", binning.bin_port(F.col("l_partkey")), ("binned-port", 10)), ("int", part, "p_size", binning.bin_integer(F.col("p_size"), 10), ("binned_integer", 10))):
        low, high = binning.bounds(spec[0], code, spec[1])
        parts.append(df.select(F.lit(kind).alias("kind"), F.col(raw).cast("long").alias("raw"), low.cast("long").alias("low"), high.cast("long").alias("high")))
    return reduce(DataFrame.union, parts).groupBy("kind", "raw", "low", "high").agg(F.count("*").alias("n"))


@query()
def dec_sampled(spark, d):
    df = t(spark, d, "events").select("ts", "event_type", "value", F.col("user_id"))
    model = codec.fit(df, {"ts": TS, "event_type": FieldSpec("categorical"), "value": FieldSpec("float-exponential", 2), "user_id": FieldSpec("binned-ip", 30)})
    return model.decode(model.encode(df), seed=3)


# ---- marginals


def _line_marginal(names):
    def f(spark, d):
        df, dom = line(spark, d, *names)
        return marginals.observed(df, list(names)).select(*(F.col(a).cast("long").alias(a) for a in names), F.col("count").alias("n"))

    return f


LI = codes_sql("li", "lineitem", LINE, "l_quantity, l_linestatus")
for _k, _names in ((1, ("rf",)), (2, ("rf", "ls")), (3, ("rf", "ls", "ln"))):
    QUERIES[f"marg_{_k}way"] = _line_marginal(_names)
    ORACLE[f"marg_{_k}way"] = f"WITH {LI} SELECT {', '.join(_names)}, count(*) AS n FROM li GROUP BY ALL"


@query(f"WITH {MARG} SELECT s, p, cell, count FROM marg")
def marg_dense(spark, d):
    df, dom = orders(spark, d)
    return marginals.dense(df, dom, ["s", "p"]).select(F.col("s").cast("long").alias("s"), F.col("p").cast("long").alias("p"), "cell", "count")


_FOUR = ("rf", "ls", "ln", "dc")
_SETS = [(a,) for a in _FOUR] + [(a, b) for i, a in enumerate(_FOUR) for b in _FOUR[i + 1 :]]


@query(f"WITH {LI} " + " UNION ALL ".join(f"SELECT {', '.join(a if a in s else f'NULL::BIGINT AS {a}' for a in _FOUR)}, '{','.join(s)}' AS view, count(*) AS n FROM li GROUP BY {', '.join(s)}" for s in _SETS))
def marg_grouping_sets(spark, d):
    df, _ = line(spark, d, *_FOUR)
    return marginals.count_sets(df, _SETS).select(*(F.col(a).cast("long").alias(a) for a in _FOUR), "view", F.col("count").alias("n"))


@query(f"WITH {LI} SELECT rf, count(*)::DOUBLE AS count FROM li GROUP BY rf")
def marg_rollup(spark, d):
    df, dom = line(spark, d, "rf", "ls", "ln")
    return marginals.roll_up(marginals.dense(df, dom, ["rf", "ls", "ln"]), ["rf"]).withColumn("rf", F.col("rf").cast("long"))


@query(f"WITH {LI} SELECT rf, ls, round(count(*) / (SELECT count(*) FROM li), 9) AS share FROM li GROUP BY rf, ls")
def marg_normalized(spark, d):
    df, _ = line(spark, d, "rf", "ls")
    return marginals.normalize(marginals.observed(df, ["rf", "ls"])).select(F.col("rf").cast("long").alias("rf"), F.col("ls").cast("long").alias("ls"), r("share").alias("share"))


@query(f"""WITH {LI} SELECT rf, count(*) FILTER (ls = 0) AS "0", count(*) FILTER (ls = 1) AS "1" FROM li GROUP BY rf""")
def marg_matrix(spark, d):
    df, _ = line(spark, d, "rf", "ls")
    return marginals.matrix(marginals.observed(df, ["rf", "ls"]), "rf", "ls", [0, 1]).withColumn("rf", F.col("rf").cast("long")).na.fill(0)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 60")
def marg_having(spark, d):
    return marginals.having(marginals.observed(t(spark, d, "events"), ["user_id"]), 60).withColumnRenamed("count", "n")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, user_id, event_type")
def marg_top_dump(spark, d):
    m = marginals.observed(t(spark, d, "events"), ["user_id", "event_type"])
    return marginals.sorted_counts(m).withColumnRenamed("count", "n")


@query(f"WITH {LI} SELECT rf, ls, ln, q, count(*) AS n FROM li GROUP BY ALL")
def full_histogram(spark, d):
    df, _ = line(spark, d, "rf", "ls", "ln", "q")
    return _line_cast(marginals.observed(df, ["rf", "ls", "ln", "q"]), ["rf", "ls", "ln", "q"]).withColumnRenamed("count", "n")


def _line_cast(df, names):
    return df.select(*(F.col(c).cast("long").alias(c) if c in names else F.col(c) for c in df.columns))


# ---- privacy


SIGMA = "(sqrt(2 * {k} * ln(1 / {d})) + sqrt(2 * {k} * ln(1 / {d}) + 2 * {k} * {e})) / (2 * {e})"


def _n(spark, d, table="lineitem"):
    return t(spark, d, table).count()


@query(f"WITH c AS (SELECT 1e0 / (count(*)::DOUBLE * count(*)) AS d FROM lineitem) SELECT k::INT AS k, round({SIGMA.format(k='k', d='d', e='1.8e0')}, 9) AS sigma, round(1 / (2 * pow({SIGMA.format(k='k', d='d', e='1.8e0')}, 2)), 12) AS rho FROM c, (VALUES (1), (20)) AS v(k)")
def zcdp_sigma(spark, d):
    delta = privacy.delta_for(_n(spark, d))
    rows = [(k, privacy.gaussian_sigma(1.8, delta, 1.0, k)) for k in (1, 20)]
    return spark.createDataFrame(rows, "k int, sigma double").select("k", r("sigma").alias("sigma"), r(1 / (2 * F.col("sigma") * F.col("sigma")), 12).alias("rho"))


_VIEWS = {"rf": 3, "ls": 2, "rf,ls": 6, "ln,dc": 77}


def _alloc(method):
    def f(spark, d):
        delta = privacy.delta_for(_n(spark, d))
        got = privacy.allocate(_VIEWS, method, privacy.rho_for(1.8, delta), 1.8)
        return spark.createDataFrame([(v, x["scale"]) for v, x in got.items()], "view string, scale double").select("view", r("scale").alias("scale"))

    return f


_V = ", ".join(f"('{v}', {n}e0)" for v, n in _VIEWS.items())
for _m, _sql in (("a1", "4 / 1.8e0"), ("a2", "sqrt(4 / (2 * rho))"), ("a3", "sqrt((SELECT sum(sqrt(c)) FROM v) / (2 * rho * sqrt(c)))")):
    QUERIES[f"alloc_{_m}"] = _alloc(_m.upper())
    ORACLE[f"alloc_{_m}"] = f"WITH c AS (SELECT 1e0 / (count(*)::DOUBLE * count(*)) AS d FROM lineitem), x AS (SELECT 1 / (2 * pow({SIGMA.format(k='1', d='d', e='1.8e0')}, 2)) AS rho FROM c), v(view, c) AS (VALUES {_V}) SELECT view, round({_sql}, 9) AS scale FROM v, x"


@query(f"WITH {noisy_sql('30e0')} SELECT s, p, cell, round(count, 6) AS count FROM noisy")
def noisy_gauss(spark, d):
    return _line_cast(rounded_cells(noisy(spark, d, 30.0)[1]), ["s", "p"])


@query(f"WITH {noisy_sql('30e0', 8, 'laplace')} SELECT s, p, cell, round(count, 6) AS count FROM noisy")
def noisy_laplace(spark, d):
    return _line_cast(rounded_cells(noisy(spark, d, 30.0, 8, "laplace")[1]), ["s", "p"])


CUT = """cut AS (SELECT s, p, cell, CASE WHEN count <= 0 THEN 0 ELSE least(count, greatest(0, sum(greatest(count, 0)) OVER (ORDER BY count, cell) - (SELECT sum(greatest(-count, 0)) FROM noisy))) END AS count FROM noisy)"""
SUB = """tot AS (SELECT sum(count) AS total FROM noisy), rk AS (SELECT *, row_number() OVER (ORDER BY count DESC, cell) AS r, sum(count) OVER (ORDER BY count DESC, cell) AS c FROM noisy),
dl AS (SELECT (c - total) / r AS d FROM rk, tot WHERE count > (c - total) / r ORDER BY r DESC LIMIT 1),
sub AS (SELECT s, p, cell, CASE WHEN total <= 0 THEN 0 ELSE greatest(0, count - (SELECT d FROM dl)) END AS count FROM noisy, tot)"""


@query(f"WITH {noisy_sql('1500e0')}, {CUT} SELECT s, p, cell, round(count, 6) AS count FROM cut")
def norm_cut(spark, d):
    return _line_cast(rounded_cells(nonneg.norm_cut(noisy(spark, d, 1500.0)[1])), ["s", "p"])


@query(f"WITH {noisy_sql('1500e0')}, {SUB} SELECT s, p, cell, round(count, 6) AS count FROM sub")
def norm_sub(spark, d):
    return _line_cast(rounded_cells(nonneg.norm_sub(noisy(spark, d, 1500.0)[1])), ["s", "p"])


# ---- dependence and selection


def _pairs_sql(names) -> str:
    out = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            out.append(f"""SELECT '{a}' AS first_attr, '{b}' AS second_attr, (SELECT (max({a}) + 1) * (max({b}) + 1) FROM li)::BIGINT AS num_cells,
 (SELECT sum(abs(coalesce(c.n, 0) / t.n - x.n / t.n * (y.n / t.n))) FROM (SELECT {a}, count(*)::DOUBLE AS n FROM li GROUP BY 1) x CROSS JOIN (SELECT {b}, count(*)::DOUBLE AS n FROM li GROUP BY 1) y
 LEFT JOIN (SELECT {a}, {b}, count(*)::DOUBLE AS n FROM li GROUP BY 1, 2) c ON c.{a} = x.{a} AND c.{b} = y.{b} CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM li) t) AS error""")
    return "dep AS (" + " UNION ALL ".join(out) + ")"


DEP = f"{LI}, {_pairs_sql(list(LINE))}"


def _dep(spark, d):
    df, dom = line(spark, d, *LINE)
    return dependence.pair_dependence(df, dom), dom, df


@query(f"WITH {DEP} SELECT first_attr, second_attr, num_cells, round(error, 9) AS error FROM dep")
def pair_dependence(spark, d):
    return _dep(spark, d)[0].withColumn("error", r("error"))


_NOISY_DEP = z_sql("('9|' || first_attr || ',' || second_attr)")


@query(f"WITH {DEP} SELECT first_attr, second_attr, round(error + 0.01e0 * {_NOISY_DEP}, 9) AS error FROM dep")
def noisy_dependence(spark, d):
    key = F.concat(F.lit("9|"), F.concat_ws(",", "first_attr", "second_attr"))
    return _dep(spark, d)[0].select("first_attr", "second_attr", r(F.col("error") + privacy.noise(0.01, "gauss", "keyed", key)).alias("error"))


@query(f"""WITH {DEP}, e AS (SELECT first_attr AS attr, second_attr AS other, * FROM dep UNION ALL SELECT second_attr, first_attr, * FROM dep)
SELECT attr, first_attr, second_attr FROM (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY error DESC, first_attr, second_attr) AS r FROM e WHERE attr IN ('ln', 'q', 'dc') AND other IN ('rf', 'ls')) WHERE r = 1""")
def connect_isolated(spark, d):
    dep, dom, _ = _dep(spark, d)
    return dependence.connect_isolated(dep, dom.attrs, ["rf", "ls"])


def _marginals_frame(spark, found):
    return spark.createDataFrame([(k, ",".join(m)) for k, m in enumerate(found)], "place int, marginal string")


@query()
def greedy_select(spark, d):
    dep, dom, df = _dep(spark, d)
    n = df.count()
    table = [tuple(x) for x in dep.orderBy("first_attr", "second_attr").collect()]  # one row for each pair of attributes
    return _marginals_frame(spark, selection.greedy(table, n, privacy.rho_for(1.8, privacy.delta_for(n)), threshold=n * 0.001))


def _graph(spark, d):
    """Pairs of lineitem's attributes whose dependence is four fifths of the mean or more, and the domain."""
    dep, dom, _ = _dep(spark, d)
    table = dep.orderBy("first_attr", "second_attr").collect()  # one row for each pair of attributes
    least = 0.8 * sum(x["error"] for x in table) / len(table)
    return [(x["first_attr"], x["second_attr"]) for x in table if x["error"] >= least], dom


GRAPH = f"""{DEP}, e AS (SELECT first_attr AS a, second_attr AS b FROM dep WHERE error >= 0.8e0 * (SELECT avg(error) FROM dep)),
two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
size AS (SELECT unnest({list(LINE)}) AS a, unnest([{', '.join(f'(SELECT max({a}) + 1 FROM li)' for a in LINE)}]) AS n),
tri AS (SELECT x.a, x.b, y.b AS c FROM two x JOIN two y ON x.b = y.a JOIN two z ON z.a = y.b AND z.b = x.a WHERE x.a < x.b AND x.b < y.b),
big AS (SELECT tri.a, tri.b, tri.c FROM tri JOIN size p ON p.a = tri.a JOIN size q ON q.a = tri.b JOIN size r ON r.a = tri.c WHERE p.n * q.n * r.n < 5000),
lost AS (SELECT e.a, e.b FROM e WHERE NOT EXISTS (SELECT 1 FROM big WHERE e.a IN (big.a, big.b, big.c) AND e.b IN (big.a, big.b, big.c)))"""


@query(f"WITH {GRAPH} SELECT a || ',' || b || ',' || c AS marginal FROM big UNION ALL SELECT least(a, b) || ',' || greatest(a, b) FROM lost")
def combine_cliques(spark, d):
    """The graph holds no clique of four attributes; SQL finds triangles."""
    edges, dom = _graph(spark, d)
    return spark.createDataFrame([(",".join(sorted(m)),) for m in selection.combine(edges, dom)], "marginal string")


@query(f"""WITH {GRAPH}, deg AS (SELECT a, count(*) AS n FROM two GROUP BY a), l0 AS (SELECT two.a, two.b FROM two JOIN deg USING (a) WHERE n = 1),
t1 AS (SELECT * FROM two WHERE (a, b) NOT IN (SELECT a, b FROM l0) AND (b, a) NOT IN (SELECT a, b FROM l0)), d1 AS (SELECT a, count(*) AS n FROM t1 GROUP BY a)
SELECT 0 AS layer, a AS attr, b AS ancestor FROM l0 UNION ALL SELECT 1, t1.a, t1.b FROM t1 JOIN d1 USING (a) WHERE n = 1""")
def clip_layers(spark, d):
    layers, _ = selection.clip(_graph(spark, d)[0])
    return spark.createDataFrame([(k, a, b) for k, x in enumerate(layers) for a, b in x.ancestor.items()], "layer int, attr string, ancestor string")


@query(f"""WITH RECURSIVE {GRAPH}, reach(a, b) AS (SELECT a, a FROM two UNION SELECT reach.a, two.b FROM reach JOIN two ON two.a = reach.b),
part AS (SELECT a, min(b) AS k FROM reach GROUP BY a)
SELECT string_agg(a, ',' ORDER BY a) AS attrs, (SELECT count(*)::INT FROM e JOIN part q ON q.a = e.a WHERE q.k = part.k) AS marginals FROM part GROUP BY k""")
def components(spark, d):
    found = selection.components(_graph(spark, d)[0])
    return spark.createDataFrame([(",".join(sorted(a)), len(m)) for a, m in found], "attrs string, marginals int")


@query(f"WITH {GRAPH} SELECT a AS first_attr, b AS second_attr FROM lost")
def missing_pairs(spark, d):
    edges, dom = _graph(spark, d)
    return spark.createDataFrame(selection.missing(edges, [m for m in selection.combine(edges, dom) if len(m) > 2]), "first_attr string, second_attr string")


# ---- recoding


_RC_SIGMA = 260.0
RC = f"""{LI}, one AS (SELECT q AS cell, count(*)::DOUBLE + 260e0 * {z_sql("('5|q|' || q)")} AS count FROM li GROUP BY q),
oc AS (SELECT cell, CASE WHEN count <= 0 THEN 0 ELSE least(count, greatest(0, sum(greatest(count, 0)) OVER (ORDER BY count, cell) - (SELECT sum(greatest(-count, 0)) FROM one))) END AS count FROM one),
gr AS (SELECT cell AS old_code, count < 3 * 260e0 AS is_group FROM oc),
rec AS (SELECT old_code, CASE WHEN is_group THEN (SELECT count(*) FROM gr WHERE NOT is_group) ELSE count(*) FILTER (NOT is_group) OVER (ORDER BY old_code) - 1 END AS new_code, is_group FROM gr)"""


def _recode(spark, d):
    df, dom = line(spark, d, "q", extra=("l_orderkey", "l_linenumber"))
    one = marginals.dense(df, dom, ["q"])
    one = one.withColumn("count", F.col("count") + privacy.noise(_RC_SIGMA, "gauss", "keyed", F.concat(F.lit("5|q|"), F.col("cell").cast("string"))))
    return df, recode.recode_map(one, "q", _RC_SIGMA)


@query(f"WITH {RC} SELECT old_code, new_code::BIGINT AS new_code, is_group FROM rec")
def recode_map(spark, d):
    return _line_cast(_recode(spark, d)[1], ["old_code", "new_code"])


@query(f"WITH {RC} SELECT new_code::BIGINT AS q, count(*) AS n FROM li JOIN rec ON q = old_code GROUP BY 1")
def recode_counts(spark, d):
    df, mapping = _recode(spark, d)
    return _line_cast(recode.recode(df, "q", mapping).groupBy("q").agg(F.count("*").alias("n")), ["q"])


@query(f"""WITH {RC}, g AS (SELECT old_code, row_number() OVER (ORDER BY old_code) AS i, count(*) OVER () AS m FROM rec WHERE is_group),
k AS (SELECT count(*) AS n FROM li JOIN rec ON q = old_code WHERE is_group),
b AS (SELECT old_code AS q, (round_even(round(i / m, 12) * n, 0) - round_even(round((i - 1) / m, 12) * n, 0))::BIGINT AS n FROM g, k)
SELECT q, n FROM b WHERE n > 0 UNION ALL SELECT old_code, count(*) FROM li JOIN rec ON q = old_code WHERE NOT is_group GROUP BY 1""")
def recode_decode(spark, d):
    df, mapping = _recode(spark, d)
    back = recode.decode(recode.recode(df, "q", mapping), "q", mapping, F.struct("l_orderkey", "l_linenumber"))
    return _line_cast(back.groupBy("q").agg(F.count("*").alias("n")), ["q"])


# ---- consistency


_RHO = {("rf", "ls"): 0.3, ("rf", "ln"): 0.7}


def _two(spark, d):
    df, dom = line(spark, d, "rf", "ls", "ln")
    out = {}
    for v in _RHO:
        key = F.concat(F.lit("4|" + ",".join(v) + "|"), F.col("cell").cast("string"))
        out[v] = marginals.dense(df, dom, v).withColumn("count", F.col("count") + privacy.noise(50.0, "gauss", "keyed", key))
    return out, dom


def _two_sql() -> str:
    parts = []
    for a, b in _RHO:
        parts.append(f"""{a}{b} AS (SELECT x.{a}, y.{b}, x.{a} * (SELECT max({b}) + 1 FROM li) + y.{b} AS cell, coalesce(c.n, 0)::DOUBLE + 50e0 * {z_sql(f"('4|{a},{b}|' || (x.{a} * (SELECT max({b}) + 1 FROM li) + y.{b}))")} AS count
 FROM (SELECT DISTINCT {a} FROM li) x CROSS JOIN (SELECT DISTINCT {b} FROM li) y LEFT JOIN (SELECT {a}, {b}, count(*) AS n FROM li GROUP BY ALL) c ON c.{a} = x.{a} AND c.{b} = y.{b})""")
    return ", ".join(parts)


CONS = f"""{LI}, {_two_sql()}, w AS (SELECT 1e0 / (max(ls) + 1) AS w1, 1e0 / (max(ln) + 1) AS w2, 1e0 / ((max(rf) + 1) * (max(ls) + 1)) AS v1, 1e0 / ((max(rf) + 1) * (max(ln) + 1)) AS v2 FROM li)"""


def _stacked(got):
    return reduce(DataFrame.union, (m.select(F.lit(",".join(v)).alias("view"), "cell", r("count", 6).alias("count")) for v, m in got.items()))


@query(f"""WITH {CONS}, s1 AS (SELECT rf, sum(count) AS s FROM rfls GROUP BY rf), s2 AS (SELECT rf, sum(count) AS s FROM rfln GROUP BY rf),
tg AS (SELECT rf, s1.s AS a, s2.s AS b, (s1.s * w1 * 0.3e0 + s2.s * w2 * 0.7e0) / (w1 * 0.3e0 + w2 * 0.7e0) AS t FROM s1 JOIN s2 USING (rf), w)
SELECT 'rf,ls' AS view, cell, round(count + (t - a) * w1, 6) AS count FROM rfls JOIN tg USING (rf), w UNION ALL SELECT 'rf,ln', cell, round(count + (t - b) * w2, 6) FROM rfln JOIN tg USING (rf), w""")
def consist_step(spark, d):
    views, dom = _two(spark, d)
    return _stacked(consistency.step(views, ["rf"], dom, _RHO))


@query(f"""WITH {CONS}, tg AS (SELECT a, b, (a * v1 * 0.3e0 + b * v2 * 0.7e0) / (v1 * 0.3e0 + v2 * 0.7e0) AS t FROM (SELECT sum(count) AS a FROM rfls), (SELECT sum(count) AS b FROM rfln), w)
SELECT 'rf,ls' AS view, cell, round(count + (t - a) * v1, 6) AS count FROM rfls, tg, w UNION ALL SELECT 'rf,ln', cell, round(count + (t - b) * v2, 6) FROM rfln, tg, w""")
def consist_total(spark, d):
    views, dom = _two(spark, d)
    return _stacked(consistency.step(views, [], dom, _RHO))


# ---- quotas


QN = 10_000


@query(f"""WITH {noisy_sql('30e0')}, o AS (SELECT s, sum(count) AS count FROM noisy GROUP BY s), u AS (SELECT s, round_even(round(sum(count) OVER (ORDER BY s) / (SELECT sum(count) FROM o), 12) * {QN}, 0)::BIGINT AS last FROM o),
b AS (SELECT s, last, lag(last, 1, 0) OVER (ORDER BY s) AS first FROM u) SELECT i AS row_id, s FROM range({QN}) x(i) JOIN b ON i >= first AND i < last""")
def quota_singleton(spark, d):
    m = marginals.roll_up(noisy(spark, d, 30.0)[1], ["s"])
    rows = spark.range(QN).select(F.col("id").alias("row_id"))
    return _line_cast(quota.fill(rows, quota.boundaries(m, QN, ["s"]), ["s"]), ["s"])


@query(f"""WITH {noisy_sql('30e0')}, u AS (SELECT s, p, round_even(round(sum(count) OVER (ORDER BY p, cell) / (SELECT sum(count) FROM noisy), 12) * {QN}, 0)::BIGINT AS last, cell FROM noisy),
b AS (SELECT s, p, last, lag(last, 1, 0) OVER (ORDER BY p, cell) AS first FROM u) SELECT i AS row_id, s, p FROM range({QN}) x(i) JOIN b ON i >= first AND i < last""")
def quota_marginal(spark, d):
    rows = spark.range(QN).select(F.col("id").alias("row_id"))
    return _line_cast(quota.fill(rows, quota.boundaries(noisy(spark, d, 30.0)[1], QN, ["p", "cell"]), ["s", "p"]), ["s", "p"])


@query(f"WITH {noisy_sql('30e0')}, h AS (SELECT s, count(*) AS n FROM ord GROUP BY s), t AS (SELECT s, sum(count) AS t FROM noisy GROUP BY s) SELECT s, p, round(count * coalesce(h.n, 0) / t, 6) AS count FROM noisy JOIN t USING (s) LEFT JOIN h USING (s)")
def quota_conditional(spark, d):
    df, m, _ = noisy(spark, d, 30.0)
    return _line_cast(quota.conditional(m, df, ["s"]).select("s", "p", r("count", 6).alias("count")), ["s", "p"])


@query(f"WITH {LI} SELECT round(corr(q, dc), 9) AS corr FROM li")
def rank_corr(spark, d):
    df, _ = line(spark, d, "q", "dc")
    return marginals.observed(df, ["q", "dc"]).agg(r(quota.weighted_corr("q", "dc")).alias("corr"))


@query(f"""WITH {noisy_sql('30e0')}, {CUT}, a AS (SELECT s, row_id, row_number() OVER (PARTITION BY s ORDER BY row_id) - 1 AS place, count(*) OVER (PARTITION BY s) AS n FROM ord),
u AS (SELECT s, p, round(CASE WHEN sum(count) OVER (PARTITION BY s) <> 0 THEN sum(count) OVER (PARTITION BY s ORDER BY p) / sum(count) OVER (PARTITION BY s) ELSE row_number() OVER (PARTITION BY s ORDER BY p) / count(*) OVER (PARTITION BY s)::DOUBLE END, 12) AS share FROM cut), c AS (SELECT s, p, share, lag(share, 1, 0) OVER (PARTITION BY s ORDER BY p) AS before FROM u)
SELECT row_id, a.s, p FROM a JOIN c ON a.s = c.s AND place >= round_even(before * n, 0) AND place < round_even(share * n, 0)""")
def append_attr(spark, d):
    df, m, dom = noisy(spark, d, 30.0)
    return _line_cast(quota.append(df.select("row_id", "s"), nonneg.norm_cut(m).drop("cell"), "s", "p", F.col("row_id")), ["s", "p"])


_QUOTAS = " UNION ALL ".join(f"SELECT '{x}' AS attr, {x} AS code, n, true AS independent FROM (SELECT {x}, round_even(round(sum(c) OVER (ORDER BY {x}) / sum(c) OVER (), 12) * {QN}, 0)::BIGINT - round_even(round((sum(c) OVER (ORDER BY {x}) - c) / sum(c) OVER (), 12) * {QN}, 0)::BIGINT AS n FROM (SELECT {x}, sum(count) AS c FROM cut GROUP BY {x})) WHERE n > 0" for x in "sp")


@query(f"WITH {noisy_sql('30e0')}, {CUT} {_QUOTAS}")
def start_singletons(spark, d):
    m = nonneg.norm_cut(noisy(spark, d, 30.0)[1])
    rows = quota.permuted(spark.range(QN).select(F.col("id").alias("row_id")), "row_id", QN, {f"__at_{x}": f"3|{x}" for x in "sp"})
    for x in "sp":
        rows = quota.fill(rows, quota.boundaries(marginals.roll_up(m, [x]), QN, [x]), [x], f"__at_{x}")
    apart = F.broadcast(rows.agg((F.abs(F.corr("s", "p")) < 0.03).alias("independent")))
    held = marginals.count_sets(rows, [("s",), ("p",)])
    return held.crossJoin(apart).select(F.col("view").alias("attr"), F.coalesce("s", "p").cast("long").alias("code"), F.col("count").alias("n"), "independent")


# ---- update


_ALPHA = 0.8


def _update(spark, d):
    """Rows to move: every order, with another status for each fourth; the target has the shares of the noisy marginal of all orders."""
    df, m, dom = noisy(spark, d, 30.0)
    rows = df.withColumn("s", F.when(F.col("row_id") % 4 == 0, 0).otherwise(F.col("s"))).withColumn("tag", F.col("row_id") * 7 + 1)
    target = marginals.normalize(nonneg.norm_cut(m))
    return rows.select("row_id", "s", "p", "tag"), target, dom


UPD = f"""{noisy_sql('30e0')}, {CUT}, rws AS (SELECT row_id, CASE WHEN row_id % 4 = 0 THEN 0 ELSE s END AS s, p, row_id * 7 + 1 AS tag FROM ord), nn AS (SELECT count(*)::DOUBLE AS n FROM rws),
tgt AS (SELECT s, p, count / (SELECT sum(count) FROM cut) AS a FROM cut),
hv AS (SELECT s, p, count(*)::DOUBLE AS h FROM rws GROUP BY ALL),
st AS (SELECT m.s, m.p, m.cell, coalesce(h, 0) / n AS sh, coalesce(a, 0) AS a, n FROM marg m LEFT JOIN hv USING (s, p) LEFT JOIN tgt USING (s, p), nn),
sets AS (SELECT *, CASE WHEN sh = 0 AND a > 0 THEN 'zero' WHEN sh < a THEN 'under' WHEN sh > a THEN 'over' ELSE 'even' END AS kind,
 (CASE WHEN sh = 0 AND a > 0 THEN round_even({_ALPHA}e0 * a * n, 0) WHEN sh < a THEN round_even(least((a - sh) / sh, {_ALPHA}e0) * sh * n, 0) ELSE 0 END)::BIGINT AS num_add FROM st),
ov AS (SELECT *, (sh - a) / sh AS x, row_number() OVER (ORDER BY (sh - a) / sh, cell) AS i FROM sets WHERE kind = 'over'),
tr AS (SELECT i, x, ((SELECT sum(num_add) FROM sets) - coalesce((SELECT sum((sh - a) * n) FROM ov o WHERE o.i < ov.i), 0)) / (SELECT sum(sh * n) FROM ov o WHERE o.i >= ov.i) AS b FROM ov),
bt AS (SELECT coalesce((SELECT b FROM tr WHERE b <= x ORDER BY i LIMIT 1), (SELECT max(x) FROM tr), 0) AS beta),
red AS (SELECT sets.*, (CASE WHEN kind = 'over' THEN round_even(least((sh - a) / sh, beta) * sh * n, 0) ELSE 0 END)::BIGINT AS num_reduce FROM sets, bt),
off AS (SELECT *, coalesce(sum(num_reduce) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM red),
don AS (SELECT row_id, (o + place)::BIGINT AS slot FROM (SELECT row_id, s, p, row_number() OVER (PARTITION BY s, p ORDER BY row_id) - 1 AS place FROM rws) JOIN off USING (s, p) WHERE place < num_reduce),
cuts AS (SELECT s, p, num_add, coalesce(sum(num_add) OVER (ORDER BY kind <> 'zero', cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM red)"""


@query(f"WITH {UPD} SELECT s, p, round(sh, 9) AS share, round(a, 9) AS target, kind, num_add FROM sets")
def update_sets(spark, d):
    rows, target, dom = _update(spark, d)
    got = update.sets(rows, target, dom, ["s", "p"], _ALPHA)
    return _line_cast(got.select("s", "p", r("__s").alias("share"), r("__a").alias("target"), "kind", "num_add"), ["s", "p"])


@query(f"WITH {UPD} SELECT round(beta, 9) AS beta FROM bt")
def update_beta(spark, d):
    rows, target, dom = _update(spark, d)
    return update.beta(update.sets(rows, target, dom, ["s", "p"], _ALPHA)).select(r("beta").alias("beta"))


@query(f"WITH {UPD} SELECT row_id, slot FROM don")
def update_donors(spark, d):
    rows, target, dom = _update(spark, d)
    cells = update.reduced(update.sets(rows, target, dom, ["s", "p"], _ALPHA))
    return update.donors(rows, cells, ["s", "p"], F.col("row_id"))


@query(f"""WITH {UPD}, src AS (SELECT s, p, tag, row_number() OVER (PARTITION BY s, p ORDER BY row_id) - 1 AS i FROM rws),
mv AS (SELECT row_id, c.s, c.p, CASE WHEN slot - first < round_even(0.5e0 * CASE WHEN kind = 'under' THEN c.num_add ELSE 0 END, 0) THEN slot - first END AS i FROM don JOIN cuts c ON slot >= first AND slot < first + num_add JOIN red USING (s, p))
SELECT rws.row_id, coalesce(m.s, rws.s) AS s, coalesce(m.p, rws.p) AS p, coalesce(src.tag, rws.tag) AS tag FROM rws LEFT JOIN mv m USING (row_id) LEFT JOIN src ON src.s = m.s AND src.p = m.p AND src.i = m.i""")
def update_step(spark, d):
    rows, target, dom = _update(spark, d)
    return _line_cast(update.step(rows, target, dom, ["s", "p"], _ALPHA, 0.5, F.col("row_id")), ["s", "p"])


# ---- metrics


def _sides(spark, d, *columns):
    df = t(spark, d, "lineitem")
    return (df.where(F.col("l_linestatus") == s).select(*columns) for s in ("O", "F"))


def _pq(keys: str, table: str = "lineitem", side: str = "l_linestatus = 'O'", other: str = "l_linestatus = 'F'") -> str:
    return f"pq AS (SELECT count(*) FILTER ({side}) / (SELECT count(*)::DOUBLE FROM {table} WHERE {side}) AS p, count(*) FILTER ({other}) / (SELECT count(*)::DOUBLE FROM {table} WHERE {other}) AS q FROM {table} GROUP BY {keys})"


JSD = "SELECT round(sqrt(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2), 9) AS jsd FROM pq WHERE p + q > 0"


@query(f"WITH {_pq('l_quantity')} SELECT round(sum(abs(p - q)), 9) AS l1 FROM pq")
def l1_error(spark, d):
    return metrics.l1(*_sides(spark, d, "l_quantity"), ["l_quantity"]).select(r("l1").alias("l1"))


@query(f"WITH {_pq('l_returnflag')} {JSD}")
def jsd_column(spark, d):
    return metrics.jsd(*_sides(spark, d, "l_returnflag"), ["l_returnflag"]).select(r("jsd").alias("jsd"))


@query(f"WITH {_pq('l_returnflag, l_linenumber')} {JSD}")
def jsd_marginal(spark, d):
    return metrics.jsd(*_sides(spark, d, "l_returnflag", "l_linenumber"), ["l_returnflag", "l_linenumber"]).select(r("jsd").alias("jsd"))


_EMD = ("l_quantity", "l_discount", "l_tax")


def _emd_sql() -> str:
    one = lambda f: f"""SELECT '{f}' AS field, sum(abs(fa - fb) * (nx - x)) AS emd FROM (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(a) OVER (ORDER BY x) / (SELECT count(*)::DOUBLE FROM lineitem WHERE l_returnflag = 'A') AS fa, sum(b) OVER (ORDER BY x) / (SELECT count(*)::DOUBLE FROM lineitem WHERE l_returnflag = 'R') AS fb FROM (SELECT {f} AS x, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1))"""
    return "e AS (" + " UNION ALL ".join(map(one, _EMD)) + ")"


def _emds(spark, d):
    df = t(spark, d, "lineitem")
    return metrics.emd(*(df.where(F.col("l_returnflag") == x).select(*_EMD) for x in ("A", "R")), _EMD)


@query(f"WITH {_emd_sql()} SELECT field, round(emd, 9) AS emd FROM e")
def emd_column(spark, d):
    return _emds(spark, d).withColumn("emd", r("emd"))


@query(f"WITH {_emd_sql()} SELECT field, round(0.1e0 + 0.8e0 * (emd - (SELECT min(emd) FROM e)) / ((SELECT max(emd) FROM e) - (SELECT min(emd) FROM e)), 9) AS normalized FROM e")
def emd_normalized(spark, d):
    return metrics.normalized_emd(_emds(spark, d)).select("field", r("normalized").alias("normalized"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type) AS flow_size FROM events")
def flow_size(spark, d):
    return metrics.with_flow_size(t(spark, d, "events"), ["user_id", "event_type"]).select("event_id", "flow_size")


_FLOW = {"srcip": "l_suppkey", "dstip": "l_partkey % 50", "srcport": "l_linenumber", "dstport": "l_quantity", "proto": "l_returnflag", "ts": "l_orderkey", "time": "l_orderkey", "td": "l_discount", "pkt": "l_quantity", "pkt_len": "l_quantity", "byt": "l_extendedprice"}


def _traces(spark, d):
    """Lines as flows: open ones against finished ones."""
    df = t(spark, d, "lineitem")
    return (df.where(F.col("l_linestatus") == s).select(*(F.expr(e).alias(c) for c, e in _FLOW.items())) for s in "OF")


def _report_sql(fields: tuple[str, ...]) -> str:
    made = ", ".join(f"{e} AS {c}" for c, e in _FLOW.items() if c != "time")
    key = ", ".join(metrics.FLOW_KEY)
    out = [f"WITH fl AS (SELECT l_linestatus AS side, {made}, l_orderkey / 1e6 AS time_ms FROM lineitem), fs AS (SELECT *, count(*) OVER (PARTITION BY side, {key}) AS flow_size FROM fl), nn AS (SELECT count(*) FILTER (side = 'O')::DOUBLE AS no, count(*) FILTER (side = 'F')::DOUBLE AS nf FROM fl)"]
    jsd = [f"SELECT 'jsd' AS metric, '{f}' AS field, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS value FROM (SELECT count(*) FILTER (side = 'O') / any_value(no) AS p, count(*) FILTER (side = 'F') / any_value(nf) AS q FROM fs, nn GROUP BY {f})" for f in metrics.FLOW_KEY]
    emd = [f"SELECT 'emd' AS metric, '{f}' AS field, sum(abs(fa - fb) * (nx - x)) AS value FROM (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(a) OVER (ORDER BY x) / no AS fa, sum(b) OVER (ORDER BY x) / nf AS fb FROM (SELECT {f}::DOUBLE AS x, count(*) FILTER (side = 'O') AS a, count(*) FILTER (side = 'F') AS b FROM fs GROUP BY 1), nn)" for f in fields]
    out.append(f"em AS ({' UNION ALL '.join(emd)})")
    return ", ".join(out) + f" {' UNION ALL '.join(f'SELECT metric, field, round(value, 9) AS value, NULL::DOUBLE AS normalized FROM ({x})' for x in jsd)} UNION ALL SELECT metric, field, round(value, 6), round(0.1e0 + 0.8e0 * (value - (SELECT min(value) FROM em)) / ((SELECT max(value) FROM em) - (SELECT min(value) FROM em)), 9) FROM em"


def _rounded_report(df):
    return df.select("metric", "field", F.when(F.col("metric") == "emd", r("value", 6)).otherwise(r("value")).alias("value"), r("normalized").alias("normalized"))


@query(_report_sql(("ts", "td", "pkt", "byt")))
def flow_report(spark, d):
    return _rounded_report(metrics.flow_report(*_traces(spark, d)))


@query(_report_sql(("pkt_len", "time_ms", "flow_size")))
def packet_report(spark, d):
    return _rounded_report(metrics.packet_report(*_traces(spark, d)))


# ---- sketches


def _mod(text: str, width: int) -> str:
    """A digest modulo a width, folded four hex digits at a time."""
    parts = ", ".join(f"('0x' || substr(sha256({text}), {4 * k + 1}, 4))::BIGINT" for k in range(16))
    return f"list_reduce([0::BIGINT, {parts}], lambda a, x: (a * 65536 + x) % {width})"


def _sketch_sql(table: str, width: int, how: str, depth: int = 5, name: str = "est") -> str:
    return f"""{name}k AS (SELECT k, n, r, {_mod("(k::VARCHAR || r::VARCHAR)", width)} AS b FROM {table}, range({depth}) x(r)), {name}c AS (SELECT r, b, sum(n)::DOUBLE AS v FROM {name}k GROUP BY r, b),
{name} AS (SELECT k, {'min' if how == 'min' else 'median'}(v) AS e FROM {name}k JOIN {name}c USING (r, b) GROUP BY k)"""


PK = "pk AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1)"


def _estimate(kind, **shape):
    def f(spark, d):
        return sketches.estimates(t(spark, d, "lineitem"), "l_partkey", kind, **shape)

    return f


QUERIES["cms_query"] = _estimate("cms")
ORACLE["cms_query"] = f"WITH {PK}, {_sketch_sql('pk', 1000, 'min')} SELECT k AS key, e AS estimate FROM est"
QUERIES["median_sketch_query"] = _estimate("median")
ORACLE["median_sketch_query"] = f"WITH {PK}, {_sketch_sql('pk', 1000, 'median')} SELECT k AS key, e AS estimate FROM est"
_WIDTHS = sketches.layer_widths(1000, 10)
_ODD = "od AS (SELECT * FROM pk WHERE ('0x' || substr(sha256(k::VARCHAR), 64, 1))::BIGINT % 2 = 1), ev AS (SELECT * FROM pk WHERE ('0x' || substr(sha256(k::VARCHAR), 64, 1))::BIGINT % 2 = 0)"
QUERIES["univmon_query"] = _estimate("univmon")
ORACLE["univmon_query"] = (
    f"WITH {PK}, {_ODD}, "
    + ", ".join(_sketch_sql("od", w, "median", name=f"u{k}") for k, w in enumerate(_WIDTHS[:9]))
    + f", evc AS (SELECT sum(n)::DOUBLE AS v FROM od) SELECT u8.k AS key, {' + '.join(['256 * u8.e'] + [f'-{2**k} * u{k}.e' for k in range(8)])} AS estimate FROM u8 "
    + " ".join(f"JOIN u{k} ON u{k}.k = u8.k" for k in range(8))
    + " UNION ALL SELECT k, coalesce(v, 0) FROM ev, evc"
)
QUERIES["nitro_query"] = _estimate("nitro", width=100)


@query(f"WITH {PK}, {_sketch_sql('pk', 1000, 'min')} SELECT count(*) FILTER (e >= 0.001e0 * (SELECT count(*) FROM lineitem))::BIGINT AS hitters, (SELECT count(*) FROM lineitem) AS total FROM est")
def heavy_hitters(spark, d):
    return sketches.heavy_hitters(t(spark, d, "lineitem"), "l_partkey", "cms", **sketches.SHAPES["cms"])


def _error_sql(kind: str) -> str:
    side = lambda s, n: f"{n}p AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = '{s}' GROUP BY 1), {_sketch_sql(n + 'p', 1000, kind, name=n)}, {n}h AS (SELECT count(*) FILTER (e >= 0.001e0 * (SELECT sum(n) FROM {n}p)) / (SELECT sum(n)::DOUBLE FROM {n}p) AS h FROM {n})"
    return f"WITH {side('O', 'ro')}, {side('F', 'sy')} SELECT '{'cms' if kind == 'min' else 'median'}' AS sketch, round(abs(syh.h - roh.h) / roh.h, 9) AS error FROM roh, syh"


@query(_error_sql("min"))
def hh_relative_error(spark, d):
    raw, syn = _sides(spark, d, "l_partkey")
    return sketches.relative_error(raw, syn, "l_partkey", "cms", **sketches.SHAPES["cms"]).withColumn("error", r("error"))


@query(_error_sql("median"))
def hh_error_median(spark, d):
    raw, syn = _sides(spark, d, "l_partkey")
    return sketches.relative_error(raw, syn, "l_partkey", "median", **sketches.SHAPES["median"]).withColumn("error", r("error"))


@query()
def sketch_report(spark, d):
    raw, syn = _sides(spark, d, "l_partkey")
    return sketches.report(raw, syn, "l_partkey")


# ---- classifiers


@query("SELECT event_type, min(value) AS low, round(quantile_cont(value, 0.25), 9) AS q1, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.75), 9) AS q3, max(value) AS high FROM events GROUP BY event_type")
def class_boxplot(spark, d):
    got = mlbench.class_spread(t(spark, d, "events"), "event_type", "value")
    return got.select("event_type", "low", *(r(c).alias(c) for c in ("q1", "median", "q3")), "high")


_NUMBERS = ["value", "user_id", "hour"]


def _events(spark, d):
    return t(spark, d, "events").withColumn("hour", F.hour("ts"))


def _ml(kind):
    def f(spark, d):
        model, train, test = mlbench.prepare(_events(spark, d), _NUMBERS, [], "event_type")
        got = mlbench.accuracy(kind, train, model.transform(test))[1]
        train.unpersist()
        return spark.createDataFrame([(kind, float(got))], "model string, accuracy double")

    return f


for _k in mlbench.MODELS:
    QUERIES[f"ml_{_k}"] = _ml(_k)


@query()
def ml_compare(spark, d):
    """Trees and logistic regression on open and on finished lines, with a categorical feature."""
    df = t(spark, d, "lineitem")
    raw, syn = (df.where(F.col("l_linestatus") == s) for s in "OF")
    return mlbench.compare(raw, syn, ["l_quantity", "l_discount", "l_extendedprice"], ["l_returnflag"], "l_linenumber", ("dt", "lr"))


@query()
def lr_coefficients(spark, d):
    _, train, _ = mlbench.prepare(_events(spark, d), _NUMBERS, [], "event_type")
    return mlbench.coefficients(mlbench.classifier("lr", 3, 5).fit(train), _NUMBERS, spark)


@query()
def tree_rules(spark, d):
    _, train, _ = mlbench.prepare(_events(spark, d), _NUMBERS, [], "event_type")
    return mlbench.rules(mlbench.classifier("dt", 3, 5).fit(train), _NUMBERS, spark)


# ---- whole runs


FIELDS = {"l_returnflag": FieldSpec("categorical"), "l_linestatus": FieldSpec("categorical"), "l_linenumber": FieldSpec("categorical"), "l_suppkey": FieldSpec("binned-ip", 30), "l_extendedprice": FieldSpec("float-exponential", 2), "l_shipdate": FieldSpec("timestamp", 86_400_000_000 * 90, diff_bin=86_400_000_000)}


@query()
def synth_end_to_end(spark, d):
    raw = t(spark, d, "lineitem").select(*FIELDS)
    config = RunConfig(num_synthesize_records=raw.count(), seed=1, pred_attr="l_returnflag", threshold=100)
    return Pipeline(config).run(raw, FIELDS).table


@query()
def random_records(spark, d):
    return store.random_dataset(spark, Domain.from_dict({"a": 3, "b": 7}), 1000, 5)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Raw and noisy two-way marginal of orders side by side: shares, after noise and norm_cut, and their distance."""
    df, dom = orders(spark, d)
    raw = marginals.dense(df, dom, ["s", "p"])
    clean = nonneg.norm_cut(noisy(spark, d, 30.0)[1])
    both = marginals.normalize(raw).select("s", "p", "cell", F.col("share").alias("raw")).join(marginals.normalize(clean).select("cell", F.col("share").alias("noisy")), "cell")
    return both.select("s", "p", "cell", r("raw").alias("raw"), r("noisy").alias("noisy"), r(F.abs(F.col("raw") - F.col("noisy"))).alias("gap"))


@query(f"WITH {noisy_sql('30e0')}, {CUT} SELECT m.s, m.p, m.cell, round(m.count / (SELECT sum(count) FROM marg), 9) AS raw, round(c.count / (SELECT sum(count) FROM cut), 9) AS noisy, round(abs(m.count / (SELECT sum(count) FROM marg) - c.count / (SELECT sum(count) FROM cut)), 9) AS gap FROM marg m JOIN cut c USING (cell)")
def noisy_marginal(spark, d):
    return _line_cast(flagship(spark, d), ["s", "p"])
