"""From a raw table to a synthetic one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from secrets import token_hex

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.config import FieldSpec, RunConfig, logger
from tabveil.domain import Domain
from tabveil.functions import codec as codecs
from tabveil.functions import privacy
from tabveil.operators import consistency, dependence, quota, recode, update
from tabveil.operators.marginals import DENSE_CELLS, cells, count_cells, count_sets, dense, local, observed
from tabveil.plans import selection
from tabveil.sources.store import RunStore

LOG = logger()
View = tuple[str, ...]


@dataclass
class Result:
    """What a run made: the synthetic table, codes before decoding, views, and the ledger of releases."""

    table: DataFrame
    codes: DataFrame
    marginals: list[View]
    targets: dict[View, np.ndarray]
    ledger: privacy.Ledger
    domain: Domain
    gap: float


class Pipeline:
    """Stages: encode, choose marginals, group rare codes, count, add noise, agree, initialise, update, append, decode."""

    def __init__(self, config: RunConfig | None = None, store: RunStore | None = None) -> None:
        """With a store, the selection, its dependence table, dumps of stages, and what a run makes go there."""
        self.config, self.store = config or RunConfig(), store

    def dump(self, stage: str, df: DataFrame, attrs: Sequence[str] = (), maps: Mapping[str, DataFrame] | None = None) -> None:
        """The marginal that dump_marginal names, if this stage has it: of a view (attrs, count) its own, of records counted anew.

        With `maps` grouped codes are taken apart as in records: cells stand for rows in the order of their numbers.
        """
        wanted = [] if self.config.dump_marginal in (None, "None") else self.config.dump_marginal.split("_")
        if not wanted or self.store is None or (set(wanted) != set(attrs) if attrs else not set(wanted) <= set(df.columns)):
            return
        table = df if attrs else observed(df, wanted).withColumn("cell", F.xxhash64(*wanted))
        for a in wanted if maps else ():
            table = recode.decode(table, a, maps[a], F.col("cell"))
        self.store.dump_marginal(stage, table.select(*wanted, "count"), wanted)

    def dump_views(self, stage: str, spark, domain: Domain, views: Mapping[View, np.ndarray], maps: Mapping[str, DataFrame]) -> None:
        for v, x in views.items():
            if self.config.dump_marginal not in (None, "None") and set(v) == set(self.config.dump_marginal.split("_")):
                self.dump(stage, self.table(spark, domain, v, x), v, maps)

    def noise(self, scale: float, kind: str, key: str | None, prefix: str = ""):
        """Noise for the cell of a row; without a key, that of the view that the row names."""
        c = self.config
        name = F.col("view") if key is None else F.lit(key)
        return privacy.noise(scale, kind, c.noise, F.concat(F.lit(f"{c.seed or 0}|{prefix}"), name, F.lit("|"), F.col("cell").cast("string")), None)

    def choose(self, df: DataFrame, domain: Domain, n: int, rho: float, delta: float, ledger: privacy.Ledger) -> list[View]:
        """Pairs by noisy dependence, isolated attributes attached, cliques combined; or the selection of an earlier run."""
        c = self.config
        if not c.is_cal_marginals:
            if self.store is None:
                raise ValueError("a selection can only be used again from a store")
            return self.store.load_marginals()
        if c.is_cal_depend:
            pairs = dependence.pair_dependence(df, domain)
            if self.store is not None:
                self.store.save("dependence", pairs)
        elif self.store is None:
            raise ValueError("a dependence table can only be used again from a store")
        pairs = self.store.load("dependence") if self.store is not None else pairs
        table = [tuple(r) for r in pairs.orderBy("first_attr", "second_attr").collect()]  # a row a pair
        share, _ = privacy.split(c.epsilon, c.depend_epsilon_ratio)
        sigma = privacy.gaussian_sigma(share, delta, c.marg_select_sensitivity, len(table))
        draw = np.random.default_rng(c.seed if c.noise == "keyed" else None).normal(size=len(table)) if c.noise != "none" else np.zeros(len(table))
        noisy = [(a, b, k, e + z * sigma / (2 * n)) for (a, b, k, e), z in zip(table, draw, strict=True)]
        ledger.charge("dependence", privacy.rho_for(share, delta))
        chosen = selection.greedy(noisy, n, rho, c.noise_add_method, c.marg_add_sensitivity, c.threshold)
        chosen = selection.attach_isolated(chosen, domain.attrs, noisy)
        out = [domain.canonical(m) for m in (selection.combine(chosen, domain, c.combine_cells) if c.is_combine else chosen)]
        if self.store is not None:
            self.store.save_marginals(out)
        return out

    def views(self, df: DataFrame, domain: Domain, views: list[View], scales: Mapping[View, dict[str, float]], prefix: str = "", kind: str = "") -> dict[View, np.ndarray]:
        """Noisy dense counts of all views, from shared scans and one job for their noise, which falls on empty cells too."""
        c = self.config
        for v in views:
            if domain.size(v) > DENSE_CELLS:
                raise ValueError(f"{v} has too many cells")
        spark = df.sparkSession
        kind = kind or ("laplace" if c.noise_add_method == "A1" else "gauss")
        counts, first = count_cells(df, domain, views)
        sizes = spark.createDataFrame([(",".join(v), domain.size(v), float(scales[v]["scale"]), at) for v, at in zip(views, first, strict=True)], "view string, size long, scale double, first long")
        blocks = sizes.select("view", "scale", "size", "first", F.explode(F.expr("sequence(0L, (size - 1) div 10000)")).alias("block"))
        full = blocks.select("view", "scale", "first", F.explode(F.expr("sequence(block * 10000, least(size, block * 10000 + 10000) - 1)")).alias("cell"))
        full = full.withColumn("key", F.col("first") + F.col("cell")).join(counts, "key", "left")
        unit = self.noise(1.0, kind, None, prefix)
        rows = full.select("key", (F.coalesce("count", F.lit(0)).cast("double") + F.col("scale") * unit).alias("count")).toArrow()
        every = np.zeros(rows.num_rows)
        every[rows["key"].to_numpy()] = rows["count"].to_numpy()
        return {v: every[at : at + domain.size(v)] for v, at in zip(views, first, strict=True)}

    def initialise(self, spark, domain: Domain, targets: dict[View, np.ndarray], attrs: list[str], n: int, marginals: list[View]) -> DataFrame:
        """n rows: random codes, each attribute by its own marginal, or by marginals with the target attribute."""
        c = self.config
        rows = spark.range(n).select(F.col("id").alias("row_id"))
        seed = 0 if c.seed is None else c.seed
        secret = token_hex(16) if c.seed is None else str(c.seed)
        if c.initialize_method == "random":
            return rows.select("row_id", *(F.floor(F.rand(seed + k) * domain[a]).cast("int").alias(a) for k, a in enumerate(attrs)))
        done: list[str] = []
        known = [domain.canonical(m) for m in marginals if set(m) <= set(attrs)]
        start: list[View] = []
        if c.initialize_method == "marginal_manual":
            start = [domain.canonical(m) for m in c.initial_marginals if domain.canonical(m) in targets and set(m) <= set(attrs)]
            if not start:
                raise ValueError("marginal_manual needs initial_marginals among the selected ones")
        elif c.initialize_method.startswith("marginal") and c.pred_attr in attrs:
            found = selection.cover(known, c.pred_attr)
            start = selection.rank(found, {m: selection.mean_correlation(targets[m], domain.project(m).shape, m.index(c.pred_attr)) for m in found})
        for m in start:
            table = self.table(spark, domain, m, targets[m])
            old, new = [a for a in m if a in done], [a for a in m if a not in done]
            if not new:
                continue
            if old:
                sizes = rows.groupBy(*old).agg(F.count("*").alias("__n"))
                cuts = quota.boundaries(table.join(F.broadcast(sizes), old), F.col("__n"), new, "count", old)
                rows = quota.fill(quota.ordered(rows, F.xxhash64("row_id", F.lit(seed)), old), cuts, new, "place", old).drop("place")
            else:
                first = [c.pred_attr] if c.pred_attr in m else []
                rows = quota.fill(rows, quota.boundaries(table, n, [*first, "cell"]), new)
            done += new
        # a keyed permutation of the places for each attribute takes the part of its shuffle, without a sort of all rows
        alone = [a for a in attrs if a not in done]
        rows = quota.permuted(rows, "row_id", n, {f"__at_{a}": f"{secret}|{a}" for a in alone})
        for a in alone:
            rows = quota.fill(rows, quota.boundaries(self.table(spark, domain, (a,), targets[(a,)]), n, ["cell"]), [a], f"__at_{a}").drop(f"__at_{a}")
        return rows.select("row_id", *attrs)

    def table(self, spark, domain: Domain, v: View, x: np.ndarray) -> DataFrame:
        import pandas as pd

        counts = spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(x)), "count": x}))
        return cells(spark, domain, v).join(counts, "cell")

    def kept(self, df: DataFrame) -> DataFrame:
        """The table held for more than one reader; released by release()."""
        self.held = [*getattr(self, "held", []), df.persist()]
        return df

    def release(self) -> None:
        """Free what a run holds, once its tables have been read or written."""
        for df in getattr(self, "held", []):
            df.unpersist()
        self.held = []

    def run(self, raw: DataFrame, fields: Mapping[str, FieldSpec]) -> Result:
        """From raw records: learn the codes, then as run_codes."""
        model = codecs.fit(raw, fields)
        if self.store is not None:
            self.store.save_codec(model)
        return self.run_codes(model.encode(raw), model)

    def run_codes(self, codes: DataFrame, model: codecs.CodecModel) -> Result:
        c, spark = self.config, codes.sparkSession
        codes = codes.persist()
        n, domain = codes.count(), model.domain
        delta = privacy.delta_for(n)
        depend, rest = privacy.split(c.epsilon, c.depend_epsilon_ratio)
        rho = privacy.rho_for(rest, delta, c.marg_add_sensitivity)
        ledger = privacy.Ledger(privacy.rho_for(c.epsilon, delta, c.marg_add_sensitivity))
        marginals = self.choose(codes, domain, n, rho, delta, ledger)
        LOG.info("%d marginals", len(marginals))

        # rare codes: judged on noisy one-way counts, which are paid for unless a run is to repeat the original accounting
        sigma = privacy.gaussian_sigma(rest, delta, c.marg_add_sensitivity, len(marginals) + len(domain))
        one_rho = len(domain) * c.marg_add_sensitivity**2 / (2 * sigma**2)
        ones = self.views(codes, domain, [(a,) for a in domain], {(a,): {"scale": sigma} for a in domain}, "recode ", "gauss")
        maps, sizes, changed = {}, {}, {}
        for a in domain:
            found = recode.map_array(ones[(a,)], sigma if c.noise != "none" else 0.0)
            maps[a] = spark.createDataFrame(list(zip(*(x.tolist() for x in found), strict=True)), "old_code int, new_code int, is_group boolean")
            sizes[a], changed[a] = int(found[1].max()) + 1, bool(found[2].any())
        if c.charge_recode and not c.faithful:
            ledger.charge("recode", one_rho)
            rho = max(rho - one_rho, rho * 0.1)
        small = codes
        for a in domain:
            small = recode.recode(small, a, maps[a]) if changed[a] else small
            domain = domain.resized(a, sizes[a])
        small = small.persist()

        views = list(dict.fromkeys([*(domain.canonical(m) for m in marginals), *((a,) for a in domain)]))
        sizes = {",".join(v): domain.size(v) for v in views}
        shares = privacy.allocate(sizes, c.noise_add_method, rho, rest, c.marg_add_sensitivity)
        scales = {v: shares[",".join(v)] for v in views}
        for v in views:
            ledger.charge(",".join(v), 0.0 if c.noise_add_method == "A1" else scales[v]["rho"], scales[v]["epsilon"])
        if self.store is not None and c.dump_marginal not in (None, "None"):
            wanted = [v for v in views if set(v) == set(c.dump_marginal.split("_"))]
            LOG.warning("dump_marginal writes exact counts: they aren't private")
            for v in wanted:
                self.dump("construct", dense(small, domain, v), v, maps)
        noisy = self.views(small, domain, views, scales)
        self.dump_views("anonymize", spark, domain, noisy, maps)
        agreed, rounds, gap = consistency.consist(noisy, domain, {v: scales[v]["rho"] for v in views}, c.non_negativity, c.consist_iterations, faithful=c.faithful)
        small.unpersist()
        self.dump_views("consist", spark, domain, agreed, maps)
        LOG.info("agreed after %d rounds, gap %.3g", rounds, gap)
        targets = {v: x / x.sum() if x.sum() > 0 else np.full(len(x), 1 / len(x)) for v, x in agreed.items()}

        layers, core = selection.clip([m for m in marginals if len(m) > 1], domain.attrs) if c.append else ([], marginals)
        later = {a for layer in layers for a in layer.ancestor}
        attrs = [a for a in domain if a not in later]
        size = c.num_synthesize_records
        rows = self.initialise(spark, domain, targets, attrs, size, marginals)
        groups = selection.components([m for m in core if set(m) <= set(attrs)], attrs) if c.sep_syn else [(set(attrs), [m for m in core if set(m) <= set(attrs)])]
        shards = c.shards or max(1, size // 50_000)
        for part, ms in groups:
            names = [a for a in attrs if a in part]
            wanted = {domain.canonical(m): targets[domain.canonical(m)] for m in ms if len(m) > 1}
            if wanted and c.update_iterations:
                done = update.run_shards(rows.select("row_id", *names), domain.project(names), wanted, shards, c.update_iterations, c.update_rate_method, c.update_rate_initial, c.update_method, c.seed or 0)
                rows = done if len(names) == len(attrs) else rows.drop(*names).join(done, "row_id")
        for layer in reversed(layers):
            for a, anchor in layer.ancestor.items():
                rows = self.kept(rows)  # read twice below
                v = domain.canonical(layer.marginal[a])
                rows = quota.append(rows, self.table(spark, domain, v, targets[v]).drop("cell"), anchor, a, F.xxhash64("row_id", F.lit(a)))
        out = rows = self.kept(rows)
        self.dump("synthesize", rows, (), maps)
        grouped = [a for a in domain if changed[a]]
        held = local(count_sets(rows, [(a,) for a in grouped])) if grouped else None
        for a in domain:
            if a in grouped:
                out = recode.decode(out, a, maps[a], F.xxhash64("row_id", F.lit(f"recode {a}")), held.where(F.col("view") == a).select(a, "count"))
        out = out.select("row_id", *domain.attrs)
        out = self.kept(out) if self.store is not None else out  # dumped and saved
        self.dump("postprocessing", out)
        table = model.decode(out.drop("row_id"), c.seed, use_diff=not c.faithful)
        codes.unpersist()
        if self.store is not None:
            self.store.save("synthesized", out)
            out = self.store.load("synthesized")
            table = model.decode(out.drop("row_id"), c.seed, use_diff=not c.faithful)
        return Result(table, out, marginals, targets, ledger, domain, gap)
