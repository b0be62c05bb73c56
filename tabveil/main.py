"""Command line: `python -m tabveil.main preprocess|synthesize|evaluate --root DIR --dataset_name NAME ...`.

preprocess reads a CSV trace and its fields, learns the codes, and stores codes, codec and a trace decoded from them alone;
synthesize runs on the stored codes and writes records and a CSV; evaluate compares that CSV with the raw one.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tabveil.config import FieldSpec, RunConfig, load_fields, logger, parser
from tabveil.functions import codec
from tabveil.operators import metrics, mlbench, sketches
from tabveil.plans.pipeline import Pipeline, Result
from tabveil.sources.store import RunStore, cast_kinds, read_csv, write_csv

LOG = logger()
TYPES = {"categorical": "string", "float-exponential": "double", "int-exponential": "double"}


def trace(spark: SparkSession, path: str, fields: Mapping[str, FieldSpec]) -> DataFrame:
    """The fields of a CSV with a header, as their kinds ask; other columns are left out."""
    names = spark.read.option("header", True).csv(path).columns  # only the header is read
    kinds = {c: TYPES.get(s.kind, "long") for c, s in fields.items()}
    df = read_csv(spark, path, ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in names))
    if gone := [c for c in fields if c not in names]:
        raise ValueError(f"the trace lacks {gone}")
    return cast_kinds(df.select(*fields), fields)


def preprocess(spark: SparkSession, root: str, config: RunConfig, csv: str, fields: Mapping[str, FieldSpec]) -> RunStore:
    """Codes, codec, and `trivial`, a CSV of the codes decoded without any synthesis."""
    store = RunStore(spark, root, config.dataset_name, config.epsilon)
    raw = trace(spark, csv, fields)
    model = codec.fit(raw, fields)
    store.save("codes", model.encode(raw))
    store.save_codec(model)
    write_csv(store.decode_saved("codes", config.seed), store.path("trivial"))
    return store


def synthesize(spark: SparkSession, root: str, config: RunConfig) -> Result:
    """A run on the stored codes; records, selection, dumps and `csv` go to the same store."""
    store = RunStore(spark, root, config.dataset_name, config.epsilon)
    run = Pipeline(config, store)
    out = run.run_codes(store.load("codes"), store.load_codec())
    write_csv(out.table, store.path("csv"))
    run.release()
    return out


def evaluate(spark: SparkSession, root: str, config: RunConfig, csv: str, fields: Mapping[str, FieldSpec], models: Sequence[str] = mlbench.MODELS, **sizes: int) -> dict[str, DataFrame]:
    """Accuracies of the models, the flow or packet report where its columns are there, and sketch errors of destinations."""
    store = RunStore(spark, root, config.dataset_name, config.epsilon)
    raw, syn = trace(spark, csv, fields), trace(spark, store.path("csv"), fields)
    out = {}
    if config.pred_attr in fields:
        words = [c for c, s in fields.items() if s.kind == "categorical" and c != config.pred_attr]
        numbers = [c for c, s in fields.items() if s.kind != "categorical" and c != config.pred_attr]
        out["accuracy"] = mlbench.compare(raw, syn, numbers, words, config.pred_attr, models, **sizes)
    for name, needed, report in (("flow", (*metrics.FLOW_KEY, "ts", "td", "pkt", "byt"), metrics.flow_report), ("packet", (*metrics.FLOW_KEY, "time", "pkt_len"), metrics.packet_report)):
        if set(needed) <= set(fields):
            out[name] = report(raw, syn)
    if "dstip" in fields:
        out["sketches"] = sketches.report(raw, syn, "dstip")
    for name, df in out.items():
        store.save(f"report/{name}", df)
        LOG.info("%s: %s", name, [tuple(r) for r in store.load(f"report/{name}").collect()])  # a row a measure
    return out


def main(args: Sequence[str] | None = None) -> None:
    own = argparse.ArgumentParser(description=__doc__, parents=[parser()], add_help=True, conflict_handler="resolve")
    own.add_argument("command", choices=("preprocess", "synthesize", "evaluate"))
    own.add_argument("--root", required=True)
    own.add_argument("--csv", default=None)
    own.add_argument("--fields", default=None)
    got = vars(own.parse_args(args))
    command, root, csv, fields = (got.pop(k) for k in ("command", "root", "csv", "fields"))
    config, spark = RunConfig(**got), SparkSession.builder.appName("tabveil").getOrCreate()
    if command == "synthesize":
        synthesize(spark, root, config)
        return
    if not csv or not fields:
        own.error(f"{command} needs --csv and --fields")
    (preprocess if command == "preprocess" else evaluate)(spark, root, config, csv, load_fields(fields))


if __name__ == "__main__":
    main(sys.argv[1:])
