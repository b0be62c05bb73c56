"""Reading traces, and a run's files: Parquet tables and JSON manifests under dataset=/epsilon=."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabveil.domain import Domain
from tabveil.functions.codec import CodecModel
from tabveil.operators.marginals import dump, observed


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A trace with an explicit schema: no pass over the data to infer one."""
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)


def cast_kinds(df: DataFrame, fields: dict) -> DataFrame:
    """Timestamps that are numbers, binned integers and int-exponential fields as longs."""
    kinds = dict(df.dtypes)
    whole = [c for c, s in fields.items() if s.kind in ("timestamp", "binned_integer", "int-exponential") and not kinds[c].startswith("timestamp")]
    return df.select(*(F.col(c).cast("long").alias(c) if c in whole else F.col(c) for c in df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def checked(df: DataFrame, domain: Domain) -> DataFrame:
    """The domain's columns in its order."""
    if gone := [a for a in domain if a not in df.columns]:
        raise ValueError(f"the table lacks {gone}")
    return df.select(*domain.attrs)


def load_dataset(spark: SparkSession, path: str, domain_json: str) -> tuple[DataFrame, Domain]:
    """Codes from a CSV and their domain from a JSON object."""
    domain = Domain.from_dict(json.loads(_read(spark, domain_json)))
    return checked(read_csv(spark, path, ", ".join(f"`{a}` int" for a in domain)), domain), domain


def random_dataset(spark: SparkSession, domain: Domain, n: int, seed: int | None = None) -> DataFrame:
    """n rows of independent uniform codes."""
    return spark.range(n).select(*(F.floor(F.rand(None if seed is None else seed + k) * size).cast("int").alias(a) for k, (a, size) in enumerate(domain.sizes.items())))


def _read(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def _write(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\x00")


class RunStore:
    """The tables and manifests of one run; all files go through Spark, so any of its file systems will do."""

    def __init__(self, spark: SparkSession, root: str, dataset: str, epsilon: float) -> None:
        self.spark, self.base = spark, f"{root}/dataset={dataset}/epsilon={epsilon:g}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.path(name))

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def save_json(self, name: str, value) -> None:
        _write(self.spark, self.path(f"{name}.json"), json.dumps(value))

    def load_json(self, name: str):
        return json.loads(_read(self.spark, self.path(f"{name}.json")).replace("\x00", ""))

    def save_marginals(self, marginals: Sequence[Sequence[str]]) -> None:
        self.save_json("marginals", [list(m) for m in marginals])

    def load_marginals(self) -> list[tuple[str, ...]]:
        return [tuple(m) for m in self.load_json("marginals")]

    def save_codec(self, codec: CodecModel) -> None:
        self.save_json("codec", {"fields": {c: vars(s) for c, s in codec.fields.items()}, "domain": codec.domain.sizes, "firsts": codec.firsts, "lows": codec.lows, "dictionaries": list(codec.dictionaries)})
        for c, table in codec.dictionaries.items():
            self.save(f"dictionary/{c}", table)

    def load_codec(self) -> CodecModel:
        from tabveil.config import FieldSpec

        m = self.load_json("codec")
        return CodecModel({c: FieldSpec(**s) for c, s in m["fields"].items()}, Domain.from_dict(m["domain"]), {c: self.load(f"dictionary/{c}") for c in m["dictionaries"]}, m["firsts"], m["lows"])

    def decode_saved(self, name: str, seed: int | None = None) -> DataFrame:
        return self.load_codec().decode(self.load(name), seed)

    def dump_marginal(self, stage: str, df: DataFrame, attrs: Sequence[str]) -> None:
        """One marginal of a stage as CSV, largest count first; a table that has counts already is taken as one."""
        dump(df if "count" in df.columns else observed(df, attrs), self.path(f"dump/{stage}"))
