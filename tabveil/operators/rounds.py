"""Rounds of shards in the JVM: Rounds.java, compiled by the compiler that Spark brings for its own code."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SOURCE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "Rounds.java")
NAME = "tabveil.Rounds"


def compiled(spark: SparkSession):
    """The class in the driver's JVM; executors get it as a jar, once a context."""
    sc = spark.sparkContext
    held = getattr(sc, "_tabveil_rounds", None)
    if held is None:
        jvm = sc._jvm
        made = jvm.org.codehaus.janino.SimpleCompiler()
        made.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        with open(SOURCE) as f:
            made.cook(f.read())
        classes = made.getBytecodes()
        path = os.path.join(tempfile.mkdtemp(prefix="tabveil-"), "rounds.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for name in classes:
                jar.writestr(name.replace(".", "/") + ".class", bytes(classes[name]))
        sc._jsc.addJar(path)
        held = sc._tabveil_rounds = made.getClassLoader().loadClass(NAME)
    return held


def array(spark: SparkSession, values: np.ndarray, kind: str):
    """A Java array (long, int or double) from its bytes, in one call."""
    jvm = spark.sparkContext._jvm
    size, view = {"long": (8, "asLongBuffer"), "int": (4, "asIntBuffer"), "double": (8, "asDoubleBuffer")}[kind]
    raw = np.ascontiguousarray(values, {"long": ">i8", "int": ">i4", "double": ">f8"}[kind]).tobytes()
    out = spark.sparkContext._gateway.new_array(getattr(jvm, kind), len(raw) // size)
    getattr(jvm.java.nio.ByteBuffer.wrap(raw), view)().get(out)
    return out


def run(rows: DataFrame, sizes: Sequence[int], by: int, home: np.ndarray, weight: np.ndarray, ends: np.ndarray, share: np.ndarray, alpha: Sequence[float], complete: Sequence[float], seed: int) -> DataFrame:
    """`rows` (shard, row_id, codes), whose shards lie in one partition each, after all rounds, without the shard.

    `weight` has a row for each marginal, `share` the shares of all their cells. With `by`, the place of an attribute, its
    codes have a shard each (`home`), and so have their rows; -1 means that shards are alike.
    """
    spark = rows.sparkSession
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    given = [array(spark, np.array(sizes), "int"), by, array(spark, home, "int"), array(spark, weight, "long"), array(spark, ends, "int"), *(array(spark, np.array(x), "double") for x in (share, alpha, complete)), jvm.java.lang.Long.valueOf(str(seed))]
    values = gateway.new_array(jvm.Object, len(given))
    for k, x in enumerate(given):
        values[k] = x
    function = compiled(spark).getConstructors()[0].newInstance(values)
    done = rows._jdf.mapPartitions(function, jvm.org.apache.spark.sql.Encoders.row(rows.drop("shard")._jdf.schema()))
    return DataFrame(done, spark)
