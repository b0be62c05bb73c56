"""Classifiers that are fitted in another way than Spark's own, against Spark's own."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabveil.operators import mlbench, perceptron


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(int) + (x[:, 2] > 0.7)
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x.tolist(), y.tolist(), strict=True)], ["features", "label"]).coalesce(1).persist()


@pytest.mark.parametrize("layers", [[3, 4], [3, 5, 4], [3, 6, 5, 4]])
def test_perceptron_gradient(layers):
    rng = np.random.default_rng(1)
    x, y = np.vstack([rng.normal(size=(3, 50)), np.ones(50)]), rng.integers(0, 4, 50)
    w = rng.normal(size=sum((a + 1) * b for a, b in zip(layers, layers[1:], strict=False)))
    slopes = [(perceptron.loss(x, y, w + h, layers)[0] - perceptron.loss(x, y, w - h, layers)[0]) / 2e-6 for h in np.eye(len(w)) * 1e-6]
    assert perceptron.loss(x, y, w, layers)[1] == pytest.approx(np.array(slopes), rel=1e-4, abs=1e-5)


def test_perceptron_is_sparks_on_all_cores(spark, points):
    dealt = perceptron.packed(points, "features", "label", spark.sparkContext.defaultParallelism)
    assert points.rdd.getNumPartitions() == 1
    assert min(dealt.map(lambda b: len(b[1])).glom().map(sum).collect()) > 0.8 * 3000 / spark.sparkContext.defaultParallelism

    mine = mlbench.classifier("mlp", 3, 3, units=8, iterations=60).fit(points)
    assert isinstance(mlbench.classifier("mlp", 3, 3), perceptron.Perceptron)
    theirs = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", seed=42, layers=[3, 8, 3], maxIter=60).fit(points)
    said = [m.transform(points).select(F.avg(-F.log(vector_to_array("probability")[F.col("label").cast("int")]))).first()[0] for m in (mine, theirs)]
    assert said[0] == pytest.approx(mine.values[-1], rel=1e-6)  # the weights mean the same to Spark
    assert mine.values[0] == pytest.approx(theirs.summary().objectiveHistory[0], rel=0.02)  # Spark weighs its last, shorter blocks more
    assert said[0] <= 1.1 * said[1] < 0.5 * mine.values[0]
    assert len(mine.values) <= 61 and mine.getMaxIter() == 60


def test_perceptron_stops_as_sparks(spark):
    few = spark.createDataFrame([(Vectors.dense([0.0]), 0.0), (Vectors.dense([0.0]), 1.0)], ["features", "label"])
    made = perceptron.Perceptron(layers=[1, 2], maxIter=1000, seed=1).fit(few)
    assert len(made.values) < 30 and made.values[-1] == pytest.approx(np.log(2), abs=1e-6)


def test_boosting_on_counted_bins_is_boosting_on_rows(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 5, 4000), rng.normal(size=4000), rng.integers(0, 3, 4000)])
    y = (x[:, 0] > 2).astype(int) + ((x[:, 1] > 0.3) & (x[:, 2] == 1))
    train = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x.tolist(), y.tolist(), strict=True)], ["features", "label"]).persist()
    binner = mlbench.bins(train, 3, 32)
    assert [len(c) for c in binner.cuts] == [4, 31, 2] and binner.cuts[0] == [0.5, 1.5, 2.5, 3.5]
    binned = binner.transform(train)
    counted = mlbench.tally(binned)
    assert counted.count() <= 5 * 32 * 3 * 3 and counted.agg(F.sum("weight")).first()[0] == 4000
    made = mlbench.classifier("gbt", 3, 3, rounds=4)
    on_rows = made.fit(binned).transform(counted)
    model = mlbench.boosted(made, train, 3, 3)
    assert model.stages[0].cuts == binner.cuts
    on_counts = model.stages[1].transform(counted)
    key = ["features", "label"]
    pairs = on_rows.select(*key, F.col("prediction").alias("p")).join(on_counts.select(*key, "prediction"), key)
    assert pairs.count() == counted.count() and pairs.where("p != prediction").count() == 0
    assert model.transform(train).where("prediction = label").count() > 0.9 * 4000


def test_boosting_reads_each_combination_once(spark, monkeypatch):
    rows = spark.createDataFrame([(Vectors.dense([float(i % 4)]), float(i % 2)) for i in range(400)], ["features", "label"])
    seen = []
    fit = mlbench.OneVsRest.fit
    monkeypatch.setattr(mlbench.OneVsRest, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    _, got = mlbench.accuracy("gbt", rows, rows, rounds=2)
    assert seen == [4] and got == 1.0


def test_bins_of_odd_features(spark):
    one = spark.createDataFrame([(Vectors.dense([1.0, float(i)]), float(i % 2)) for i in range(100)], ["features", "label"])
    got = mlbench.bins(one, 2, 4)
    assert got.cuts[0] == [] and len(got.cuts[1]) == 3
    assert got.transform(one).select(vector_to_array("features")[0]).distinct().count() == 1
