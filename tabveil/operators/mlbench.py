"""Classifiers trained on raw or synthetic rows and tested on raw ones."""

from __future__ import annotations

from collections.abc import Sequence
from math import isfinite

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Bucketizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.operators.perceptron import Perceptron
from tabveil.operators.quota import ordered

MODELS = ("dt", "lr", "rf", "gbt", "mlp")


def classifier(kind: str, features: int, classes: int, seed: int = 42, trees: int = 100, rounds: int = 100, units: int = 100, iterations: int = 1000):
    """A classifier of the reference's size: trees of a forest, rounds of boosting, hidden units, iterations of a solver."""
    common = {"featuresCol": "features", "labelCol": "label"}
    if kind == "dt":
        return DecisionTreeClassifier(seed=seed, **common)
    if kind == "lr":
        return LogisticRegression(maxIter=iterations, **common)
    if kind == "rf":
        return RandomForestClassifier(seed=seed, numTrees=trees, **common)
    if kind == "gbt":  # boosting is binary here, hence one against the rest
        return OneVsRest(classifier=GBTClassifier(seed=seed, maxIter=rounds, maxDepth=3, **common), **common)
    if kind == "mlp":
        return Perceptron(seed=seed, layers=[features, units, classes], maxIter=iterations, **common)
    raise ValueError(f"unknown model {kind}")


def prepare(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], target: str, seed: int = 42) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Rows without nulls, split 80 to 20, features standardised on the training rows."""
    df = df.select(*numbers, *categories, target).na.drop()
    train, test = df.randomSplit([0.8, 0.2], seed)
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__i", stringOrderType="alphabetAsc", handleInvalid="keep") for c in categories]
    stages += [StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip")]
    stages += [VectorAssembler(inputCols=[*numbers, *(f"{c}__i" for c in categories)], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    model = Pipeline(stages=stages).fit(train)
    return model, model.transform(train).select("features", "label").persist(), test


class Bins(Transformer):
    """Features replaced by the numbers of their bins, as trees see them; cuts[j] are the inner edges of feature j."""

    def __init__(self, cuts: Sequence[Sequence[float]]) -> None:
        super().__init__()
        self.cuts = [list(c) for c in cuts]

    def _transform(self, df: DataFrame) -> DataFrame:
        names = [f"__bin_{j}" for j in range(len(self.cuts))]
        edges = [[-float("inf"), *(c or [0.0]), float("inf")] for c in self.cuts]  # one edge at least: a feature without cuts isn't split by a tree
        out = df.select(*df.columns, *(vector_to_array("features")[j].alias(f"__x_{j}") for j in range(len(names))))
        out = Bucketizer(inputCols=[f"__x_{j}" for j in range(len(names))], outputCols=names, splitsArray=edges, handleInvalid="keep").transform(out)
        out = VectorAssembler(inputCols=names, outputCol="__bins").transform(out)
        return out.select(*(F.col("__bins").alias(c) if c == "features" else F.col(c) for c in df.columns))


def bins(train: DataFrame, features: int, most: int) -> Bins:
    """Bins of all rows: one for each value if a feature has at most `most`, else between quantiles."""
    names = [f"x{j}" for j in range(features)]
    x = train.select(*(vector_to_array("features")[j].alias(c) for j, c in enumerate(names)))
    guess = x.agg(*(F.approx_count_distinct(c).alias(c) for c in names)).first()
    cuts, wide = {}, []
    for c in names:
        values = sorted(r[0] for r in x.select(c).distinct().limit(most + 1).collect()) if guess[c] <= 2 * most else []
        if 0 < len(values) <= most:
            cuts[c] = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
        else:
            wide.append(c)
    for c, found in zip(wide, x.approxQuantile(wide, [k / most for k in range(1, most)], 0.001) if wide else [], strict=True):
        cuts[c] = sorted(set(found))
    return Bins([[x for x in cuts[c] if isfinite(x)] for c in names])


def tally(binned: DataFrame) -> DataFrame:
    """Each combination of bins and label once, weighing as many rows as it has: to trees the same table."""
    return binned.groupBy("features", "label").agg(F.count("*").cast("double").alias("weight"))


def boosted(made: OneVsRest, train: DataFrame, features: int, classes: int, at_once: int = 8, rows: int = 20_000) -> PipelineModel:
    """Boosted trees on binned rows, equal ones counted and not read again in each of the rounds; classes are fitted side by side."""
    binner = bins(train, features, made.getClassifier().getMaxBins())
    counted = tally(binner.transform(train)).persist()
    parts = min(train.sparkSession.sparkContext.defaultParallelism, -(-counted.count() // rows))
    few = counted.repartition(max(1, parts)).persist()
    try:
        return PipelineModel([binner, made.setWeightCol("weight").setParallelism(min(classes, at_once)).fit(few)])
    finally:
        few.unpersist()
        counted.unpersist()


def accuracy(kind: str, train: DataFrame, test: DataFrame, seed: int = 42, **sizes: int):
    """A fitted model and its accuracy on prepared rows; `sizes` are those of classifier()."""
    classes = int(train.agg(F.max("label")).first()[0]) + 1
    features = len(train.first()["features"])
    made = classifier(kind, features, classes, seed, **sizes)
    model = boosted(made, train, features, classes) if kind == "gbt" else made.fit(train)
    return model, MulticlassClassificationEvaluator(metricName="accuracy").evaluate(model.transform(test))


def compare(raw: DataFrame, syn: DataFrame, numbers: Sequence[str], categories: Sequence[str], target: str, models: Sequence[str] = MODELS, seed: int = 42, **sizes: int) -> DataFrame:
    """(source, model, accuracy): each model trained on raw and on synthetic rows."""
    out = []
    for name, df in (("raw", raw), ("syn", syn)):
        model, train, test = prepare(df, numbers, categories, target, seed)
        ready = model.transform(test)
        out += [(name, kind, float(accuracy(kind, train, ready, seed, **sizes)[1])) for kind in models]
        train.unpersist()
    return raw.sparkSession.createDataFrame(out, "source string, model string, accuracy double")


def coefficients(model, names: Sequence[str], spark) -> DataFrame:
    """(class, feature, weight) of a logistic regression."""
    m = model.coefficientMatrix.toArray()
    return spark.createDataFrame([(k, names[j], float(m[k, j])) for k in range(m.shape[0]) for j in range(m.shape[1])], "class int, feature string, weight double")


def rules(model, names: Sequence[str], spark) -> DataFrame:
    """(line, depth, rule) of a decision tree, with features by name."""
    import re

    out = []
    for line in model.toDebugString.splitlines()[1:]:
        text = re.sub(r"feature (\d+)", lambda m: names[int(m[1])], line.strip())
        out.append((len(out), (len(line) - len(line.lstrip()) - 2), text))
    return spark.createDataFrame(out, "line int, depth int, rule string")


def class_spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """Least, quartiles and largest value of each class; nulls don't count.

    Quartiles lie between two places of a distributed rank, so that a class is never sorted by one task.
    """
    cuts = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    rows = df.select(F.col(by).alias("__class"), F.col(value).alias("__value"))
    sizes = rows.groupBy("__class").agg(F.count("__value").alias("n"), F.min("__value").alias("low"), F.max("__value").alias("high"))
    placed = ordered(rows.where("__value is not null"), F.col("__value"), ["__class"], "__place", F.col("__value").cast("double"))
    sizes = sizes.select(F.col("__class").alias(by), "n", "low", "high")
    near = placed.join(F.broadcast(sizes), F.col("__class").eqNullSafe(F.col(by)))
    sums = []
    for name, q in cuts.items():
        at = (F.col("n") - 1) * F.lit(q)
        weight = F.when(F.col("__place") == F.floor(at), 1 - (at - F.floor(at))).when(F.col("__place") == F.floor(at) + 1, at - F.floor(at)).otherwise(0.0)
        sums.append(F.sum(F.when(weight > 0, weight * F.col("__value"))).alias(name))
    found = near.groupBy("__class").agg(*sums)
    return sizes.join(F.broadcast(found), F.col(by).eqNullSafe(F.col("__class")), "left").select(by, "low", *cuts, "high")
