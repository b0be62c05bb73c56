"""Models and runs of the reference's sizes."""

from tabveil.operators import mlbench
from tabveil.plans import catalogue


def test_classifiers_have_the_sizes_of_the_reference(spark):
    made = {k: mlbench.classifier(k, 3, 5) for k in mlbench.MODELS}
    assert made["lr"].getMaxIter() == made["mlp"].getMaxIter() == 1000
    assert made["rf"].getNumTrees() == 100 and made["gbt"].getClassifier().getMaxIter() == 100
    assert list(made["mlp"].getLayers()) == [3, 100, 5]
    small = mlbench.classifier("gbt", 3, 5, rounds=2).getClassifier()
    assert small.getMaxIter() == 2


def test_whole_run_updates_as_often_as_the_reference(spark, sf_dir, monkeypatch):
    seen = []

    class Seen:
        table = None

        def __init__(self, config):
            seen.append(config.update_iterations)

        def run(self, raw, fields):
            return self

    monkeypatch.setattr(catalogue, "Pipeline", Seen)
    catalogue.QUERIES["synth_end_to_end"](spark, sf_dir)
    assert seen == [200]
