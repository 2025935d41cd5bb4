"""Queries that once ran a smaller job than the reference."""

import threading

from panelcast.operators import learn
from panelcast.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_forest_queries_run_the_reference_settings(spark, monkeypatch):
    asked = []

    def recorded(df, target, inputs, categories=(), **settings):
        asked.append((tuple(categories), settings))
        return spark.createDataFrame([(1.0,)], "rmse double")

    monkeypatch.setattr(learn, "cross_validate", recorded)
    for name in ("ml01_forest_cv", "ml01_forest_cv_encoded", "ml02_forward_selection"):
        QUERIES[name](spark, SF)
    folds = {c: s["folds"] for c, s in asked[:2]}
    assert folds == {(): 10, ("type", "brand"): 5}
    # Four tries for the first input, three for the second
    assert len(asked) == 2 + 4 + 3 and {s["folds"] for _, s in asked[2:]} == {3}
    assert {(s["trees"], s["depth"], s["per_split"]) for _, s in asked} == {(100, 30, "all")}


def test_forest_grows_in_full(spark, monkeypatch):
    """The settings reach the forest itself."""
    made = []

    class Recorded(learn.RandomForestRegressor):
        def fit(self, frame):
            made.append((self.getNumTrees(), self.getMaxDepth(), self.getFeatureSubsetStrategy()))
            return super().fit(frame)

    monkeypatch.setattr(learn, "RandomForestRegressor", Recorded)
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), float(i % 7)) for i in range(60)],
                               "id long, a double, b double, y double")
    learn.cross_validate(df, "y", ["a", "b"], folds=2, trees=3, depth=9, per_split="all").first()
    learn.forward_selection(df, "y", ["a", "b"], keep=1, folds=2, trees=3, depth=9, per_split="all")
    assert set(made) == {(3, 9, "all")}


def test_tries_of_a_step_run_side_by_side(spark, monkeypatch):
    """A try alone leaves most of a cluster idle; all tries of a step must be under way before one of them ends."""
    steps = {1: threading.Barrier(3), 2: threading.Barrier(2)}

    def waiting(df, target, inputs, categories=(), **settings):
        steps[len(inputs)].wait(timeout=30)
        return spark.createDataFrame([({"a": 3.0, "b": 1.0, "c": 2.0}[inputs[-1]],)], "rmse double")

    monkeypatch.setattr(learn, "cross_validate", waiting)
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0)], "id long, a double, b double, c double, y double")
    assert learn.forward_selection(df, "y", ["a", "b", "c"], keep=2) == [("b", 1.0), ("c", 2.0)]
