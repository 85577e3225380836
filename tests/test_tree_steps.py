"""Predictions that are carried on by a tree at a time."""

import random

import numpy as np

from saleflow.operators import quantile_trees as qt


def test_a_fit_tries_each_tree_on_a_row_once(spark, monkeypatch):
    r = random.Random(2)
    rows = spark.createDataFrame([(i, x := r.random(), r.choice("abc"), x + r.random() / 5) for i in range(400)], "id long, x double, c string, y double")
    model = qt.fit(rows, ["x"], ["c"], "y", rounds=4)
    assert [len(t) for t in model.trees] == [4, 4, 4]
    bins = np.array([[b, k] for b in range(64) for k in range(4)], np.uint8)
    first = qt.Trees(model.numbers, model.codes, start=model.start, trees=[t[:2] for t in model.trees])
    assert (model.add(first.predict(bins), bins, 2) == model.predict(bins)).all()  # the same sums to the last bit
    monkeypatch.setattr(qt.Trees, "predict", lambda *a: 1 / 0)
    assert qt.Trees.add(model, np.tile(np.array(model.start), (len(bins), 1)), bins).shape == (256, 3)
