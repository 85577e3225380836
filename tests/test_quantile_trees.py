import numpy as np
import pytest
from pyspark.sql import functions as F

from saleflow.operators import model, quantile_trees


def pinball(y, f, q):
    return float(np.where(y >= f, q * (y - f), (q - 1) * (y - f)).sum())


def naive_split(bins, y, f, q, least):
    """Every feature and every cut, by the gradients of the rows themselves."""
    g = np.where(y < f, q - 1, q)
    best = (1e-9, (0, 255))
    for j in range(bins.shape[1]):
        for cut in range(256):
            left = bins[:, j] <= cut
            if least <= left.sum() <= len(y) - least:
                gain = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / len(y)
                if gain > best[0] + 1e-9:
                    best = (gain, (j, cut))
    return best[1]


def test_split_equals_a_naive_search():
    r = np.random.default_rng(3)
    for trial in range(20):
        bins = r.integers(0, 12, (200, 3)).astype(np.uint8)
        y = r.normal(size=200) + bins[:, trial % 3] * 0.4
        q, f = (0.1, 0.5, 0.9)[trial % 3], float(np.median(y))
        n = np.stack([np.bincount(bins[:, j], minlength=256) for j in range(3)])
        below = np.stack([np.bincount(bins[y < f, j], minlength=256) for j in range(3)])
        assert quantile_trees.best_split(below, n, q, 20) == naive_split(bins, y, f, q, 20)
    assert quantile_trees.best_split(n * 0, n, 0.5, 150) == (0, 255)


def test_leaves_follow_the_cuts():
    bins = np.array([[0, 5], [1, 5], [1, 6], [2, 9]], np.uint8)
    feature, cut = np.array([0, 1, 1]), np.array([0, 255, 5])
    assert quantile_trees.leaves(bins, feature, cut).tolist() == [0, 2, 3, 3]


def rows(spark, n, seed):
    """Noise that is wider for one level: the quantiles differ by more than a shift."""
    base = spark.range(n).select("id", F.rand(seed).alias("u"), F.rand(seed + 1).alias("v"), (F.col("id") % 3).cast("string").alias("level"))
    y = 0.6 + 0.3 * F.floor(F.col("u") * 4) / 4 + F.when(F.col("level") == "2", 0.4).otherwise(0.1) * (F.col("v") - 0.5)
    return base.select("id", y.alias("y"), F.when(F.col("id") % 10 != 0, F.col("u")).alias("u"), "level")


def test_quantiles_are_learnt_and_don_t_depend_on_the_partitions(spark, monkeypatch):
    train, held = rows(spark, 6000, 1).cache(), rows(spark, 3000, 7)
    fitted = quantile_trees.fit(train.repartition(3), ["u"], ["level"], "y", rounds=8, rate=0.5)
    same = quantile_trees.Trees(["u"], ["level"], fitted.edges, fitted.levels)  # edges are approximate percentiles
    monkeypatch.setattr(quantile_trees, "frozen", lambda *a: same)
    again = quantile_trees.fit(train.coalesce(1), ["u"], ["level"], "y", rounds=8, rate=0.5)
    assert fitted.start == again.start and all(np.array_equal(x, y) for a, b in zip(fitted.trees, again.trees, strict=True) for s, t in zip(a, b, strict=True) for x, y in zip(s, t, strict=True))
    got = quantile_trees.predict(fitted, held, "id").join(held, "id").toPandas()
    v, y = np.stack(got["values"].to_list()), got.y.to_numpy()
    for k, q in enumerate((0.1, 0.5, 0.9)):
        assert abs((y < v[:, k]).mean() - q) < 0.04
        assert pinball(y, v[:, k], q) < 0.8 * pinball(y, np.quantile(y, q), q)
    wide = (got.level == "2").to_numpy()
    width = v[:, 2] - v[:, 0]
    assert width[wide].mean() > 1.5 * width[~wide].mean()
    odd = spark.createDataFrame([(1, None, "unseen"), (2, 0.3, None), (3, float("nan"), "")], "id long, u double, level string")
    assert len({tuple(r["values"]) for r in quantile_trees.predict(fitted, odd, "id").collect()}) <= 2
    assert quantile_trees.predict(fitted, odd.limit(0), "id").count() == 0


@pytest.mark.parametrize("n", [50])
def test_too_few_rows(spark, n):
    assert model.fit(rows(spark, n, 1).withColumn("target", F.col("y"))) is None
