"""Draws by weight, and fits that are broken off and go on."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessella.operators import generate, hdp, states


def test_frequencies_of_weighted_draws(spark):
    """Draws of one row each against the weights, within four standard deviations."""
    weights = {0: 1.0, 1: 2.0, 2: 5.0, 3: 0.0, 4: 12.0}
    rows = spark.createDataFrame([(k, w) for k, w in weights.items()], "k long, w double").repartition(3).cache()
    n = 120
    drawn = [hdp.weighted_draw(rows, F.col("k"), F.col("w"), seed).first().k for seed in range(n)]
    for k, w in weights.items():
        p = w / 20
        assert abs(drawn.count(k) - n * p) <= 4 * np.sqrt(n * p * (1 - p)) + 1e-9
    assert hdp.weighted_draw(rows, F.col("k"), F.col("w"), 3).first() == hdp.weighted_draw(rows.repartition(5), F.col("k"), F.col("w"), 3).first()
    alike = [hdp.weighted_draw(rows, F.col("k"), F.lit(0.0), seed).first().k for seed in range(40)]
    assert all(1 <= alike.count(k) <= 20 for k in weights)
    assert hdp.weighted_draw(rows.where("false"), F.col("k"), F.col("w"), 1).count() == 0


def test_a_partner_is_drawn_by_its_distance_inside_the_dish(spark):
    first = Row(vec_id=0, dish_id=1, x=[0.0, 0.0])
    rows = [(0, 1, [0.0, 0.0]), (1, 1, [3.0, 4.0]), (2, 1, [0.0, 15.0]), (3, 2, [99.0, 0.0]), (4, 1, None), (5, 1, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, dish_id long, x array<double>").cache()
    drawn = [hdp.partner(frame, first, seed).first().vec_id for seed in range(60)]
    assert set(drawn) == {1, 2} and 4 <= drawn.count(1) <= 27
    same = frame.where("vec_id in (0, 5)")
    assert hdp.partner(same, first, 1).first().vec_id == 5 and hdp.partner(frame.where("dish_id = 2"), first, 1).count() == 0


def planted(spark):
    found = generate.labelled_clusters(spark, 2, 20, 2, 8, 12.0)
    state = found.select("vec_id", (F.col("vec_id") % 3).alias("group_id"), F.col("vec_id").alias("table_id"), (F.col("vec_id") % 5).alias("dish_id"), "x")
    whole = hdp.moments(state.withColumn("k", F.lit(0)), "k").first()
    return state, hdp.Prior(np.array(whole.total) / whole.n, np.eye(2) * 2, 0.05, 4.0)


def rows_of(state, spark):
    return sorted((r.vec_id, r.group_id, r.table_id, r.dish_id) for r in state.vectors(spark).collect())


def test_a_broken_fit_ends_like_an_unbroken_one(spark, tmp_path, monkeypatch):
    vectors, prior = planted(spark)
    whole = states.fit(vectors, prior, 3, 5, states.States(spark, f"file://{tmp_path}/whole"), proposals=1, scales=True, by_distance=True)
    root = states.States(spark, f"file://{tmp_path}/broken")
    original, calls = hdp.table_scan, []

    def dies(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("driver lost")
        return original(*args)

    monkeypatch.setattr(hdp, "table_scan", dies)
    with pytest.raises(RuntimeError, match="driver lost"):
        states.fit(vectors, prior, 3, 5, root, proposals=1, scales=True, by_distance=True)
    monkeypatch.setattr(hdp, "table_scan", original)
    assert root.scans() == [1]
    (tmp_path / "broken" / "making-1").mkdir()  # what a driver lost while writing leaves behind
    resumed = states.fit(vectors, prior, 3, 5, root, proposals=1, scales=True, by_distance=True)
    assert resumed.scan == whole.scan == 3
    assert rows_of(resumed, spark) == rows_of(whole, spark)
    assert (resumed.prior.tau, resumed.prior.kappa) == pytest.approx((whole.prior.tau, whole.prior.kappa))
    best = root.best()
    assert best.log_probability >= root.last().log_probability and len(root.scans()) <= 2
    assert not list((tmp_path / "broken").glob("making-*")) and not list((tmp_path / "broken").glob("work-*"))
    again = states.fit(vectors, prior, 3, 5, root)
    assert again.scan == 3 and rows_of(again, spark) == rows_of(whole, spark)
    with pytest.raises(ValueError, match="seed"):
        states.fit(vectors, prior, 4, 6, root)


def test_a_state_is_committed_once(spark, tmp_path):
    vectors, prior = planted(spark)
    kept = states.States(spark, f"file://{tmp_path}/s")
    assert kept.last() is None and kept.best() is None and kept.scans() == []
    kept.commit(vectors, prior, 1, 5, -10.0)
    assert kept.commit(vectors.limit(1), prior, 1, 5, -1.0).log_probability == -10.0
    kept.commit(vectors, prior, 2, 5, -20.0)
    kept.commit(vectors, prior, 3, 5, -30.0)
    kept.clear()
    assert kept.scans() == [1, 3] and kept.best().scan == 1 and kept.last().scan == 3
    assert kept.last().vectors(spark).count() == 40 and kept.last().prior.scatter.tolist() == prior.scatter.tolist()
