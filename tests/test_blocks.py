"""Models that pass over their rows many times do so in few tasks."""

import numpy as np
from pyspark.ml.linalg import Vectors

from millrace.operators import boosting, mining
from millrace.operators.boosting import Growth


def test_a_pass_takes_as_many_tasks_as_its_rows_are_worth(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    rows = [(f"2024-01-{1 + i % 28:02d}", i, Vectors.dense(v), float(v[0] * 2 + np.sin(v[1]))) for i, v in enumerate(x)]
    data = spark.createDataFrame(rows, ["date", "stock_id", "features", "label"]).repartition(48)
    spark.sparkContext.setJobGroup("passes", "passes")
    trees, _ = boosting.boost(boosting.binned_rows(data, 3, None)[0], 3, Growth(trees=10, depth=3))
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("passes") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(trees) == 10 and tasks < 48 * 10  # 30 passes


def test_selectors_see_all_rows_once(spark):
    rng = np.random.default_rng(2)
    rows = [(f"2024-01-{1 + i % 28:02d}", i, float(v[0]), float(v[1]), float(v[0] - v[1])) for i, v in enumerate(rng.normal(size=(500, 2)))]
    panel = spark.createDataFrame(rows, "date string, stock_id long, a double, b double, forward_1d_ret double").repartition(40)
    seen = []
    mining.mine(panel, ["a", "b"], {"m": lambda data, factors: seen.append((data.rdd.getNumPartitions(), data.count(), data.distinct().count())) or {}})
    assert seen == [(1, 500, 500)]
