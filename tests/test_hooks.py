"""Hooks over batches of groups."""

import numpy as np
import pandas as pd
import pytest

from volumetra.operators import metrics


def test_many_groups_at_once_equal_one_by_one():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 12, 500)
    values = rng.normal(size=sizes.sum()).round(1)
    values[rng.random(len(values)) < 0.02] = np.nan
    starts = np.cumsum(sizes) - sizes
    want = [metrics.trimmed_mean(pd.Series(v)) for v in np.split(values, starts[1:])]
    assert metrics.trimmed_means(values, starts) == pytest.approx([np.nan if w is None else w for w in want], nan_ok=True)


def test_a_hook_is_called_once_for_many_groups(spark):
    """Python is handed batches of groups, not one group a call: 3000 groups in few calls for each of the five values."""
    calls = spark.sparkContext.accumulator(0)

    def many(values, starts):
        calls.add(1)
        return metrics.trimmed_means(values, starts)

    metrics.register_hook(spark, "counted", metrics.trimmed_mean, many)
    p = spark.range(30_000).selectExpr("id % 100 AS participant", "id div 1000 AS tr", *[f"IF(id % 700 = 0, NULL, id % 7.0) AS {c}" for c in metrics.VALUES])
    got = {(r["participant"], r["tr"]): r["px"] for r in metrics.by_tr_hook(p, "counted").collect()}
    assert len(got) == 3000 and calls.value <= 5 * 40
    want = p.groupBy("participant", "tr").agg({"px": "collect_list"}).collect()
    for r in want:
        v = [float(x) for x in r[2]]
        assert got[r[0], r[1]] == (pytest.approx(metrics.trimmed_mean(pd.Series(v))) if len(v) == 10 else None)
