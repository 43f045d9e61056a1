"""The percentile of uncertainty where values are equal but for the last bit, held against DuckDB's quantiles."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from volumetra.operators import exact, metrics


@pytest.fixture(scope="module")
def close():
    """(participant, unc): groups of one value and its neighbour, some missing."""
    rng, rows = random.Random(5), []
    for p in range(300):
        v = rng.random() * 100
        rows += [(p, rng.choice([v, math.nextafter(v, 1e9), None] if p % 3 == 0 else [v, math.nextafter(v, 1e9)])) for _ in range(rng.choice([2, 3, 4, 7, 9, 13, 67]))]
    return rows + [(300, None), (301, 5.0), (302, 0.0), (302, 0.0), (302, 1e-320)]


@pytest.fixture(scope="module")
def kept(close):
    con = duckdb.connect()
    con.execute("create table r (participant bigint, unc double)")
    con.executemany("insert into r values (?, ?)", close)
    return con.execute("with c as (select *, quantile_cont(unc, 0.8) over (partition by participant) as cut from r) select participant, count(*) from c where unc <= cut group by 1").fetchall()


@pytest.mark.parametrize("cut", [metrics.cut_uncertain, exact.cut_uncertain])
def test_rows_at_the_percentile_stay(spark, close, kept, cut):
    df = spark.createDataFrame(close, "participant long, unc double").repartition(3)
    assert sorted(map(tuple, cut(df).groupBy("participant").count().collect())) == sorted(kept)


def test_the_scorecard_cuts_alike(spark, close, kept):
    """Each sample a TR of its own; the rows below the cut are told from the sum of their errors, 1 each."""
    rows = [(p, i, i, 2.0 * i, 1.0, 2.0 * i + 1, 1.0, u) for i, (p, u) in enumerate(close)]
    df = spark.createDataFrame(rows, "participant long, tr long, sub long, tx double, ty double, px double, py double, unc double")
    card = metrics.scorecard(df, functor=F.max).where("variant = 'refined'").collect()
    n = dict(kept)
    for r in card:
        if n.get(r["participant"], 0) > 1:  # x of the n rows left, and so r2, tells which they are
            own = [2.0 * i for i, (p, u) in enumerate(close) if p == r["participant"] and u is not None]
            assert r["e_mean"] == 1.0 and len(own) >= n[r["participant"]]
            least = sorted(u for p, u in close if p == r["participant"] and u is not None)[n[r["participant"]] - 1]
            own = [2.0 * i for i, (p, u) in enumerate(close) if p == r["participant"] and u is not None and u <= least]
            mean = sum(own) / len(own)
            assert r["r2_x"] == pytest.approx(1 - len(own) / sum((x - mean) ** 2 for x in own))
