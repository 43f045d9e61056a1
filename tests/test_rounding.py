"""Rounding to six places, held against DuckDB's on values at and beside half a millionth."""

import math
import random

import duckdb

from volumetra.plans.registry import rounded


def test_halves_go_as_in_sql(spark):
    rng, values = random.Random(8), [0.0, 1e-7, -5e-7, 1.5e31, -1e305, 1e308, 4503599627.3704955, None]
    for _ in range(3000):
        v = (rng.randrange(-(10**rng.randrange(1, 13)), 10**12) + 0.5) / 1e6
        values += [v, math.nextafter(v, 1e9), math.nextafter(v, -1e9), rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-8, 12)]
    con = duckdb.connect()
    con.execute("create table v as select unnest(?::double[]) as v, generate_subscripts(?::double[], 1) as i", [values, values])
    wanted = con.execute("select i, round(v, 6) from v order by i").fetchall()
    rows = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "i long, v double")
    assert sorted(map(tuple, rounded(rows).collect())) == wanted
