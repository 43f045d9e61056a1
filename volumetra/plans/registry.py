"""The registry of queries with their SQL for DuckDB, and what several of them share. Doubles are rounded to six places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def sixth(v: Column) -> Column:
    """A double to six places as the SQL engine has it: the millionfold to a whole number. ``F.round(v, 6)`` takes the decimal digits instead and differs where the product rounds to a half."""
    return F.when(F.abs(v) < 1e300, F.round(v * 1e6) / 1e6).otherwise(v)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[sixth(F.col(c)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


#: Gaze samples, voxels, grids and predictions in SQL.
G = """g AS (SELECT user_id AS participant, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn,
  CASE WHEN event_type <> 'error' THEN value END AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_type,
  (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS tr, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) -
  1) % 10 AS sub FROM events)"""
V = "v AS (SELECT CAST(label AS BIGINT) AS run, vec_id AS tr, CAST(unnest(range(0, 64)) AS BIGINT) AS vox, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
C = f"{V}, c AS (SELECT tr, vox // 16 AS x, (vox // 4) % 4 AS y, vox % 4 AS z, v FROM v)"
PRED = f"""{G}, p AS (SELECT participant, tr, sub, rn, x AS tx, y AS ty, avg(x) OVER w AS px, avg(y) OVER w AS py FROM g
  WINDOW w AS (PARTITION BY participant ORDER BY rn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), q AS (SELECT *, abs(tx - px) AS unc FROM p)"""
METRICS = """round(covar_pop(tx, px) / nullif(stddev_pop(tx) * stddev_pop(px), 0), 6) AS r_x, round(covar_pop(ty, py) / nullif(stddev_pop(ty) *
stddev_pop(py), 0), 6) AS r_y,
  round((covar_pop(tx, px) / nullif(stddev_pop(tx) * stddev_pop(px), 0) + covar_pop(ty, py) / nullif(stddev_pop(ty) * stddev_pop(py), 0)) / 2, 6) AS r_mean,
  CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(tx) = 0 THEN CASE WHEN sum((tx - px) ** 2) = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sum((tx - px) ** 2) /
  (var_pop(tx) * count(*)) END AS a2,
  CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(ty) = 0 THEN CASE WHEN sum((ty - py) ** 2) = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sum((ty - py) ** 2) /
  (var_pop(ty) * count(*)) END AS b2,
  round(avg(sqrt((tx - px) ** 2 + (ty - py) ** 2)), 6) AS e_mean, round(median(sqrt((tx - px) ** 2 + (ty - py) ** 2)), 6) AS e_median,
  round(stddev_pop(sqrt((tx - px) ** 2 + (ty - py) ** 2)), 6) AS e_std"""
def card(pred: str) -> str:
    """The scorecard in SQL of a relation q (participant, tr, sub, tx, ty, px, py, unc)."""
    return f"""WITH {pred},
ok AS (SELECT participant, tr FROM q GROUP BY ALL HAVING count(*) = count(tx) AND count(*) = count(ty)), f AS (SELECT q.* FROM q JOIN ok USING (participant, tr)),
t AS (SELECT participant, tr, median(tx) AS tx, median(ty) AS ty, median(px) AS px, median(py) AS py, CASE WHEN count(*) = count(unc) THEN median(unc)
END AS unc FROM f GROUP BY ALL),
a AS (SELECT 'subtr' AS granularity, participant, tx, ty, px, py, unc, quantile_cont(unc, 0.8) OVER (PARTITION BY participant) AS cut FROM f
      UNION ALL SELECT 'tr', participant, tx, ty, px, py, unc, quantile_cont(unc, 0.8) OVER (PARTITION BY participant) FROM t),
b AS (SELECT 'all' AS variant, * FROM a UNION ALL SELECT 'refined', * FROM a WHERE unc <= cut),
s AS (SELECT participant, variant, granularity, {METRICS} FROM b GROUP BY ALL),
k AS (SELECT participant, variant, granularity FROM (SELECT DISTINCT participant FROM q), (VALUES ('all'), ('refined')) AS v(variant), (VALUES
('subtr'), ('tr')) AS w(granularity)),
card AS (SELECT participant, variant, granularity, r_x, r_y, r_mean, round(a2, 6) AS r2_x, round(b2, 6) AS r2_y, round((a2 + b2) / 2, 6) AS r2_mean,
e_mean, e_median, e_std FROM k LEFT JOIN s USING (participant, variant, granularity))"""
