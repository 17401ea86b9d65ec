"""Least squares against DuckDB's: runs whose slope, intercept or phase lies half way between two milliseconds."""

import duckdb
from pyspark.sql import functions as F

from edgewright.functions import bits

RUNS = (
    [0, 13333402054, 26779015103, 48960711092, 61593854855, 66488057444],
    [0, 4409707739, 27262818718, 39772388439, 40794971434, 46309417864, 51375435608, 63121927543, 63391754482],
    [0, 11945058147, 23592301182, 26496929828, 51365325127, 76870974829, 78243864505],
    [0, 11454819105, 23042528089, 49961002461, 57256774172, 76761993283, 89659039187],
    [0, 19386521081, 36672797760, 37358482926, 40228434872, 45207686148, 64428032344, 73124923992],
)


def test_fits_round_as_in_sql(spark):
    points = [(k, [(float(x), float(y)) for x, y in enumerate(run)]) for k, run in enumerate(RUNS)]
    fit = spark.createDataFrame(points, "run int, points array<struct<x:double,y:double>>").select("run", bits.ols(F.col("points")).alias("f"))
    whole = lambda c: F.round(c / 1000).cast("long")
    got = fit.select("run", whole(F.col("f.slope")), whole(F.col("f.intercept")), whole(F.col("f.slope") * 14 / 16), F.col("f.n")).collect()
    con = duckdb.connect()
    for run, *found in got:
        rows = ", ".join(f"({x}::DOUBLE, {y}::DOUBLE)" for x, y in enumerate(RUNS[run]))
        want = con.execute(f"""SELECT round(s / 1000)::BIGINT, round(i / 1000)::BIGINT, round(14 * s / 16000)::BIGINT, n
          FROM (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i, count(*) AS n FROM (VALUES {rows}) v(x, y))""").fetchall()
        assert found == list(want[0]), run


def test_fits_without_spread_are_null(spark):
    points = [(1, []), (2, [(0.0, 1.0)]), (3, [(2.0, 1.0), (2.0, 5.0)]), (4, None), (5, [(0.0, 3.0), (1.0, 3.0)])]
    fit = spark.createDataFrame(points, "run int, points array<struct<x:double,y:double>>").select("run", bits.ols(F.col("points")).alias("f"))
    assert {r[0]: r[1] and tuple(r[1]) for r in fit.collect()} == {1: None, 2: None, 3: None, 4: None, 5: (2, 0.0, 3.0, 0.0)}
