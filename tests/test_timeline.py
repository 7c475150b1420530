"""Timeline operators against plain Python and against their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.functions.exact import ceil_div, rescale, seconds_text
from tickloom.operators.ranges import adjacent_ranges, gap_budget_reads
from tickloom.operators.series import at_or_after, compress_runs, expand_runs, greedy_boundaries
from tickloom.plans import catalog

SF = "/root/testdata/sf0.001"
SERIES = "asset_id long, track_id long, timescale long, sample_index long, decode_time long, duration long, is_sync boolean"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_exact(spark):
    big = 18_446_744_073_709_551
    got = spark.range(1).select(rescale(F.lit(big), 1000, 90000), ceil_div(F.lit(7), 3), seconds_text(F.lit(61_005))).first()
    assert tuple(got) == (big * 90, 3, "61.005")


def test_runs_round_trip(spark):
    data = [(1, 1, 1000, i, t, d, True) for i, (t, d) in enumerate([(0, 5), (5, 5), (10, 7), (20, 7), (27, 7)])]
    df = spark.createDataFrame(data, SERIES)
    runs = compress_runs(df)
    assert [r.n for r in runs.orderBy("run").collect()] == [2, 1, 2]
    assert rows(expand_runs(runs)) == [(1, 1, i, t, d) for _, _, _, i, t, d, _ in data]


def test_greedy_boundaries_reset_at_each_cut(spark):
    times = [0, 900, 1100, 1900, 2200, 3300]
    df = spark.createDataFrame([(1, 1, 1000, i, t, 100, True) for i, t in enumerate(times)], SERIES)
    assert [r.decode_time for r in greedy_boundaries(df, 1000).orderBy("segment_index").collect()] == [0, 1100, 2200, 3300]


def test_at_or_after(spark):
    df = spark.createDataFrame([(1, 1, 1000, i, t, 1, True) for i, t in enumerate([0, 10, 10, 20])], SERIES)
    probes = spark.createDataFrame([(1, 1, t) for t in (0, 5, 10, 11, 21)], "asset_id long, track_id long, t long")
    assert [r.first_sample for r in at_or_after(df, probes).orderBy("t").collect()] == [0, 1, 1, 3, None]


def test_reads(spark):
    pieces = [(1, i, a, n) for i, (a, n) in enumerate([(0, 10), (10, 10), (25, 5), (5, 2), (100, 50)])]
    df = spark.createDataFrame(pieces, "k long, i long, offset long, length long")
    assert rows(adjacent_ranges(df, ["k"], "i").select("offset", "length", "pieces")) == [(0, 20, 2), (5, 2, 1), (25, 5, 1), (100, 50, 1)]
    got = gap_budget_reads(df, ["k"], "i", max_gap=10, budget=6, chunk=40)
    assert rows(got) == [(1, 0, 0, 30, 3), (1, 1, 5, 7, 1), (1, 2, 100, 150, 1)]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()))) == sorted(map(str, want))
