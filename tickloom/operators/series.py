"""Operators on one series of samples: lookups, run-length tables, keyframes, boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ordered import ordered_scan

TRACK = ("asset_id", "track_id")


def compress_runs(samples: DataFrame) -> DataFrame:
    """Timing runs (run, first_sample, first_time, count, delta): neighbours of equal duration without a gap in time."""
    w = Window.partitionBy(*TRACK).orderBy("sample_index")
    before = F.lag(F.col("decode_time") + F.col("duration")).over(w)
    same = (F.lag("duration").over(w) == F.col("duration")) & (before == F.col("decode_time"))
    flagged = samples.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    numbered = flagged.withColumn("run", F.sum("new").over(w) - 1)
    return numbered.groupBy(*TRACK, "run").agg(
        F.min("sample_index").alias("first_sample"), F.min("decode_time").alias("first_time"), F.count(F.lit(1)).alias("n"), F.first("duration").alias("delta")
    )


def expand_runs(runs: DataFrame) -> DataFrame:
    """(sample_index, decode_time, duration) of each sample of timing runs."""
    each = runs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return each.select(*TRACK, (F.col("first_sample") + F.col("i")).alias("sample_index"), (F.col("first_time") + F.col("i") * F.col("delta")).alias("decode_time"), F.col("delta").alias("duration"))


def at_or_after(samples: DataFrame, probes: DataFrame, time_col: str = "t") -> DataFrame:
    """First sample whose decode time is t or later, for each probe (asset_id, track_id, t, ...); null after the last.

    Probes and samples are sorted together by time, so the cost is one sort of both and no
    product of the two.
    """
    extra = [c for c in probes.columns if c not in (*TRACK, time_col)]
    nothing = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra]
    rows = samples.select(*TRACK, F.col("decode_time").alias("_t"), F.col("sample_index").alias("_i"), F.lit(False).alias("_probe"), *nothing).unionByName(
        probes.select(*TRACK, F.col(time_col).alias("_t"), F.lit(None).cast("bigint").alias("_i"), F.lit(True).alias("_probe"), *extra)
    )
    later = Window.partitionBy(*TRACK).orderBy(F.col("_t").desc(), F.col("_probe").asc(), F.col("_i").desc())
    found = rows.withColumn("first_sample", F.last("_i", ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, 0)))
    return found.where("_probe").select(*TRACK, F.col("_t").alias(time_col), *extra, "first_sample")


def keyframes(samples: DataFrame) -> DataFrame:
    """(nth, sample_index, decode_time, interval, size) of the sync samples; the last lasts to the track's end."""
    w = Window.partitionBy(*TRACK).orderBy("sample_index")
    whole = Window.partitionBy(*TRACK).orderBy("sample_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ended = samples.withColumn("end_time", F.last(F.col("decode_time") + F.col("duration")).over(whole)).where("is_sync")
    return ended.select(
        *TRACK, "timescale", (F.row_number().over(w) - 1).cast("bigint").alias("nth"), "sample_index", "decode_time",
        (F.coalesce(F.lead("decode_time").over(w), F.col("end_time")) - F.col("decode_time")).alias("interval"), "size",
    )


def greedy_boundaries(samples: DataFrame, target_ms: int) -> DataFrame:
    """(asset_id, track_id, segment_index, first_sample, decode_time): cuts at the first sync sample at least target after the last cut.

    The next cut depends on the last, so the sync samples of a track are scanned in order; the state is one due time.
    """

    def step(state, row):
        if row is None:
            return None, []
        timescale, index, time = row
        if state is not None and time < state[0]:
            return state, []
        number = state[1] if state else 0
        return (time + target_ms * timescale // 1000, number + 1), [(number, index, time)]

    sync = samples.where(F.col("is_sync") | (F.col("sample_index") == 0))
    return ordered_scan(sync, list(TRACK), "sample_index", ["timescale", "sample_index", "decode_time"], step, [("segment_index", "bigint"), ("first_sample", "bigint"), ("decode_time", "bigint")])
