"""Segment plans: the reference track's cuts, the followers aligned to them, and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exact import ceil_div, rescale
from tickloom.operators.series import TRACK, at_or_after, greedy_boundaries
from tickloom.sources.views import tracks

#: One day of events.
TARGET_MS = 24_000


def reference_track(track_table: DataFrame) -> DataFrame:
    """(asset_id, reference): the first video track, or else the first track."""
    return track_table.groupBy("asset_id").agg(F.coalesce(F.min(F.when(F.col("track_id") == 1, F.col("track_id"))), F.min("track_id")).alias("reference"))


def segment_plan(samples: DataFrame, target_ms: int = TARGET_MS) -> DataFrame:
    """(asset_id, track_id, segment_index, first_sample, end_sample, decode_time, duration) of each track's part of each segment.

    Followers are cut at the reference's instants, start inclusive and end exclusive; the last
    segment takes the rest; a track that has ended has no part, but an empty part in the middle
    stays.
    """
    all_tracks = tracks(samples)
    ref = reference_track(all_tracks)
    chosen = samples.join(ref, "asset_id").where("track_id = reference").drop("reference")
    cuts = greedy_boundaries(chosen, target_ms)
    w = Window.partitionBy("asset_id").orderBy("segment_index")
    totals = all_tracks.select(*TRACK, "timescale", "samples", "end_time")
    own = cuts.join(totals, list(TRACK)).withColumn("next_sample", F.lead("first_sample").over(w)).withColumn("next_time", F.lead("decode_time").over(w))
    own = own.select(
        *TRACK, "segment_index", "timescale", "first_sample", F.coalesce("next_sample", "samples").alias("end_sample"), "decode_time",
        (F.coalesce("next_time", "end_time") - F.col("decode_time")).alias("duration"), F.col("next_time").isNull().alias("last"),
    )

    followers = totals.join(ref, "asset_id").where("track_id <> reference").drop("reference").withColumnRenamed("timescale", "own_scale")
    instants = own.select("asset_id", "segment_index", "last", rescale("decode_time", "timescale", 1).alias("_"), F.col("decode_time").alias("ref_time"), "timescale")
    probes = followers.join(instants.drop("_"), "asset_id").select(*TRACK, rescale("ref_time", "timescale", "own_scale").alias("t"), "segment_index", "last", "samples", "end_time")
    firsts = at_or_after(samples, probes).withColumn("first_sample", F.coalesce("first_sample", "samples"))
    v = Window.partitionBy(*TRACK).orderBy("segment_index")
    ends = firsts.withColumn("end_sample", F.when(F.col("last"), F.col("samples")).otherwise(F.lead("first_sample").over(v))).where("first_sample < samples")
    times = samples.select(*TRACK, F.col("sample_index").alias("first_sample"), F.col("decode_time").alias("first_time"))
    parts = ends.join(times, [*TRACK, "first_sample"])
    after = samples.select(*TRACK, F.col("sample_index").alias("end_sample"), F.col("decode_time").alias("next_time"))
    parts = parts.join(after, [*TRACK, "end_sample"], "left").select(
        *TRACK, "segment_index", "first_sample", "end_sample", F.col("first_time").alias("decode_time"),
        F.greatest(F.coalesce("next_time", "end_time") - F.col("first_time"), F.lit(0).cast("bigint")).alias("duration"),
    )
    return own.select(*parts.columns).unionByName(parts)


def segment_bytes(samples: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with its payload bytes, from a running sum of sizes: two point lookups a part instead of a range join."""
    w = Window.partitionBy(*TRACK).orderBy("sample_index")
    upto = samples.select(*TRACK, F.col("sample_index").alias("end_sample"), (F.sum("size").over(w) - F.col("size")).alias("before"))
    whole = samples.groupBy(*TRACK).agg(F.sum("size").alias("whole"))
    lower = plan.join(upto.withColumnsRenamed({"end_sample": "first_sample", "before": "low"}), [*TRACK, "first_sample"])
    both = lower.join(upto, [*TRACK, "end_sample"], "left").join(whole, list(TRACK))
    return both.select(*plan.columns, (F.coalesce("before", "whole") - F.col("low")).alias("bytes"))


def rates(samples: DataFrame, plan: DataFrame) -> DataFrame:
    """(asset_id, track_id, average_rate, peak_rate) in bits a second; parts without duration don't count for the peak."""
    sized = segment_bytes(samples, plan).join(tracks(samples).select(*TRACK, "timescale", F.col("bytes").alias("all_bytes"), (F.col("end_time") - F.col("first_time")).alias("span")), list(TRACK))
    part = F.when(F.col("duration") > 0, rescale(F.col("bytes") * 8, "duration", "timescale"))
    average = F.when(F.col("span") > 0, rescale(F.col("all_bytes") * 8, "span", "timescale")).otherwise(F.lit(0).cast("bigint"))
    return sized.groupBy(*TRACK).agg(F.first(average).alias("average_rate"), F.max(part).alias("_peak")).select(
        *TRACK, "average_rate", F.greatest("average_rate", F.coalesce("_peak", F.lit(0).cast("bigint"))).alias("peak_rate")
    )


def variant_rates(track_rates: DataFrame) -> DataFrame:
    """(asset_id, average_rate, peak_rate): video and the first audio track together."""
    first_audio = F.min(F.when(F.col("track_id") > 1, F.col("track_id"))).over(Window.partitionBy("asset_id"))
    kept = track_rates.withColumn("_a", first_audio).where((F.col("track_id") == 1) | (F.col("track_id") == F.col("_a")))
    return kept.groupBy("asset_id").agg(F.sum("average_rate").alias("average_rate"), F.sum("peak_rate").alias("peak_rate"))


def target_durations(plan: DataFrame, track_table: DataFrame) -> DataFrame:
    """(asset_id, track_id, target_duration): the longest segment in whole seconds, rounded up, 1 at least."""
    joined = plan.join(track_table.select(*TRACK, "timescale"), list(TRACK))
    return joined.groupBy(*TRACK).agg(F.greatest(F.max(ceil_div("duration", "timescale")), F.lit(1).cast("bigint")).alias("target_duration"))
