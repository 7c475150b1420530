"""Media-shaped views over tables of a data folder.

samples: one row a timed sample.  An asset is a user of ``events``; its tracks are video (view and
click, 1000 ticks a second), audio-1 (purchase and signup, 48000) and audio-2 (the rest, 44100).
An hour of events is a second of media.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kept views by application, folder and name: a view that several queries read is kept once.
_kept: dict[tuple[str, str, str], DataFrame] = {}

TRACK_KEYS = {1: "video", 2: "audio-1", 3: "audio-2"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """make(), held in memory or on disk until ``release``; the same one whenever it is asked for."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    # what clearCache has dropped is made anew
    if at not in _kept or not _kept[at].storageLevel.useMemory:
        _kept[at] = make().persist(StorageLevel.MEMORY_AND_DISK)
    return _kept[at]


def release(spark: SparkSession) -> int:
    """Gives up all kept views of this application."""
    gone = [at for at in _kept if at[0] == spark.sparkContext.applicationId]
    for at in gone:
        _kept.pop(at).unpersist()
    return len(gone)


def samples(spark: SparkSession, sf_dir: str, reuse: bool = False) -> DataFrame:
    """reuse: kept (see ``kept``), for plans that read the series several times.

    (asset_id, track_id, timescale, sample_index, offset, size, decode_time, duration, composition_offset, is_sync)
    """
    if reuse:
        return kept(spark, sf_dir, "samples", lambda: samples(spark, sf_dir))
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    track = F.when(kind.isin("view", "click"), 1).when(kind.isin("purchase", "signup"), 2).otherwise(3)
    whole = Window.partitionBy("asset_id").orderBy("us", "event_id")
    # the same partitioning by asset serves both windows: one shuffle
    own = Window.partitionBy("asset_id", "track_id").orderBy("us", "event_id")
    base = events.select(
        F.col("user_id").alias("asset_id"), track.cast("bigint").alias("track_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "event_id", kind.alias("event_type"), F.round(F.col("value") * 100).cast("bigint").alias("size"),
    )
    base = base.withColumn("timescale", F.when(F.col("track_id") == 1, 1000).when(F.col("track_id") == 2, 48000).otherwise(44100).cast("bigint"))
    placed = base.withColumn("first_us", F.first("us").over(whole)).withColumn("offset", F.coalesce(F.sum("size").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    timed = placed.withColumn("decode_time", F.expr("((us - first_us) * timescale) div 3600000000")).withColumn("sample_index", F.row_number().over(own).cast("bigint") - 1)
    return timed.select(
        "asset_id", "track_id", "timescale", "sample_index", "offset", "size", "decode_time",
        F.coalesce(F.lead("decode_time").over(own) - F.col("decode_time"), F.col("timescale")).alias("duration"),
        ((F.col("event_id") % 3 - 1) * 10).cast("bigint").alias("composition_offset"),
        ((F.col("track_id") != 1) | (F.col("event_type") == "view") | (F.col("sample_index") == 0)).alias("is_sync"),
    )


def tracks(samples: DataFrame) -> DataFrame:
    """(asset_id, track_id, timescale, samples, first_time, end_time, bytes)"""
    return samples.groupBy("asset_id", "track_id", "timescale").agg(
        F.count(F.lit(1)).alias("samples"),
        F.min("decode_time").alias("first_time"),
        F.max_by(F.col("decode_time") + F.col("duration"), F.col("sample_index")).alias("end_time"),
        F.sum("size").alias("bytes"),
    )


SAMPLES_SQL = """
ev AS (SELECT user_id AS asset_id, event_id, event_type, epoch_us(ts) AS us, round(value * 100)::BIGINT AS size,
  (CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type IN ('purchase', 'signup') THEN 2 ELSE 3 END)::BIGINT AS track_id FROM events),
ev2 AS (SELECT *, (CASE track_id WHEN 1 THEN 1000 WHEN 2 THEN 48000 ELSE 44100 END)::BIGINT AS timescale,
  min(us) OVER (PARTITION BY asset_id) AS first_us, row_number() OVER (PARTITION BY asset_id, track_id ORDER BY us, event_id) - 1 AS sample_index,
  coalesce(sum(size) OVER (PARTITION BY asset_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM ev),
ev3 AS (SELECT *, ((us - first_us)::HUGEINT * timescale // 3600000000)::BIGINT AS decode_time FROM ev2),
s AS (SELECT asset_id, track_id, timescale, sample_index, "offset", size, decode_time,
  coalesce(lead(decode_time) OVER (PARTITION BY asset_id, track_id ORDER BY sample_index) - decode_time, timescale) AS duration,
  ((event_id % 3 - 1) * 10)::BIGINT AS composition_offset, track_id <> 1 OR event_type = 'view' OR sample_index = 0 AS is_sync FROM ev3),
tr AS (SELECT asset_id, track_id, timescale, count(*) AS samples, min(decode_time) AS first_time, arg_max(decode_time + duration, sample_index) AS end_time, sum(size)::BIGINT AS bytes
  FROM s GROUP BY ALL)"""
