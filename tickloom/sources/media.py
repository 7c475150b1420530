"""What a file says of its tracks, as a view over the track table: codec, picture size, sound, language, label.

The tables have no media files, so these are rules of the asset's and the track's id; MEDIA_SQL has the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.origin import known_language


def _pick(key: Column, *values) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def media(tracks: DataFrame) -> DataFrame:
    """tracks with kind, track_key, codec, width, height, rate, channels, language (null unless known), label and version."""
    a, t = F.col("asset_id"), F.col("track_id")
    video, both = t == 1, a + t
    return tracks.select(
        "*",
        F.when(video, "video").otherwise("audio").alias("kind"),
        F.when(video, "video").otherwise(F.concat(F.lit("audio-"), (t - 1).cast("string"))).alias("track_key"),
        F.when(video, _pick(a, "avc1.64001f", "hvc1.1.6.L93.B0")).when(t == 2, "mp4a.40.2").otherwise("opus").alias("codec"),
        F.when(video, _pick(a, 640, 1280, 1920)).cast("bigint").alias("width"),
        F.when(video, _pick(a, 360, 720, 1080)).cast("bigint").alias("height"),
        F.when(~video, _pick(t, 48000, 44100)).cast("bigint").alias("rate"),
        F.when(~video, _pick(both, 2, 6)).cast("bigint").alias("channels"),
        F.when(~video, known_language(_pick(both, "eng", "und", "deu", "EN"))).alias("language"),
        F.when(~video & (both % 5 == 0), F.lit('Main "mix" & <more>')).alias("label"),
        F.left(F.sha2(a.cast("string"), 256), F.lit(16)).alias("version"),
    )


MEDIA_SQL = """,
me AS (SELECT *, CASE track_id WHEN 1 THEN 'video' ELSE 'audio' END AS kind, CASE track_id WHEN 1 THEN 'video' ELSE 'audio-' || (track_id - 1) END AS track_key,
  CASE track_id WHEN 1 THEN CASE asset_id % 2 WHEN 0 THEN 'avc1.64001f' ELSE 'hvc1.1.6.L93.B0' END WHEN 2 THEN 'mp4a.40.2' ELSE 'opus' END AS codec,
  (CASE track_id WHEN 1 THEN CASE asset_id % 3 WHEN 0 THEN 640 WHEN 1 THEN 1280 ELSE 1920 END END)::BIGINT AS width,
  (CASE track_id WHEN 1 THEN CASE asset_id % 3 WHEN 0 THEN 360 WHEN 1 THEN 720 ELSE 1080 END END)::BIGINT AS height,
  (CASE WHEN track_id > 1 THEN CASE track_id % 2 WHEN 0 THEN 48000 ELSE 44100 END END)::BIGINT AS rate,
  (CASE WHEN track_id > 1 THEN CASE (asset_id + track_id) % 2 WHEN 0 THEN 2 ELSE 6 END END)::BIGINT AS channels,
  CASE WHEN track_id > 1 THEN CASE (asset_id + track_id) % 4 WHEN 0 THEN 'eng' WHEN 2 THEN 'deu' END END AS language,
  CASE WHEN track_id > 1 AND (asset_id + track_id) % 5 = 0 THEN 'Main "mix" & <more>' END AS label,
  left(sha256(asset_id::VARCHAR), 16) AS version FROM tr)"""


def subtitles(assets: DataFrame) -> DataFrame:
    """(asset_id, place, language, label, is_default, forced): none, one or two caption files an asset."""
    row = lambda place, language, label, default, forced: F.struct(F.lit(place).cast("bigint").alias("place"), F.lit(language).alias("language"), F.lit(label).alias("label"), F.lit(default).alias("is_default"), F.lit(forced).alias("forced"))
    english, german = row(0, "en", 'English "CC"', True, False), row(1, "de", "Deutsch", False, True)
    files = F.when(F.col("asset_id") % 3 == 1, F.array(english)).when(F.col("asset_id") % 3 == 2, F.array(english, german))
    return assets.select("asset_id", F.explode(files).alias("x")).select("asset_id", "x.*")


SUBTITLES_SQL = """,
su AS (SELECT asset_id, 0::BIGINT AS place, 'en' AS language, 'English "CC"' AS label, true AS is_default, false AS forced FROM (SELECT DISTINCT asset_id FROM tr) WHERE asset_id % 3 > 0
  UNION ALL SELECT asset_id, 1, 'de', 'Deutsch', false, true FROM (SELECT DISTINCT asset_id FROM tr) WHERE asset_id % 3 = 2)"""
