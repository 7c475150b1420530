"""Grids: renditions that are each a sequence of clips, as HLS masters, media playlists and DASH manifests, each with its SQL.

Of the assets whose ids agree modulo GROUPS, every third one in order of id is of the same rendition, and three in a row are the
renditions of one clip.  Clips that lack a rendition are left out: every rendition needs the same clips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exact import rescale
from tickloom.operators.series import TRACK
from tickloom.plans.catalog import PLAN_SQL, _with
from tickloom.plans.manifests import _CLOSE_SET, _OPEN, _PROFILE, _SECONDS, _SET_SQL, _TIMELINE_SQL, _nanos, _representation_sql, representations, set_head, timelines
from tickloom.plans.playlists import _ENTRY, _HEADER, GROUPS, SEGMENT_LINES_SQL, _body, _header, _optional, _prepared, _text, _yes, segment_lines
from tickloom.plans.segments import target_durations
from tickloom.sources.media import MEDIA_SQL
from tickloom.sources.views import tracks

RENDITIONS = 3

Q: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def cells(plan: DataFrame, m: DataFrame) -> DataFrame:
    """(grid, rendition, clip, asset_id, first_segment, start_ns, total_ns, gversion): numbers and times go on over a rendition's clips, by the clips of the first one."""
    video = m.where("kind = 'video'").select("asset_id", rescale(F.col("end_time") - F.col("first_time"), "timescale", 1_000_000_000).alias("ns"))
    n = plan.groupBy("asset_id").agg((F.max("segment_index") + 1).alias("segments"))
    own = video.join(n, "asset_id").withColumn("grid", F.col("asset_id") % GROUPS)
    place = F.row_number().over(Window.partitionBy("grid").orderBy("asset_id")) - 1
    own = own.withColumn("p", place).withColumn("rendition", (F.col("p") % RENDITIONS).cast("bigint")).withColumn("clip", F.expr(f"p div {RENDITIONS}"))
    own = own.withColumn("whole", F.count(F.lit(1)).over(Window.partitionBy("grid", "clip"))).where(F.col("whole") == RENDITIONS)
    before = Window.partitionBy("grid", "rendition").orderBy("clip").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    own = own.withColumn("first_segment", F.coalesce(F.sum("segments").over(before), zero)).withColumn("own_ns", F.coalesce(F.sum("ns").over(before), zero))
    own = own.withColumn("start_ns", F.max(F.when(F.col("rendition") == 0, F.col("own_ns"))).over(Window.partitionBy("grid", "clip"))).withColumn("total_ns", F.sum(F.when(F.col("rendition") == 0, F.col("ns"))).over(Window.partitionBy("grid")))
    version = F.left(F.sha2(F.concat(F.lit("grid "), F.col("grid").cast("string")), 256), F.lit(16))
    return own.select("grid", "rendition", "clip", "asset_id", "first_segment", "start_ns", "total_ns", version.alias("gversion"))


CELLS_SQL = f""",
c0 AS (SELECT asset_id, asset_id % {GROUPS} AS grid, row_number() OVER (PARTITION BY asset_id % {GROUPS} ORDER BY asset_id) - 1 AS p, ((end_time - first_time)::HUGEINT * 1000000000 // timescale)::BIGINT AS ns, (SELECT max(segment_index) + 1 FROM plan WHERE plan.asset_id = tr.asset_id) AS segments FROM tr WHERE track_id = 1),
c1 AS (SELECT * FROM (SELECT *, p % {RENDITIONS} AS rendition, p // {RENDITIONS} AS clip, count(*) OVER (PARTITION BY grid, p // {RENDITIONS}) AS whole FROM c0) WHERE whole = {RENDITIONS}),
c2 AS (SELECT *, coalesce(sum(segments) OVER b, 0)::BIGINT AS first_segment, coalesce(sum(ns) OVER b, 0)::BIGINT AS own_ns FROM c1 WINDOW b AS (PARTITION BY grid, rendition ORDER BY clip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ce AS (SELECT grid, rendition, clip, asset_id, first_segment, max(CASE WHEN rendition = 0 THEN own_ns END) OVER (PARTITION BY grid, clip) AS start_ns, sum(CASE WHEN rendition = 0 THEN ns END) OVER (PARTITION BY grid)::BIGINT AS total_ns, left(sha256('grid ' || grid), 16) AS gversion FROM c2)"""


@_query(_with(PLAN_SQL + CELLS_SQL, "SELECT grid, rendition, clip, asset_id, first_segment, start_ns FROM ce"))
def grid_cells(spark, sf_dir: str) -> DataFrame:
    _, plan, m, _ = _prepared(spark, sf_dir)
    return cells(plan, m).select("grid", "rendition", "clip", "asset_id", "first_segment", "start_ns")


def variants(own: DataFrame) -> DataFrame:
    """(grid, rendition, peak, average, codecs, resolution, gversion) over all clips of a rendition: own has its video tracks, cells and rates."""
    ms = rescale(F.col("end_time") - F.col("first_time"), "timescale", 1000)
    best = F.max_by(F.concat_ws("x", "width", "height"), F.struct(F.col("width") * F.col("height"), -F.col("clip")))
    per = own.withColumn("ms", ms).groupBy("grid", "rendition", "gversion").agg(
        F.max("peak_rate").alias("peak"), F.sum(F.col("average_rate").cast("decimal(20,0)") * F.col("ms").cast("decimal(18,0)")).alias("w"), F.sum("ms").cast("decimal(20,0)").alias("t"), best.alias("resolution"),
    )
    w, t = F.col("w"), F.col("t")
    average = F.when(t > 0, ((w - w % t) / t).cast("decimal(38,0)").cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return per.select("grid", "rendition", "gversion", "peak", average.alias("average"), "resolution").join(_codecs(own, ["grid", "rendition"], "codecs"), ["grid", "rendition"])


def _codecs(own: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Each codec once, in the order of the clips."""
    first = own.groupBy(*keys, "codec").agg(F.min("clip").alias("first"))
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "codec"))), lambda x: x["codec"]), ",").alias(name))


VARIANTS_SQL = """,
gv AS (SELECT me.*, r.peak_rate, r.average_rate, ce.grid, ce.rendition, ce.clip, ce.first_segment, ce.start_ns, ce.total_ns, ce.gversion FROM me JOIN rate r USING (asset_id, track_id) JOIN ce USING (asset_id)),
gc AS (SELECT grid, rendition, string_agg(codec, ',' ORDER BY first, codec) AS codecs FROM (SELECT grid, rendition, codec, min(clip) AS first FROM gv WHERE kind = 'video' GROUP BY ALL) GROUP BY ALL),
va AS (SELECT grid, rendition, max(peak_rate) AS peak, (CASE WHEN sum(ms) > 0 THEN sum(average_rate::HUGEINT * ms) // sum(ms) ELSE 0 END)::BIGINT AS average, arg_max(width || 'x' || height, (width * height, -clip)) AS resolution, any_value(gversion) AS gversion
  FROM (SELECT *, ((end_time - first_time)::HUGEINT * 1000 // timescale)::BIGINT AS ms FROM gv WHERE kind = 'video') GROUP BY grid, rendition),
ga AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY grid, track_id) AS have, (SELECT max(clip) + 1 FROM ce c WHERE c.grid = gv.grid) AS clips FROM gv WHERE kind = 'audio' AND rendition = 0) WHERE have = clips),
gn AS (SELECT grid, track_id, track_key, row_number() OVER (PARTITION BY grid ORDER BY track_id) AS position, coalesce(arg_min(language, clip) FILTER (language IS NOT NULL), NULL) AS language, any_value(gversion) AS gversion FROM ga GROUP BY grid, track_id, track_key),
gk AS (SELECT grid, string_agg(codec, ',' ORDER BY first, codec) AS audio_codecs FROM (SELECT grid, codec, min(clip) AS first FROM ga JOIN gn USING (grid, track_id) WHERE position = 1 GROUP BY ALL) GROUP BY grid)"""


def _shared_audio(own: DataFrame) -> DataFrame:
    """The audio tracks of the first rendition that all its clips have."""
    a = own.where("kind = 'audio' and rendition = 0")
    clips = own.groupBy("grid").agg((F.max("clip") + 1).alias("clips"))
    whole = a.groupBy("grid", "track_id").agg(F.count(F.lit(1)).alias("have")).join(clips, "grid").where("have = clips").select("grid", "track_id")
    return a.join(whole, ["grid", "track_id"])


def _cells_of(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, plan, m, r = _prepared(spark, sf_dir)
    return s, plan, m.join(r, list(TRACK)).join(cells(plan, m), "asset_id")


@_query(_with(PLAN_SQL + MEDIA_SQL + CELLS_SQL + VARIANTS_SQL + """,
ln AS (SELECT DISTINCT grid, 0 AS part, 0 AS place, 0 AS tie, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' AS line FROM va
  UNION ALL SELECT grid, 1, position, 0, concat('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="audio",NAME="Audio ', position, coalesce(' (' || language || ')', ''), '"', coalesce(',LANGUAGE="' || language || '"', ''), ',DEFAULT=', CASE position WHEN 1 THEN 'YES' ELSE 'NO' END, ',AUTOSELECT=YES,URI="', track_key, '/index.m3u8?v=', gversion, '"') FROM gn
  UNION ALL SELECT grid, 2, peak, rendition, concat('#EXT-X-STREAM-INF:BANDWIDTH=', peak, ',AVERAGE-BANDWIDTH=', average, ',CODECS="', codecs, coalesce(',' || audio_codecs, ''), '",RESOLUTION=', resolution, CASE WHEN audio_codecs IS NOT NULL THEN ',AUDIO="audio"' ELSE '' END, chr(10), 'video-', rendition, '/index.m3u8?v=', gversion)
    FROM va JOIN gc USING (grid, rendition) LEFT JOIN gk USING (grid))""", "SELECT grid, string_agg(line, chr(10) ORDER BY part, place, tie) || chr(10) AS body FROM ln GROUP BY grid"))
def grid_master(spark, sf_dir: str) -> DataFrame:
    """One variant a rendition, for all its clips, by ascending peak; the first rendition's audio for all."""
    _, _, own = _cells_of(spark, sf_dir)
    v = variants(own.where("kind = 'video'"))
    audio = _shared_audio(own)
    named = audio.groupBy("grid", "track_id", "track_key", "gversion").agg(F.min_by("language", F.when(F.col("language").isNotNull(), F.col("clip"))).alias("language"))
    named = named.withColumn("position", F.row_number().over(Window.partitionBy("grid").orderBy("track_id")).cast("bigint"))
    first = _codecs(audio.join(named.where("position = 1").select("grid", "track_id"), ["grid", "track_id"]), ["grid"], "audio_codecs")
    media_line = _text(
        '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="audio",NAME="Audio ', F.col("position"), _optional(" (", F.col("language"), ")"), '"', _optional(',LANGUAGE="', F.col("language"), '"'), ",DEFAULT=", _yes(F.col("position") == 1),
        ',AUTOSELECT=YES,URI="', F.col("track_key"), "/index.m3u8?v=", F.col("gversion"), '"',
    )
    line = _text(
        "#EXT-X-STREAM-INF:BANDWIDTH=", F.col("peak"), ",AVERAGE-BANDWIDTH=", F.col("average"), ',CODECS="', F.col("codecs"), _optional(",", F.col("audio_codecs")), '",RESOLUTION=', F.col("resolution"),
        F.when(F.col("audio_codecs").isNotNull(), ',AUDIO="audio"').otherwise(""), "\nvideo-", F.col("rendition"), "/index.m3u8?v=", F.col("gversion"),
    )
    row = lambda df, part, place, tie, text: df.select("grid", F.lit(part).alias("part"), place.cast("bigint").alias("place"), tie.cast("bigint").alias("tie"), text.alias("line"))
    zero = F.lit(0)
    lines = (
        row(v.select("grid").distinct(), 0, zero, zero, F.lit("#EXTM3U\n#EXT-X-VERSION:7"))
        .unionByName(row(named, 1, F.col("position"), zero, media_line))
        .unionByName(row(v.join(first, "grid", "left"), 2, F.col("peak"), F.col("rendition"), line))
    )
    return _body(lines, ["grid"], ["part", "place", "tie"])


@_query(_with(PLAN_SQL + MEDIA_SQL + SEGMENT_LINES_SQL + CELLS_SQL + f""",
en AS (SELECT grid, rendition, clip, place + 1 AS part, {_ENTRY.format(n='first_segment + place').replace('version', 'gversion')} AS line FROM pl JOIN ce USING (asset_id) WHERE kind = 'video'
  UNION ALL SELECT grid, rendition, clip, 0, concat(CASE WHEN clip > 0 THEN '#EXT-X-DISCONTINUITY' || chr(10) ELSE '' END, '#EXT-X-MAP:URI="clips/', clip, '/init.mp4?v=', gversion, '"') FROM ce),
tt AS (SELECT grid, rendition, max(d) AS d FROM td JOIN ce USING (asset_id) WHERE track_id = 1 GROUP BY ALL)""",
    f"SELECT grid, rendition, concat({_HEADER}, chr(10), string_agg(line, chr(10) ORDER BY clip, part), chr(10), '#EXT-X-ENDLIST', chr(10)) AS body FROM en JOIN tt USING (grid, rendition) GROUP BY grid, rendition"))
def grid_media(spark, sf_dir: str) -> DataFrame:
    """The media playlist of each rendition's video over its clips."""
    s, plan, own = _cells_of(spark, sf_dir)
    video = own.where("kind = 'video'").withColumn("version", F.col("gversion"))
    entries = segment_lines(plan, video, F.col("first_segment")).join(video.select(*TRACK, "grid", "rendition", "clip"), list(TRACK)).select("grid", "rendition", "clip", (F.col("place") + 1).alias("part"), "line")
    line = _text(F.when(F.col("clip") > 0, "#EXT-X-DISCONTINUITY\n").otherwise(""), '#EXT-X-MAP:URI="clips/', F.col("clip"), "/init.mp4?v=", F.col("version"), '"')
    heads = video.select("grid", "rendition", "clip", F.lit(0).cast("bigint").alias("part"), line.alias("line"))
    target = target_durations(plan, tracks(s)).join(video.select(*TRACK, "grid", "rendition"), list(TRACK)).groupBy("grid", "rendition").agg(F.max("target_duration").alias("target"))
    body = _body(entries.unionByName(heads), ["grid", "rendition"], ["clip", "part"], name="lines").join(target, ["grid", "rendition"])
    return body.select("grid", "rendition", _text(_header(F.col("target")), "\n", F.col("lines"), "#EXT-X-ENDLIST\n").alias("body"))


@_query(_with(PLAN_SQL + MEDIA_SQL + SEGMENT_LINES_SQL + _TIMELINE_SQL + CELLS_SQL + VARIANTS_SQL + f""",
gt AS (SELECT gv.*, timeline FROM gv JOIN tl USING (asset_id, track_id)),
ln AS (SELECT DISTINCT grid, -1 AS clip, 0 AS part, 0 AS place, 0 AS tie, concat('{_OPEN}', {_SECONDS.format('(total_ns // 1000000)')}, '{_PROFILE}') AS line FROM ce
  UNION ALL SELECT DISTINCT grid, clip, 0, 0, 0, concat('  <Period id="clip-', clip, '" start="PT', {_SECONDS.format('(start_ns // 1000000)')}, 'S">', chr(10), '    <AdaptationSet contentType="video" segmentAlignment="true" startWithSAP="1">') FROM ce
  UNION ALL SELECT g.grid, g.clip, 1, va.peak, g.rendition, {_representation_sql("'video-' || g.rendition", "'clips/' || clip || '/init.mp4'", 'first_segment', "concat(' presentationTimeOffset=\"', (start_ns::HUGEINT * timescale // 1000000000)::BIGINT, '\"')", 'g.gversion')} FROM gt g JOIN va ON va.grid = g.grid AND va.rendition = g.rendition WHERE kind = 'video'
  UNION ALL SELECT DISTINCT grid, clip, 2, 0, 0, '{_CLOSE_SET}' FROM ce
  UNION ALL SELECT grid, clip, 3, track_id, 0, concat({_SET_SQL}, chr(10), {_representation_sql('track_key', "'clips/' || clip || '/init.mp4'", 'first_segment', "concat(' presentationTimeOffset=\"', (start_ns::HUGEINT * timescale // 1000000000)::BIGINT, '\"')", 'gversion')}, chr(10), '{_CLOSE_SET}') FROM gt WHERE kind = 'audio' AND rendition = 0 AND (grid, track_id) IN (SELECT grid, track_id FROM gn)
  UNION ALL SELECT DISTINCT grid, clip, 4, 0, 0, '  </Period>' FROM ce UNION ALL SELECT DISTINCT grid, 1000000000, 0, 0, 0, '</MPD>' FROM ce)""".replace(_OPEN, _OPEN.replace("\n", "' || chr(10) || '")),
    "SELECT grid, string_agg(line, chr(10) ORDER BY clip, part, place, tie) || chr(10) AS body FROM ln GROUP BY grid"))
def grid_manifest(spark, sf_dir: str) -> DataFrame:
    """A period a clip with every rendition in one set and the shared audio; ids stay the same from one period to the next."""
    _, plan, own = _cells_of(spark, sf_dir)
    timed = own.join(timelines(plan), list(TRACK)).withColumn("version", F.col("gversion"))
    peak = variants(own.where("kind = 'video'")).select("grid", "rendition", "peak")
    offset = rescale("start_ns", 1_000_000_000, "timescale")
    init = _text("clips/", F.col("clip"), "/init.mp4")
    video = timed.where("kind = 'video'").join(peak, ["grid", "rendition"])
    audio = timed.where("kind = 'audio' and rendition = 0").join(_shared_audio(own).select("grid", "track_id").distinct(), ["grid", "track_id"])
    audio_set = _text(set_head(), "\n", representations(audio, F.col("track_key"), init, F.col("first_segment"), offset), "\n", _CLOSE_SET)
    periods = own.select("grid", "clip", "start_ns").distinct()
    whole = own.select("grid", "total_ns").distinct()
    row = lambda df, clip, part, place, tie, line: df.select("grid", clip.cast("bigint").alias("clip"), F.lit(part).alias("part"), place.cast("bigint").alias("place"), tie.cast("bigint").alias("tie"), line.alias("line"))
    zero, at = F.lit(0), F.col("clip")
    head = _text('  <Period id="clip-', at, '" start="PT', _nanos("start_ns"), 'S">\n    <AdaptationSet contentType="video" segmentAlignment="true" startWithSAP="1">')
    lines = (
        row(whole, F.lit(-1), 0, zero, zero, _text(_OPEN, _nanos("total_ns"), _PROFILE))
        .unionByName(row(periods, at, 0, zero, zero, head))
        .unionByName(row(video, at, 1, F.col("peak"), F.col("rendition"), representations(video, _text("video-", F.col("rendition")), init, F.col("first_segment"), offset)))
        .unionByName(row(periods, at, 2, zero, zero, F.lit(_CLOSE_SET)))
        .unionByName(row(audio, at, 3, F.col("track_id"), zero, audio_set))
        .unionByName(row(periods, at, 4, zero, zero, F.lit("  </Period>")))
        .unionByName(row(whole, F.lit(1_000_000_000), 0, zero, zero, F.lit("</MPD>")))
    )
    return _body(lines, ["grid"], ["clip", "part", "place", "tie"])
