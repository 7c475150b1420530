"""HLS playlists in full, each with its SQL: masters, media playlists, sequences of clips and I-frames.

A line is a column, a playlist the lines of a key in order.  Assets whose ids agree modulo GROUPS are the
renditions of one adaptive asset, or, in order of id, the clips of one sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exact import ceil_div, rescale, seconds_text
from tickloom.operators.series import TRACK, keyframes
from tickloom.plans.catalog import KEY_SQL, PLAN_SQL, _with
from tickloom.plans.segments import rates, segment_plan, target_durations
from tickloom.sources.media import MEDIA_SQL, SUBTITLES_SQL, media, subtitles
from tickloom.sources.views import kept, samples, tracks

GROUPS = 10

Q: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _text(*parts) -> Column:
    """Strings and columns in one; a null column leaves out itself."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _optional(before: str, value: Column, after: str = "") -> Column:
    """Nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(before), value.cast("string"), F.lit(after)), F.lit(""))


def _body(df: DataFrame, keys: list[str], order: list, line: str = "line", name: str = "body") -> DataFrame:
    """(keys, body): the lines of each key in order, each ended."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.col(line).alias("_line"))))
    return df.groupBy(*keys).agg(F.concat(F.array_join(F.transform(rows, lambda r: r["_line"]), "\n"), F.lit("\n")).alias(name))


def _yes(c: Column) -> Column:
    return F.when(c, "YES").otherwise("NO")


def _prepared(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Samples, their plan, tracks with what their files say, and rates by track."""
    s = samples(spark, sf_dir, reuse=True)
    plan = kept(spark, sf_dir, "plan", lambda: segment_plan(s))
    return s, plan, media(kept(spark, sf_dir, "tracks", lambda: tracks(s))), kept(spark, sf_dir, "rates", lambda: rates(s, plan))


# --- lines of audio and caption renditions ---


def audio_lines(m: DataFrame, labelled: bool = False) -> DataFrame:
    """(asset_id, position, line): the audio tracks of an asset in file order.  labelled: a label takes the place of the made name."""
    position = F.row_number().over(Window.partitionBy("asset_id").orderBy("track_id")).cast("bigint")
    a = m.where("kind = 'audio'").withColumn("position", position)
    name = _text("Audio ", F.col("position"), _optional(" (", F.col("language"), ")"))
    name = F.coalesce(F.replace("label", F.lit('"'), F.lit("'")), name) if labelled else name
    line = _text(
        '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="audio",NAME="', name, '"', _optional(',LANGUAGE="', F.col("language"), '"'), ",DEFAULT=", _yes(F.col("position") == 1),
        ',AUTOSELECT=YES,URI="', F.col("track_key"), "/index.m3u8?v=", F.col("version"), '"',
    )
    return a.select("asset_id", "position", line.alias("line"))


_AUDIO = """SELECT asset_id, position, concat('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="audio",NAME="', {name}, '"', coalesce(',LANGUAGE="' || language || '"', ''), ',DEFAULT=', CASE position WHEN 1 THEN 'YES' ELSE 'NO' END,
  ',AUTOSELECT=YES,URI="', track_key, '/index.m3u8?v=', version, '"') AS line FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY track_id) AS position FROM me WHERE kind = 'audio')"""
_MADE = "concat('Audio ', position, coalesce(' (' || language || ')', ''))"
AUDIO_SQL = _AUDIO.format(name=_MADE)
LABELLED_SQL = _AUDIO.format(name=f"coalesce(replace(label, '\"', ''''), {_MADE})")


@_query(_with(PLAN_SQL + MEDIA_SQL, LABELLED_SQL))
def audio_rendition_lines(spark, sf_dir: str) -> DataFrame:
    return audio_lines(media(tracks(samples(spark, sf_dir))), labelled=True)


def subtitle_lines(m: DataFrame) -> DataFrame:
    """(asset_id, place, line) of the caption files of an asset."""
    version = m.groupBy("asset_id").agg(F.first("version").alias("version"))
    line = _text(
        '#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="subs",NAME="', F.replace("label", F.lit('"'), F.lit("'")), '",LANGUAGE="', F.col("language"), '",DEFAULT=', _yes(F.col("is_default")),
        ",AUTOSELECT=", _yes(F.col("is_default") | F.col("forced")), ",FORCED=", _yes(F.col("forced")), ',URI="subtitles/', F.col("language"), "/index.m3u8?v=", F.col("version"), '"',
    )
    # the files follow from the asset's own row: no join
    return subtitles(version.select("asset_id")).join(version, "asset_id").select("asset_id", "place", line.alias("line"))


SUB_LINES_SQL = """SELECT asset_id, place, concat('#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="subs",NAME="', replace(label, '"', ''''), '",LANGUAGE="', language, '",DEFAULT=', CASE WHEN is_default THEN 'YES' ELSE 'NO' END,
  ',AUTOSELECT=', CASE WHEN is_default OR forced THEN 'YES' ELSE 'NO' END, ',FORCED=', CASE WHEN forced THEN 'YES' ELSE 'NO' END, ',URI="subtitles/', language, '/index.m3u8?v=', left(sha256(asset_id::VARCHAR), 16), '"') AS line FROM su"""


@_query(_with(PLAN_SQL + MEDIA_SQL + SUBTITLES_SQL, SUB_LINES_SQL))
def subtitle_rendition_lines(spark, sf_dir: str) -> DataFrame:
    return subtitle_lines(media(tracks(samples(spark, sf_dir))))


# --- media playlists ---


def segment_lines(plan: DataFrame, m: DataFrame, first: Column | None = None) -> DataFrame:
    """(asset_id, track_id, place, line): two lines a segment; place counts a track's own segments, first is the number of its first one."""
    place = (F.row_number().over(Window.partitionBy(*TRACK).orderBy("segment_index")) - 1).cast("bigint")
    own = plan.withColumn("place", place).join(m, list(TRACK))
    number = F.col("place") + (F.lit(0) if first is None else first)
    line = _text("#EXTINF:", seconds_text(rescale("duration", "timescale", 1000)), ",\nsegments/", number, "/media.m4s?v=", F.col("version"))
    return own.select(*TRACK, "place", line.alias("line"))


def _header(target: Column, more: str = "#EXT-X-INDEPENDENT-SEGMENTS") -> Column:
    return _text("#EXTM3U\n#EXT-X-VERSION:7\n#EXT-X-TARGETDURATION:", target, "\n#EXT-X-MEDIA-SEQUENCE:0\n#EXT-X-PLAYLIST-TYPE:VOD\n", more)


_SECONDS = "printf('%d.%03d', ({0} // 1000)::BIGINT, ({0} % 1000)::BIGINT)"
_DURATION_MS = "(duration::HUGEINT * 1000 // timescale)"
SEGMENT_LINES_SQL = f""",
pl AS (SELECT p.*, row_number() OVER (PARTITION BY asset_id, track_id ORDER BY segment_index) - 1 AS place, timescale, version, kind, track_key FROM plan p JOIN me USING (asset_id, track_id)),
td AS (SELECT asset_id, track_id, greatest(max((duration + timescale - 1) // timescale), 1)::BIGINT AS d FROM pl GROUP BY ALL)"""
_ENTRY = f"concat('#EXTINF:', {_SECONDS.format(_DURATION_MS)}, ',', chr(10), 'segments/', {{n}}, '/media.m4s?v=', version)"
_HEAD = "concat('#EXTM3U', chr(10), '#EXT-X-VERSION:7', chr(10), '#EXT-X-TARGETDURATION:', {d}, chr(10), '#EXT-X-MEDIA-SEQUENCE:0', chr(10), '#EXT-X-PLAYLIST-TYPE:VOD', chr(10), '{more}')"
_HEADER = _HEAD.format(d="any_value(d)", more="#EXT-X-INDEPENDENT-SEGMENTS")

MEDIA_PLAYLIST_SQL = f"""SELECT asset_id, track_id, concat({_HEADER}, chr(10), '#EXT-X-MAP:URI="init.mp4?v=', any_value(version), '"', chr(10),
  string_agg({_ENTRY.format(n='place')}, chr(10) ORDER BY place), chr(10), '#EXT-X-ENDLIST', chr(10)) AS body FROM pl JOIN td USING (asset_id, track_id) GROUP BY asset_id, track_id"""


def media_playlists(s: DataFrame, plan: DataFrame, m: DataFrame) -> DataFrame:
    """(asset_id, track_id, body)"""
    lines = _body(segment_lines(plan, m), list(TRACK), ["place"], name="segments")
    own = lines.join(m, list(TRACK)).join(target_durations(plan, tracks(s)), list(TRACK))
    return own.select(*TRACK, _text(_header(F.col("target_duration")), '\n#EXT-X-MAP:URI="init.mp4?v=', F.col("version"), '"\n', F.col("segments"), "#EXT-X-ENDLIST\n").alias("body"))


@_query(_with(PLAN_SQL + MEDIA_SQL + SEGMENT_LINES_SQL, MEDIA_PLAYLIST_SQL))
def media_playlist(spark, sf_dir: str) -> DataFrame:
    """The media playlist of each track."""
    s, plan, m, _ = _prepared(spark, sf_dir)
    return media_playlists(s, plan, m)


@_query(_with(PLAN_SQL + MEDIA_SQL + SEGMENT_LINES_SQL, f"""SELECT asset_id, track_id, replace(body, '?v=' || left(sha256(asset_id::VARCHAR), 16), '?v=' || left(sha256(asset_id::VARCHAR), 16) || '&p=' || left(sha256('token ' || asset_id), 8)) AS body FROM ({MEDIA_PLAYLIST_SQL})"""))
def tokened_playlist(spark, sf_dir: str) -> DataFrame:
    """Every URI that carries the version carries the viewer's token, too."""
    version = F.concat(F.lit("?v="), F.left(F.sha2(F.col("asset_id").cast("string"), 256), F.lit(16)))
    token = F.left(F.sha2(F.concat(F.lit("token "), F.col("asset_id").cast("string")), 256), F.lit(8))
    return media_playlist(spark, sf_dir).select(*TRACK, F.replace("body", version, F.concat(version, F.lit("&p="), token)).alias("body"))


# --- I-frames ---


def iframe_rates(s: DataFrame) -> DataFrame:
    """(asset_id, iframe_peak, iframe_average) of video tracks; null where no keyframe lasts."""
    k = keyframes(s.where("track_id = 1")).withColumn("rate", F.when(F.col("interval") > 0, rescale(F.col("size") * 8, "interval", "timescale")))
    per = k.groupBy("asset_id", "timescale").agg(F.max("rate").alias("iframe_peak"), (F.sum("size") * 8).alias("bits"), F.sum("interval").alias("span"))
    return per.select("asset_id", "iframe_peak", F.when(F.col("span") > 0, rescale("bits", "span", "timescale")).alias("iframe_average"))


def iframe_line(key: Column) -> Column:
    """The stream line of a video track's I-frames, or null."""
    line = _text(
        "#EXT-X-I-FRAME-STREAM-INF:BANDWIDTH=", F.col("iframe_peak"), ",AVERAGE-BANDWIDTH=", F.col("iframe_average"), ',CODECS="', F.col("codec"), '"',
        ",RESOLUTION=", F.col("width"), "x", F.col("height"), ',URI="', key, "/iframes.m3u8?v=", F.col("version"), '"',
    )
    return F.when(F.col("iframe_peak").isNotNull() & F.col("iframe_average").isNotNull(), line)


IFRAME_SQL = f""",
kf AS ({KEY_SQL}),
ir AS (SELECT asset_id, max(CASE WHEN "interval" > 0 THEN (size * 8)::HUGEINT * timescale // "interval" END)::BIGINT AS ip, (CASE WHEN sum("interval") > 0 THEN (sum(size) * 8)::HUGEINT * any_value(timescale) // sum("interval") END)::BIGINT AS ia FROM kf WHERE track_id = 1 GROUP BY asset_id),
il AS (SELECT asset_id, '#EXT-X-I-FRAME-STREAM-INF:BANDWIDTH=' || ip || ',AVERAGE-BANDWIDTH=' || ia || ',CODECS="' || codec || '",RESOLUTION=' || width || 'x' || height || ',URI="' AS line FROM me JOIN ir USING (asset_id) WHERE track_id = 1)"""


@_query(_with(PLAN_SQL + MEDIA_SQL + f", kf AS ({KEY_SQL})", f"""SELECT asset_id, concat({_HEAD.format(d="greatest(max((k.interval + k.timescale - 1) // k.timescale), 0)", more='#EXT-X-I-FRAMES-ONLY')}, chr(10), '#EXT-X-MAP:URI="init.mp4?v=', any_value(version), '"', chr(10),
  string_agg(concat('#EXTINF:', {_SECONDS.format('(k.interval::HUGEINT * 1000 // k.timescale)')}, ',', chr(10), 'iframes/', nth, '/media.m4s?v=', version), chr(10) ORDER BY nth), chr(10), '#EXT-X-ENDLIST', chr(10)) AS body
  FROM kf k JOIN me USING (asset_id, track_id) WHERE track_id = 1 GROUP BY asset_id"""))
def iframe_playlist(spark, sf_dir: str) -> DataFrame:
    """One entry a keyframe, as long as it stands."""
    s = samples(spark, sf_dir, reuse=True)
    k = keyframes(s.where("track_id = 1")).join(media(tracks(s)).select(*TRACK, "version"), list(TRACK))
    line = _text("#EXTINF:", seconds_text(rescale("interval", "timescale", 1000)), ",\niframes/", F.col("nth"), "/media.m4s?v=", F.col("version"))
    rows = F.array_sort(F.collect_list(F.struct("nth", line.alias("line"))))
    per = k.groupBy("asset_id").agg(F.max(ceil_div("interval", "timescale")).alias("target"), F.first("version").alias("version"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("lines"))
    return per.select("asset_id", _text(_header(F.col("target"), "#EXT-X-I-FRAMES-ONLY"), '\n#EXT-X-MAP:URI="init.mp4?v=', F.col("version"), '"\n', F.col("lines"), "\n#EXT-X-ENDLIST\n").alias("body"))


# --- master playlists ---


def masters(m: DataFrame, track_rates: DataFrame, s: DataFrame, muxed: bool = False) -> DataFrame:
    """(asset_id, body).  muxed: the default audio is in the variant's own segments."""
    first_audio = F.min(F.when(F.col("kind") == "audio", F.col("track_id"))).over(Window.partitionBy("asset_id"))
    own = m.join(track_rates, list(TRACK)).withColumn("_a", first_audio)
    chosen = own.where((F.col("kind") == "video") | (F.col("track_id") == F.col("_a")))
    is_video = F.col("kind") == "video"
    variant = chosen.groupBy("asset_id").agg(
        F.sum("peak_rate").alias("peak"), F.sum("average_rate").alias("average"), F.first("version").alias("version"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("track_id", "codec"))), lambda x: x["codec"]), ",").alias("codecs"),
        F.max(F.when(is_video, F.concat_ws("x", "width", "height"))).alias("resolution"), F.max(is_video).alias("has_video"),
    ).join(m.groupBy("asset_id").agg(F.count_if(F.col("kind") == "audio").alias("n_audio")), "asset_id")
    mux = F.lit(muxed) & F.col("has_video") & (F.col("n_audio") > 0)
    group = F.when(mux, F.col("n_audio") > 1).otherwise((F.col("n_audio") > 0) & (F.col("has_video") | (F.col("n_audio") > 1)))
    variant = variant.withColumn("mux", mux).withColumn("grouped", group)

    audio = audio_lines(m).join(variant.select("asset_id", "mux", "grouped"), "asset_id").where("grouped")
    audio = audio.withColumn("line", F.when(F.col("mux") & (F.col("position") == 1), F.regexp_replace("line", ',URI="[^"]*"$', "")).otherwise(F.col("line")))
    subs = subtitle_lines(m)
    frames = m.where("kind = 'video'").join(iframe_rates(s), "asset_id").select("asset_id", iframe_line(F.col("track_key")).alias("line")).where("line is not null")
    has_subs = subs.select("asset_id").distinct().withColumn("has_subs", F.lit(True))
    first_key = m.where("kind = 'audio'").groupBy("asset_id").agg(F.min_by("track_key", "track_id").alias("first_key"))
    stream = variant.join(has_subs, "asset_id", "left").join(first_key, "asset_id", "left")
    entry = F.when(F.col("mux"), F.lit("muxed")).when(F.col("has_video"), F.lit("video")).otherwise(F.col("first_key"))
    line = _text(
        "#EXT-X-STREAM-INF:BANDWIDTH=", F.col("peak"), ",AVERAGE-BANDWIDTH=", F.col("average"), ',CODECS="', F.col("codecs"), '"', _optional(",RESOLUTION=", F.col("resolution")),
        F.when(F.col("grouped"), ',AUDIO="audio"').otherwise(""), F.when(F.col("has_subs"), ',SUBTITLES="subs"').otherwise(""), "\n", entry, "/index.m3u8?v=", F.col("version"),
    )
    zero = F.lit(0).cast("bigint")
    lines = (
        variant.select("asset_id", F.lit(0).alias("part"), zero.alias("place"), F.lit("#EXTM3U\n#EXT-X-VERSION:7").alias("line"))
        .unionByName(audio.select("asset_id", F.lit(1).alias("part"), F.col("position").alias("place"), "line"))
        .unionByName(subs.select("asset_id", F.lit(2).alias("part"), "place", "line"))
        .unionByName(frames.select("asset_id", F.lit(3).alias("part"), zero.alias("place"), "line"))
        .unionByName(stream.select("asset_id", F.lit(4).alias("part"), zero.alias("place"), line.alias("line")))
    )
    return _body(lines, ["asset_id"], ["part", "place"])


def _master_sql(muxed: bool) -> str:
    mux = "has_video AND n_audio > 0" if muxed else "false"
    line = "CASE WHEN mux AND position = 1 THEN regexp_replace(line, ',URI=\"[^\"]*\"$', '') ELSE line END"
    return f""",
ch AS (SELECT * FROM (SELECT *, min(track_id) FILTER (kind = 'audio') OVER (PARTITION BY asset_id) AS a, count(*) FILTER (kind = 'audio') OVER (PARTITION BY asset_id) AS n_audio, min(track_key) FILTER (track_id = 2 OR track_id = 3) OVER (PARTITION BY asset_id) AS first_key
  FROM me JOIN rate USING (asset_id, track_id)) WHERE kind = 'video' OR track_id = a),
va AS (SELECT *, CASE WHEN mux THEN n_audio > 1 ELSE n_audio > 0 AND (has_video OR n_audio > 1) END AS grouped FROM (SELECT *, {mux} AS mux FROM (SELECT asset_id, sum(peak_rate)::BIGINT AS peak, sum(average_rate)::BIGINT AS average, any_value(version) AS version,
  string_agg(codec, ',' ORDER BY track_id) AS codecs, max(width || 'x' || height) AS resolution, bool_or(kind = 'video') AS has_video, any_value(n_audio) AS n_audio, min(first_key) AS first_key FROM ch GROUP BY asset_id))),
ln AS (SELECT asset_id, 0 AS part, 0 AS place, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' AS line FROM va
  UNION ALL SELECT asset_id, 1, position, {line} FROM ({AUDIO_SQL}) JOIN va USING (asset_id) WHERE grouped
  UNION ALL SELECT asset_id, 2, place, line FROM ({SUB_LINES_SQL})
  UNION ALL SELECT asset_id, 3, 0, line || 'video/iframes.m3u8?v=' || left(sha256(asset_id::VARCHAR), 16) || '"' FROM il WHERE line IS NOT NULL
  UNION ALL SELECT asset_id, 4, 0, concat('#EXT-X-STREAM-INF:BANDWIDTH=', peak, ',AVERAGE-BANDWIDTH=', average, ',CODECS="', codecs, '"', coalesce(',RESOLUTION=' || resolution, ''), CASE WHEN grouped THEN ',AUDIO="audio"' ELSE '' END,
    CASE WHEN asset_id % 3 > 0 THEN ',SUBTITLES="subs"' ELSE '' END, chr(10), CASE WHEN mux THEN 'muxed' WHEN has_video THEN 'video' ELSE first_key END, '/index.m3u8?v=', version) FROM va)"""


_BODY_SQL = "SELECT asset_id, string_agg(line, chr(10) ORDER BY part, place) || chr(10) AS body FROM ln GROUP BY asset_id"


@_query(_with(PLAN_SQL + MEDIA_SQL + SUBTITLES_SQL + IFRAME_SQL + _master_sql(False), _BODY_SQL))
def master_playlist(spark, sf_dir: str) -> DataFrame:
    s, _, m, r = _prepared(spark, sf_dir)
    return masters(m, r, s)


@_query(_with(PLAN_SQL + MEDIA_SQL + SUBTITLES_SQL + IFRAME_SQL + _master_sql(True), _BODY_SQL))
def muxed_master_playlist(spark, sf_dir: str) -> DataFrame:
    """The default audio is in the video's segments, so its rendition has no URI of its own."""
    s, _, m, r = _prepared(spark, sf_dir)
    return masters(m, r, s, muxed=True)


@_query(_with(PLAN_SQL + MEDIA_SQL + IFRAME_SQL + f""",
g AS (SELECT *, asset_id % {GROUPS} AS ladder FROM me JOIN rate USING (asset_id, track_id)),
o AS (SELECT ladder, min(asset_id) AS owner FROM g WHERE kind = 'video' GROUP BY ladder),
au AS (SELECT ladder, position, l.line FROM ({LABELLED_SQL}) l JOIN o ON l.asset_id = o.owner),
ac AS (SELECT ladder, arg_min(codec, track_id) AS codec FROM g JOIN o USING (ladder) WHERE asset_id = owner AND kind = 'audio' GROUP BY ladder),
lo AS (SELECT ladder, arg_min(asset_id, (peak_rate, asset_id)) AS low FROM g WHERE kind = 'video' GROUP BY ladder),
ln AS (SELECT ladder, 0 AS part, 0 AS place, 0 AS tie, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' AS line FROM o UNION ALL SELECT ladder, 1, position, 0, line FROM au
  UNION ALL SELECT ladder, 2, 0, 0, line || 'video-' || low || '/iframes.m3u8?v=' || left(sha256(low::VARCHAR), 16) || '"' FROM il JOIN lo ON asset_id = low WHERE line IS NOT NULL
  UNION ALL SELECT g.ladder, 3, peak_rate, asset_id, concat('#EXT-X-STREAM-INF:BANDWIDTH=', peak_rate, ',AVERAGE-BANDWIDTH=', average_rate, ',CODECS="', g.codec, coalesce(',' || ac.codec, ''), '",RESOLUTION=', width, 'x', height,
    CASE WHEN ac.codec IS NOT NULL THEN ',AUDIO="audio"' ELSE '' END, chr(10), 'video-', asset_id, '/index.m3u8?v=', version) FROM g LEFT JOIN ac USING (ladder) WHERE kind = 'video')""",
    "SELECT ladder, string_agg(line, chr(10) ORDER BY part, place, tie) || chr(10) AS body FROM ln GROUP BY ladder"))
def adaptive_master(spark, sf_dir: str) -> DataFrame:
    """One variant a rendition, by ascending peak; the first rendition's audio for all; I-frames of the rendition with the least peak."""
    s, _, m, r = _prepared(spark, sf_dir)
    own = m.join(r, list(TRACK)).withColumn("ladder", F.col("asset_id") % GROUPS)
    video = own.where("kind = 'video'")
    owner = video.groupBy("ladder").agg(F.min("asset_id").alias("asset_id"), F.min_by("asset_id", F.struct("peak_rate", "asset_id")).alias("low"))
    audio = audio_lines(m, labelled=True).join(owner, "asset_id")
    first_codec = own.where("kind = 'audio'").join(owner.select("ladder", "asset_id"), ["ladder", "asset_id"]).groupBy("ladder").agg(F.min_by("codec", "track_id").alias("audio_codec"))
    frames = video.join(owner.select("ladder", "low"), "ladder").where("asset_id = low").join(iframe_rates(s), "asset_id")
    frames = frames.select("ladder", iframe_line(_text("video-", F.col("asset_id"))).alias("line")).where("line is not null")
    stream = video.join(first_codec, "ladder", "left")
    line = _text(
        "#EXT-X-STREAM-INF:BANDWIDTH=", F.col("peak_rate"), ",AVERAGE-BANDWIDTH=", F.col("average_rate"), ',CODECS="', F.col("codec"), _optional(",", F.col("audio_codec")), '",RESOLUTION=', F.col("width"), "x", F.col("height"),
        F.when(F.col("audio_codec").isNotNull(), ',AUDIO="audio"').otherwise(""), "\nvideo-", F.col("asset_id"), "/index.m3u8?v=", F.col("version"),
    )
    zero = F.lit(0).cast("bigint")
    lines = (
        owner.select("ladder", F.lit(0).alias("part"), zero.alias("place"), zero.alias("tie"), F.lit("#EXTM3U\n#EXT-X-VERSION:7").alias("line"))
        .unionByName(audio.select("ladder", F.lit(1).alias("part"), F.col("position").alias("place"), zero.alias("tie"), "line"))
        .unionByName(frames.select("ladder", F.lit(2).alias("part"), zero.alias("place"), zero.alias("tie"), "line"))
        .unionByName(stream.select("ladder", F.lit(3).alias("part"), F.col("peak_rate").alias("place"), F.col("asset_id").alias("tie"), line.alias("line")))
    )
    return _body(lines, ["ladder"], ["part", "place", "tie"])


# --- sequences of clips ---


def clip_places(plan: DataFrame, m: DataFrame) -> DataFrame:
    """(sequence, asset_id, clip, first_segment): the clips of each sequence, with the number of their first segment."""
    w = Window.partitionBy("sequence").orderBy("asset_id")
    n = plan.groupBy("asset_id").agg((F.max("segment_index") + 1).alias("segments")).withColumn("sequence", F.col("asset_id") % GROUPS)
    return n.select("sequence", "asset_id", (F.row_number().over(w) - 1).cast("bigint").alias("clip"), F.coalesce(F.sum("segments").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")).alias("first_segment"))


CLIPS_SQL = f""",
cp AS (SELECT asset_id % {GROUPS} AS sequence, asset_id, row_number() OVER w - 1 AS clip, coalesce(sum(segments) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_segment
  FROM (SELECT asset_id, max(segment_index) + 1 AS segments FROM plan GROUP BY asset_id) WINDOW w AS (PARTITION BY asset_id % {GROUPS} ORDER BY asset_id)),
sv AS (SELECT sequence, left(sha256('sequence ' || sequence), 16) AS sversion FROM (SELECT DISTINCT sequence FROM cp))"""


def _sequence_version() -> Column:
    return F.left(F.sha2(F.concat(F.lit("sequence "), F.col("sequence").cast("string")), 256), F.lit(16))


@_query(_with(PLAN_SQL + MEDIA_SQL + SEGMENT_LINES_SQL + CLIPS_SQL + f""",
en AS (SELECT sequence, track_key, clip, place + 1 AS part, {_ENTRY.format(n='first_segment + place').replace('version', 'sversion')} AS line FROM pl JOIN cp USING (asset_id) JOIN sv USING (sequence)),
hd AS (SELECT DISTINCT sequence, track_key, clip, 0 AS part, concat(CASE WHEN clip > min(clip) OVER (PARTITION BY sequence, track_key) THEN '#EXT-X-DISCONTINUITY' || chr(10) ELSE '' END, '#EXT-X-MAP:URI="clips/', clip, '/init.mp4?v=', sversion, '"') AS line FROM pl JOIN cp USING (asset_id) JOIN sv USING (sequence)),
tt AS (SELECT sequence, track_key, max(d) AS d FROM td JOIN me USING (asset_id, track_id) JOIN cp USING (asset_id) GROUP BY ALL)""",
    f"""SELECT sequence, track_key, concat({_HEADER}, chr(10), string_agg(line, chr(10) ORDER BY clip, part), chr(10), '#EXT-X-ENDLIST', chr(10)) AS body
  FROM (SELECT * FROM en UNION ALL SELECT * FROM hd) JOIN tt USING (sequence, track_key) GROUP BY sequence, track_key"""))
def sequence_media(spark, sf_dir: str) -> DataFrame:
    """One track's playlist over all clips that have it: a map a clip, a discontinuity between two, numbers that go on."""
    s, plan, m, _ = _prepared(spark, sf_dir)
    clips = clip_places(plan, m)
    own = m.join(clips, "asset_id").withColumn("version", _sequence_version())
    entries = segment_lines(plan, own, F.col("first_segment")).join(own.select(*TRACK, "sequence", "clip", "track_key"), list(TRACK)).select("sequence", "track_key", "clip", (F.col("place") + 1).alias("part"), "line")
    with_segments = plan.select(*TRACK).distinct()
    later = F.col("clip") > F.min("clip").over(Window.partitionBy("sequence", "track_key"))
    line = _text(F.when(later, "#EXT-X-DISCONTINUITY\n").otherwise(""), '#EXT-X-MAP:URI="clips/', F.col("clip"), "/init.mp4?v=", F.col("version"), '"')
    heads = own.join(with_segments, list(TRACK), "left_semi").select("sequence", "track_key", "clip", F.lit(0).cast("bigint").alias("part"), line.alias("line"))
    target = target_durations(plan, tracks(s)).join(own, list(TRACK)).groupBy("sequence", "track_key").agg(F.max("target_duration").alias("target"))
    body = _body(entries.unionByName(heads), ["sequence", "track_key"], ["clip", "part"], name="lines").join(target, ["sequence", "track_key"])
    return body.select("sequence", "track_key", _text(_header(F.col("target")), "\n", F.col("lines"), "#EXT-X-ENDLIST\n").alias("body"))


@_query(_with(PLAN_SQL + MEDIA_SQL + CLIPS_SQL + f""",
tk AS (SELECT * FROM (SELECT me.*, r.average_rate, r.peak_rate, c.sequence, c.clip, min(track_id) FILTER (kind = 'audio') OVER (PARTITION BY asset_id) AS a FROM me JOIN rate r USING (asset_id, track_id) JOIN cp c USING (asset_id)) WHERE kind = 'video' OR track_id = a),
cl AS (SELECT sequence, clip, sum(peak_rate)::BIGINT AS peak, sum(average_rate)::BIGINT AS average, (arg_min((end_time - first_time)::HUGEINT * 1000 // timescale, track_id))::BIGINT AS ms, max(CASE WHEN kind = 'video' THEN width END) AS width, max(CASE WHEN kind = 'video' THEN height END) AS height FROM tk GROUP BY sequence, clip),
co AS (SELECT sequence, string_agg(codec, ',' ORDER BY kind = 'audio', first) AS codecs FROM (SELECT sequence, kind, codec, min(clip) AS first FROM tk GROUP BY ALL) GROUP BY sequence),
va AS (SELECT sequence, max(peak) AS peak, (CASE WHEN sum(ms) > 0 THEN sum(average::HUGEINT * ms) // sum(ms) ELSE 0 END)::BIGINT AS average, arg_max(width || 'x' || height, (width * height, -clip)) AS resolution FROM cl GROUP BY sequence),
f AS (SELECT sequence, bool_or(kind = 'video') AS has_video, count(*) FILTER (kind = 'audio') AS n_audio, min(track_key) FILTER (kind = 'audio') AS first_key FROM me JOIN cp USING (asset_id) WHERE clip = 0 GROUP BY sequence),
au AS (SELECT sequence, row_number() OVER (PARTITION BY sequence ORDER BY track_key) AS position, track_key, language FROM (SELECT sequence, track_key, arg_min(language, clip) FILTER (language IS NOT NULL) AS language, min(clip) AS c FROM me JOIN cp USING (asset_id) WHERE kind = 'audio' GROUP BY ALL) WHERE c = 0),
ln AS (SELECT sequence, 0 AS part, 0 AS place, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' AS line FROM va
  UNION ALL SELECT sequence, 1, position, concat('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="audio",NAME="', {_MADE}, '"', coalesce(',LANGUAGE="' || language || '"', ''), ',DEFAULT=', CASE position WHEN 1 THEN 'YES' ELSE 'NO' END, ',AUTOSELECT=YES,URI="', track_key, '/index.m3u8?v=', sversion, '"')
    FROM au JOIN f USING (sequence) JOIN sv USING (sequence) WHERE has_video OR n_audio > 1
  UNION ALL SELECT sequence, 2, 0, concat('#EXT-X-STREAM-INF:BANDWIDTH=', peak, ',AVERAGE-BANDWIDTH=', average, ',CODECS="', codecs, '"', coalesce(',RESOLUTION=' || resolution, ''), CASE WHEN n_audio > 0 AND (has_video OR n_audio > 1) THEN ',AUDIO="audio"' ELSE '' END, chr(10),
    CASE WHEN has_video THEN 'video' ELSE first_key END, '/index.m3u8?v=', sversion) FROM va JOIN co USING (sequence) JOIN f USING (sequence) JOIN sv USING (sequence))""",
    "SELECT sequence, string_agg(line, chr(10) ORDER BY part, place) || chr(10) AS body FROM ln GROUP BY sequence"))
def sequence_master(spark, sf_dir: str) -> DataFrame:
    """One variant for all clips: the highest peak, the average by length, every codec once, the largest picture; audio is named by the first clip that knows its language."""
    _, plan, m, r = _prepared(spark, sf_dir)
    own = m.join(clip_places(plan, m), "asset_id").join(r, list(TRACK)).withColumn("a", F.min(F.when(F.col("kind") == "audio", F.col("track_id"))).over(Window.partitionBy("asset_id")))
    used = own.where((F.col("kind") == "video") | (F.col("track_id") == F.col("a")))
    ms = rescale(F.col("end_time") - F.col("first_time"), "timescale", 1000)
    per = used.groupBy("sequence", "clip").agg(F.sum("peak_rate").alias("peak"), F.sum("average_rate").alias("average"), F.min_by(ms, "track_id").alias("ms"), F.max("width").alias("width"), F.max("height").alias("height"))
    weighted, total = F.sum(F.col("average").cast("decimal(20,0)") * F.col("ms").cast("decimal(18,0)")), F.sum("ms")
    best = F.max_by(F.concat_ws("x", "width", "height"), F.when(F.col("width").isNotNull(), F.struct(F.col("width") * F.col("height"), -F.col("clip"))))
    variant = per.groupBy("sequence").agg(F.max("peak").alias("peak"), weighted.alias("_w"), total.alias("_t"), best.alias("resolution"))
    w, t = F.col("_w"), F.col("_t").cast("decimal(20,0)")
    average = F.when(F.col("_t") > 0, ((w - w % t) / t).cast("decimal(38,0)").cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    firsts = used.groupBy("sequence", "kind", "codec").agg(F.min("clip").alias("first"))
    codecs = firsts.groupBy("sequence").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("kind") == "audio").alias("late"), "first", "codec"))), lambda x: x["codec"]), ",").alias("codecs"))
    first_clip = own.where("clip = 0").groupBy("sequence").agg(F.max(F.col("kind") == "video").alias("has_video"), F.count_if(F.col("kind") == "audio").alias("n_audio"), F.min(F.when(F.col("kind") == "audio", F.col("track_key"))).alias("first_key"))
    named = own.where("kind = 'audio'").groupBy("sequence", "track_key").agg(F.min_by("language", F.when(F.col("language").isNotNull(), F.col("clip"))).alias("language"), F.min("clip").alias("c")).where("c = 0")
    named = named.withColumn("position", F.row_number().over(Window.partitionBy("sequence").orderBy("track_key")).cast("bigint")).join(first_clip, "sequence").where("has_video or n_audio > 1")
    audio_line = _text(
        '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="audio",NAME="Audio ', F.col("position"), _optional(" (", F.col("language"), ")"), '"', _optional(',LANGUAGE="', F.col("language"), '"'), ",DEFAULT=", _yes(F.col("position") == 1),
        ',AUTOSELECT=YES,URI="', F.col("track_key"), "/index.m3u8?v=", _sequence_version(), '"',
    )
    grouped = (F.col("n_audio") > 0) & (F.col("has_video") | (F.col("n_audio") > 1))
    line = _text(
        "#EXT-X-STREAM-INF:BANDWIDTH=", F.col("peak"), ",AVERAGE-BANDWIDTH=", average, ',CODECS="', F.col("codecs"), '"', _optional(",RESOLUTION=", F.col("resolution")), F.when(grouped, ',AUDIO="audio"').otherwise(""), "\n",
        F.when(F.col("has_video"), F.lit("video")).otherwise(F.col("first_key")), "/index.m3u8?v=", _sequence_version(),
    )
    zero = F.lit(0).cast("bigint")
    lines = (
        variant.select("sequence", F.lit(0).alias("part"), zero.alias("place"), F.lit("#EXTM3U\n#EXT-X-VERSION:7").alias("line"))
        .unionByName(named.select("sequence", F.lit(1).alias("part"), F.col("position").alias("place"), audio_line.alias("line")))
        .unionByName(variant.join(codecs, "sequence").join(first_clip, "sequence").select("sequence", F.lit(2).alias("part"), zero.alias("place"), line.alias("line")))
    )
    return _body(lines, ["sequence"], ["part", "place"])
