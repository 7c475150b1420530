"""DASH manifests, and the lines and elements that name content keys, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exact import rescale, seconds_text
from tickloom.operators.series import TRACK
from tickloom.plans.catalog import PLAN_SQL, _with
from tickloom.plans.playlists import CLIPS_SQL, GROUPS, SEGMENT_LINES_SQL, _body, _optional, _prepared, _text, clip_places
from tickloom.sources.media import MEDIA_SQL, SUBTITLES_SQL, subtitles
from tickloom.sources.views import table

Q: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# fixed values: the formats' namespaces and schemes
_OPEN = '<?xml version="1.0" encoding="UTF-8"?>\n<MPD xmlns="urn:mpeg:dash:schema:mpd:2011" type="static" mediaPresentationDuration="PT'
_PROFILE = 'S" minBufferTime="PT1.5S" profiles="urn:mpeg:dash:profile:isoff-main:2011">'
_CHANNELS = '        <AudioChannelConfiguration schemeIdUri="urn:mpeg:dash:23003:3:audio_channel_configuration:2011" value="'
_ROLE = '        <Role schemeIdUri="urn:mpeg:dash:role:2011" value="'
_CLOSE_REPRESENTATION, _CLOSE_SET = "      </Representation>", "    </AdaptationSet>"


def timelines(plan: DataFrame) -> DataFrame:
    """(asset_id, track_id, timeline): an S element a segment; the first one says when it starts."""
    first = F.row_number().over(Window.partitionBy(*TRACK).orderBy("segment_index")) == 1
    line = _text("            <S", F.when(first, _text(' t="', F.col("decode_time"), '"')), ' d="', F.col("duration"), '" />')
    return _body(plan.withColumn("line", line), list(TRACK), ["segment_index"], name="timeline")


def representations(own: DataFrame, key: Column, init: Column, start: Column, offset: Column) -> Column:
    """A Representation element of a track with its timeline; own has media, peak_rate and timeline columns."""
    video = F.col("kind") == "video"
    head = F.when(
        video, _text('" mimeType="video/mp4" width="', F.col("width"), '" height="', F.col("height"), '">')
    ).otherwise(_text('" mimeType="audio/mp4" audioSamplingRate="', F.col("rate"), '">\n', _CHANNELS, F.col("channels"), '" />'))
    return _text(
        '      <Representation id="', key, '" bandwidth="', F.col("peak_rate"), '" codecs="', F.col("codec"), head,
        '\n        <SegmentTemplate timescale="', F.col("timescale"), '"', _optional(' presentationTimeOffset="', offset, '"'), ' startNumber="', start, '" initialization="$RepresentationID$/', init, "?v=", F.col("version"),
        '" media="$RepresentationID$/segments/$Number$/media.m4s?v=', F.col("version"), '">\n          <SegmentTimeline>\n', F.col("timeline"), "          </SegmentTimeline>\n        </SegmentTemplate>\n", _CLOSE_REPRESENTATION,
    )


def set_head() -> Column:
    """What opens the AdaptationSet of a track."""
    audio = _text('    <AdaptationSet contentType="audio"', _optional(' lang="', F.col("language"), '"'), ' segmentAlignment="true">', _optional("\n      <Label>", F.replace(F.replace(F.replace(F.replace("label", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), "</Label>"))
    return F.when(F.col("kind") == "video", F.lit('    <AdaptationSet contentType="video" segmentAlignment="true" startWithSAP="1">')).otherwise(audio)


_TIMELINE_SQL = """,
tl AS (SELECT asset_id, track_id, string_agg(concat('            <S', CASE place WHEN 0 THEN concat(' t="', decode_time, '"') ELSE '' END, ' d="', duration, '" />'), chr(10) ORDER BY place) || chr(10) AS timeline FROM pl GROUP BY asset_id, track_id)"""


def _representation_sql(key: str, init: str, start: str, offset: str, version: str = "version") -> str:
    return f"""concat('      <Representation id="', {key}, '" bandwidth="', peak_rate, '" codecs="', codec, CASE kind WHEN 'video' THEN concat('" mimeType="video/mp4" width="', width, '" height="', height, '">')
    ELSE concat('" mimeType="audio/mp4" audioSamplingRate="', rate, '">', chr(10), '{_CHANNELS}', channels, '" />') END, chr(10), '        <SegmentTemplate timescale="', timescale, '"', {offset}, ' startNumber="', {start}, '" initialization="$RepresentationID$/', {init}, '?v=', {version},
    '" media="$RepresentationID$/segments/$Number$/media.m4s?v=', {version}, '">', chr(10), '          <SegmentTimeline>', chr(10), timeline, '          </SegmentTimeline>', chr(10), '        </SegmentTemplate>', chr(10), '{_CLOSE_REPRESENTATION}')"""


_SET_SQL = """CASE kind WHEN 'video' THEN '    <AdaptationSet contentType="video" segmentAlignment="true" startWithSAP="1">'
    ELSE concat('    <AdaptationSet contentType="audio"', coalesce(' lang="' || language || '"', ''), ' segmentAlignment="true">', coalesce(chr(10) || '      <Label>' || replace(replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</Label>', '')) END"""
_SECONDS = "printf('%d.%03d', ({0} // 1000)::BIGINT, ({0} % 1000)::BIGINT)"
_SUB_SET_SQL = f"""concat('    <AdaptationSet contentType="text" lang="', language, '" mimeType="text/vtt">', chr(10), '{_ROLE}', CASE WHEN forced THEN 'forced-subtitle' ELSE 'subtitle' END, '" />', chr(10), CASE WHEN is_default THEN '{_ROLE}main" />' || chr(10) ELSE '' END,
    '      <Representation id="subtitles-', language, '" bandwidth="256">', chr(10), '        <BaseURL>subtitles/', language, '/sub.vtt?v=', left(sha256(asset_id::VARCHAR), 16), '</BaseURL>', chr(10), '{_CLOSE_REPRESENTATION}', chr(10), '{_CLOSE_SET}')"""


def subtitle_sets(m: DataFrame) -> DataFrame:
    """(asset_id, place, line): a text AdaptationSet a caption file."""
    version = m.groupBy("asset_id").agg(F.first("version").alias("version"))
    role = _text(_ROLE, F.when(F.col("forced"), "forced-subtitle").otherwise("subtitle"), '" />\n', F.when(F.col("is_default"), _ROLE + 'main" />\n').otherwise(""))
    line = _text(
        '    <AdaptationSet contentType="text" lang="', F.col("language"), '" mimeType="text/vtt">\n', role, '      <Representation id="subtitles-', F.col("language"), '" bandwidth="256">\n        <BaseURL>subtitles/', F.col("language"),
        "/sub.vtt?v=", F.col("version"), "</BaseURL>\n", _CLOSE_REPRESENTATION, "\n", _CLOSE_SET,
    )
    return subtitles(version.select("asset_id")).join(version, "asset_id").select("asset_id", "place", line.alias("line"))


@_query(_with(PLAN_SQL + MEDIA_SQL + SUBTITLES_SQL + SEGMENT_LINES_SQL + _TIMELINE_SQL + f""",
ow AS (SELECT me.*, peak_rate, timeline FROM me JOIN rate USING (asset_id, track_id) JOIN tl USING (asset_id, track_id)),
du AS (SELECT asset_id, max((end_time - first_time)::HUGEINT * 1000 // timescale)::BIGINT AS ms FROM tr GROUP BY asset_id),
ln AS (SELECT asset_id, 0 AS part, 0 AS place, concat('{_OPEN}', {_SECONDS.format('ms')}, '{_PROFILE}', chr(10), '  <Period start="PT0S">') AS line FROM du
  UNION ALL SELECT asset_id, 1, track_id, concat({_SET_SQL}, chr(10), {_representation_sql('track_key', "'init.mp4'", '0', "''")}, chr(10), '{_CLOSE_SET}') FROM ow
  UNION ALL SELECT asset_id, 2, place, {_SUB_SET_SQL} FROM su UNION ALL SELECT asset_id, 3, 0, '  </Period>' || chr(10) || '</MPD>' FROM du)""".replace(_OPEN, _OPEN.replace("\n", "' || chr(10) || '")),
    "SELECT asset_id, string_agg(line, chr(10) ORDER BY part, place) || chr(10) AS body FROM ln GROUP BY asset_id"))
def dash_manifest(spark, sf_dir: str) -> DataFrame:
    """One period with a set a track, and a set a caption file."""
    _, plan, m, r = _prepared(spark, sf_dir)
    own = m.join(r, list(TRACK)).join(timelines(plan), list(TRACK))
    none = F.lit(None).cast("string")
    sets = _text(set_head(), "\n", representations(own, F.col("track_key"), F.lit("init.mp4"), F.lit(0), none), "\n", _CLOSE_SET)
    lasts = m.groupBy("asset_id").agg(F.max(rescale(F.col("end_time") - F.col("first_time"), "timescale", 1000)).alias("ms"))
    zero = F.lit(0).cast("bigint")
    lines = (
        lasts.select("asset_id", F.lit(0).alias("part"), zero.alias("place"), _text(_OPEN, seconds_text(F.col("ms")), _PROFILE, '\n  <Period start="PT0S">').alias("line"))
        .unionByName(own.select("asset_id", F.lit(1).alias("part"), F.col("track_id").alias("place"), sets.alias("line")))
        .unionByName(subtitle_sets(m).select("asset_id", F.lit(2).alias("part"), "place", "line"))
        .unionByName(lasts.select("asset_id", F.lit(3).alias("part"), zero.alias("place"), F.lit("  </Period>\n</MPD>").alias("line")))
    )
    return _body(lines, ["asset_id"], ["part", "place"])


_STARTS_SQL = """,
cs AS (SELECT sequence, asset_id, clip, first_segment, coalesce(sum(ns) OVER (PARTITION BY sequence ORDER BY clip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ns, sum(ns) OVER (PARTITION BY sequence)::BIGINT AS total_ns
  FROM cp JOIN (SELECT asset_id, arg_min((end_time - first_time)::HUGEINT * 1000000000 // timescale, track_id)::BIGINT AS ns FROM tr GROUP BY asset_id) USING (asset_id))"""


def clip_timeline(clips: DataFrame, m: DataFrame) -> DataFrame:
    """clips with start_ns and total_ns: a clip is as long as its first track."""
    length = m.groupBy("asset_id").agg(F.min_by(rescale(F.col("end_time") - F.col("first_time"), "timescale", 1_000_000_000), "track_id").alias("ns"))
    w = Window.partitionBy("sequence").orderBy("clip").rowsBetween(Window.unboundedPreceding, -1)
    return clips.join(length, "asset_id").withColumn("start_ns", F.coalesce(F.sum("ns").over(w), F.lit(0).cast("bigint"))).withColumn("total_ns", F.sum("ns").over(Window.partitionBy("sequence"))).drop("ns")


def _nanos(c: str) -> Column:
    return seconds_text(F.expr(f"{c} div 1000000"))


@_query(_with(PLAN_SQL + MEDIA_SQL + SEGMENT_LINES_SQL + _TIMELINE_SQL + CLIPS_SQL + _STARTS_SQL + f""",
ow AS (SELECT me.*, peak_rate, timeline, sequence, clip, first_segment, start_ns, sversion FROM me JOIN rate USING (asset_id, track_id) JOIN tl USING (asset_id, track_id) JOIN cs USING (asset_id) JOIN sv USING (sequence)),
se AS (SELECT DISTINCT sequence, total_ns // 1000000 AS ms FROM cs),
ln AS (SELECT sequence, -1 AS clip, 0 AS part, concat('{_OPEN}', {_SECONDS.format('ms')}, '{_PROFILE}') AS line FROM se
  UNION ALL SELECT sequence, clip, 0, concat('  <Period id="clip-', clip, '" start="PT', {_SECONDS.format('(start_ns // 1000000)')}, 'S">') FROM cs
  UNION ALL SELECT sequence, clip, track_id, concat({_SET_SQL}, chr(10), {_representation_sql('track_key', "'clips/' || clip || '/init.mp4'", 'first_segment', "concat(' presentationTimeOffset=\"', (start_ns::HUGEINT * timescale // 1000000000)::BIGINT, '\"')", 'sversion')}, chr(10), '{_CLOSE_SET}') FROM ow
  UNION ALL SELECT sequence, clip, 1000, '  </Period>' FROM cs UNION ALL SELECT sequence, 1000000000, 0, '</MPD>' FROM se)""".replace(_OPEN, _OPEN.replace("\n", "' || chr(10) || '")),
    "SELECT sequence, string_agg(line, chr(10) ORDER BY clip, part) || chr(10) AS body FROM ln GROUP BY sequence"))
def sequence_manifest(spark, sf_dir: str) -> DataFrame:
    """A period a clip, which starts where the one before ends; numbers and media times go on."""
    _, plan, m, r = _prepared(spark, sf_dir)
    clips = clip_timeline(clip_places(plan, m), m)
    version = F.left(F.sha2(F.concat(F.lit("sequence "), F.col("sequence").cast("string")), 256), F.lit(16))
    own = m.join(r, list(TRACK)).join(timelines(plan), list(TRACK)).join(clips, "asset_id").withColumn("version", version)
    offset = rescale("start_ns", 1_000_000_000, "timescale")
    sets = _text(set_head(), "\n", representations(own, F.col("track_key"), _text("clips/", F.col("clip"), "/init.mp4"), F.col("first_segment"), offset), "\n", _CLOSE_SET)
    whole = clips.select("sequence", "total_ns").distinct()
    row = lambda df, clip, part, line: df.select("sequence", clip.cast("bigint").alias("clip"), part.cast("bigint").alias("part"), line.alias("line"))
    lines = (
        row(whole, F.lit(-1), F.lit(0), _text(_OPEN, _nanos("total_ns"), _PROFILE))
        .unionByName(row(clips, F.col("clip"), F.lit(0), _text('  <Period id="clip-', F.col("clip"), '" start="PT', _nanos("start_ns"), 'S">')))
        .unionByName(row(own, F.col("clip"), F.col("track_id"), sets))
        .unionByName(row(clips, F.col("clip"), F.lit(1000), F.lit("  </Period>")))
        .unionByName(row(whole, F.lit(1_000_000_000), F.lit(0), F.lit("</MPD>")))
    )
    return _body(lines, ["sequence"], ["clip", "part"])


@_query(_with(PLAN_SQL + MEDIA_SQL + SEGMENT_LINES_SQL + _TIMELINE_SQL + f""",
ow AS (SELECT me.*, peak_rate, timeline, asset_id % {GROUPS} AS ladder FROM me JOIN rate USING (asset_id, track_id) JOIN tl USING (asset_id, track_id)),
fi AS (SELECT ladder, min(asset_id) AS owner, max((end_time - first_time)::HUGEINT * 1000 // timescale)::BIGINT AS ms FROM ow WHERE kind = 'video' GROUP BY ladder),
ln AS (SELECT ladder, 0 AS part, 0 AS place, 0 AS tie, concat('{_OPEN}', {_SECONDS.format('ms')}, '{_PROFILE}', chr(10), '  <Period start="PT0S">', chr(10), '    <AdaptationSet contentType="video" segmentAlignment="true" startWithSAP="1">') AS line FROM fi
  UNION ALL SELECT ladder, 1, peak_rate, asset_id, {_representation_sql("'video-' || asset_id", "'init.mp4'", '0', "''")} FROM ow WHERE kind = 'video'
  UNION ALL SELECT ladder, 2, 0, 0, '{_CLOSE_SET}' FROM fi
  UNION ALL SELECT ladder, 3, track_id, 0, concat({_SET_SQL}, chr(10), {_representation_sql('track_key', "'init.mp4'", '0', "''")}, chr(10), '{_CLOSE_SET}') FROM ow JOIN fi USING (ladder) WHERE kind = 'audio' AND asset_id = owner
  UNION ALL SELECT ladder, 4, 0, 0, '  </Period>' || chr(10) || '</MPD>' FROM fi)""".replace(_OPEN, _OPEN.replace("\n", "' || chr(10) || '")),
    "SELECT ladder, string_agg(line, chr(10) ORDER BY part, place, tie) || chr(10) AS body FROM ln GROUP BY ladder"))
def adaptive_manifest(spark, sf_dir: str) -> DataFrame:
    """All video renditions in one set, so that a player may change between them; audio of the first rendition."""
    _, plan, m, r = _prepared(spark, sf_dir)
    own = m.join(r, list(TRACK)).join(timelines(plan), list(TRACK)).withColumn("ladder", F.col("asset_id") % GROUPS)
    video = own.where("kind = 'video'")
    lead = video.groupBy("ladder").agg(F.min("asset_id").alias("owner"), F.max(rescale(F.col("end_time") - F.col("first_time"), "timescale", 1000)).alias("ms"))
    none = F.lit(None).cast("string")
    audio = own.join(lead.select("ladder", "owner"), "ladder").where("kind = 'audio' and asset_id = owner")
    audio_set = _text(set_head(), "\n", representations(audio, F.col("track_key"), F.lit("init.mp4"), F.lit(0), none), "\n", _CLOSE_SET)
    row = lambda df, part, place, tie, line: df.select("ladder", F.lit(part).alias("part"), place.cast("bigint").alias("place"), tie.cast("bigint").alias("tie"), line.alias("line"))
    zero = F.lit(0)
    head = _text(_OPEN, seconds_text(F.col("ms")), _PROFILE, '\n  <Period start="PT0S">\n    <AdaptationSet contentType="video" segmentAlignment="true" startWithSAP="1">')
    lines = (
        row(lead, 0, zero, zero, head)
        .unionByName(row(video, 1, F.col("peak_rate"), F.col("asset_id"), representations(video, _text("video-", F.col("asset_id")), F.lit("init.mp4"), F.lit(0), none)))
        .unionByName(row(lead, 2, zero, zero, F.lit(_CLOSE_SET)))
        .unionByName(row(audio, 3, F.col("track_id"), zero, audio_set))
        .unionByName(row(lead, 4, zero, zero, F.lit("  </Period>\n</MPD>")))
    )
    return _body(lines, ["ladder"], ["part", "place", "tie"])


# --- content keys: a customer is a clip's encryption, a nation is a sequence of clips ---

# fixed values: system ids of the public registry, by name
SYSTEMS = {
    "clearkey": "e2719d58-a985-b3c9-781a-b030af78d30e",
    "fairplay": "94ce86fb-07ff-4f43-adb8-93d2fa968ca2",
    "playready": "9a04f079-9840-4286-ab92-e65be0885f95",
    "widevine": "edef8ba9-79d6-4ace-a3c8-27dcd51d21ed",
}


def _pssh(system: str, data: Column) -> Column:
    """A version 0 box: size, name, version and flags, system id, length and data."""
    size = F.octet_length(data)
    number = lambda n: F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0"))
    return F.concat(number(size + 32), F.lit(b"pssh"), F.lit(bytes(4)), F.lit(bytes.fromhex(SYSTEMS[system].replace("-", ""))), number(size), data)


def clip_keys(customers: DataFrame) -> DataFrame:
    """(sequence, clip, key_id hex, system, data, url): the systems of each clip's key; a sixth of the clips are clear."""
    c = F.col("c_custkey")
    key = F.left(F.sha2(F.concat(F.lit("key "), (c % 7).cast("string")), 256), F.lit(32))
    base = customers.where(c % 6 != 0).select(F.col("c_nationkey").alias("sequence"), c.alias("clip"), key.alias("key_id"))
    names = F.array(*[F.lit(n) for n in SYSTEMS])
    each = base.select("*", F.posexplode(names).alias("place", "system")).where((F.col("clip") + F.col("place")) % 3 != 0)
    data = F.concat(F.lit("data of "), (F.col("clip") % 3).cast("string")).cast("binary")
    url = F.concat(F.lit("https://keys.example.com/"), F.col("system"), F.lit("?a=1&k="), (F.col("clip") % 5).cast("string"))
    return each.withColumn("data", data).withColumn("url", url)


KEYS_SQL = """
bs AS (SELECT c_nationkey AS sequence, c_custkey AS clip, left(sha256('key ' || (c_custkey % 7)), 32) AS key_id FROM customer WHERE c_custkey % 6 <> 0),
sy AS (SELECT *, 'data of ' || (clip % 3) AS data, 'https://keys.example.com/' || system || '?a=1&k=' || (clip % 5) AS url FROM bs, (VALUES (0, 'clearkey', 'e2719d58a985b3c9781ab030af78d30e'), (1, 'fairplay', '94ce86fb07ff4f43adb893d2fa968ca2'), (2, 'playready', '9a04f07998404286ab92e65be0885f95'), (3, 'widevine', 'edef8ba979d64acea3c827dcd51d21ed')) v(place, system, sid) WHERE (clip + place) % 3 <> 0),
ps AS (SELECT *, to_base64(unhex(printf('%08x', length(data) + 32) || hex('pssh') || '00000000' || sid || printf('%08x', length(data)) || hex(data))) AS pssh FROM sy),
aw AS (SELECT *, CASE system WHEN 'clearkey' THEN 'URI="' || url || '",KEYFORMAT="org.w3.clearkey",KEYFORMATVERSIONS="1"' WHEN 'fairplay' THEN 'URI="skd://' || (clip % 5) || '",KEYFORMAT="com.apple.streamingkeydelivery",KEYFORMATVERSIONS="1"'
  WHEN 'playready' THEN 'URI="data:text/plain;charset=UTF-16;base64,' || to_base64(encode(data)) || '",KEYFORMAT="com.microsoft.playready",KEYFORMATVERSIONS="1"'
  ELSE 'URI="data:text/plain;base64,' || pssh || '"{key}KEYFORMAT="urn:uuid:edef8ba9-79d6-4ace-a3c8-27dcd51d21ed",KEYFORMATVERSIONS="1"' END AS raw FROM ps),
li AS (SELECT *, replace(raw, '{key}', ',KEYID=0x' || key_id || ',') AS attributes, replace(raw, '{key}', ',') AS identity FROM aw)"""


def key_attributes(keys: DataFrame) -> DataFrame:
    """keys with attributes, and identity: the same without what names the key."""
    pssh = F.base64(F.when(F.col("system") == "widevine", _pssh("widevine", F.col("data"))))
    version = ',KEYFORMATVERSIONS="1"'

    def line(key_id: Column) -> Column:
        return (
            F.when(F.col("system") == "clearkey", _text('URI="', F.col("url"), '",KEYFORMAT="org.w3.clearkey"', version))
            .when(F.col("system") == "fairplay", _text('URI="skd://', F.col("clip") % 5, '",KEYFORMAT="com.apple.streamingkeydelivery"', version))
            .when(F.col("system") == "playready", _text('URI="data:text/plain;charset=UTF-16;base64,', F.base64("data"), '",KEYFORMAT="com.microsoft.playready"', version))
            .otherwise(_text('URI="data:text/plain;base64,', pssh, '"', key_id, ',KEYFORMAT="urn:uuid:', SYSTEMS["widevine"], '"', version))
        )

    return keys.withColumn("attributes", line(_text(",KEYID=0x", F.col("key_id")))).withColumn("identity", line(F.lit("")))


@_query(f"WITH {KEYS_SQL} SELECT sequence, clip, string_agg('#EXT-X-KEY:METHOD=SAMPLE-AES,' || attributes, chr(10) ORDER BY place) || chr(10) AS lines FROM li GROUP BY sequence, clip")
def key_lines(spark, sf_dir: str) -> DataFrame:
    """The key lines of each clip, a line a system."""
    lines = key_attributes(clip_keys(table(spark, sf_dir, "customer"))).withColumn("line", F.concat(F.lit("#EXT-X-KEY:METHOD=SAMPLE-AES,"), F.col("attributes")))
    return _body(lines, ["sequence", "clip"], ["place"], name="lines")


@_query(f"""WITH {KEYS_SQL}, fi AS (SELECT *, row_number() OVER (PARTITION BY sequence, identity ORDER BY clip, place) AS k FROM li)
SELECT sequence, string_agg('#EXT-X-SESSION-KEY:METHOD=SAMPLE-AES,' || attributes, chr(10) ORDER BY clip, place) || chr(10) AS lines FROM fi WHERE k = 1 GROUP BY sequence""")
def session_keys(spark, sf_dir: str) -> DataFrame:
    """Of every clip of a sequence, each identity once, where it is seen first; the key id is no part of an identity."""
    keys = key_attributes(clip_keys(table(spark, sf_dir, "customer")))
    firsts = keys.groupBy("sequence", "identity").agg(F.min(F.struct("clip", "place", "attributes")).alias("f"))
    lines = firsts.select("sequence", "f.clip", "f.place", F.concat(F.lit("#EXT-X-SESSION-KEY:METHOD=SAMPLE-AES,"), F.col("f.attributes")).alias("line"))
    return _body(lines, ["sequence"], ["clip", "place"], name="lines")


@_query(f"""WITH {KEYS_SQL}, al AS (SELECT c_nationkey AS sequence, c_custkey AS clip, key_id, (SELECT string_agg(attributes, '|' ORDER BY place) FROM li WHERE li.clip = c_custkey) AS sys FROM customer LEFT JOIN bs ON clip = c_custkey),
tr AS (SELECT *, lag(key_id || coalesce(sys, '')) OVER (PARTITION BY sequence ORDER BY clip) AS before FROM al)
SELECT sequence, clip, CASE WHEN coalesce(key_id || coalesce(sys, ''), '') = coalesce(before, '') THEN 'same' WHEN key_id IS NULL THEN 'none' ELSE 'keys' END AS transition FROM tr""")
def key_transitions(spark, sf_dir: str) -> DataFrame:
    """What a playlist says between two clips: nothing, METHOD=NONE, or the next clip's keys."""
    customers = table(spark, sf_dir, "customer")
    systems = key_attributes(clip_keys(customers)).groupBy("clip").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "attributes"))), lambda x: x["attributes"]), "|").alias("sys"))
    c = F.col("c_custkey")
    key = F.when(c % 6 != 0, F.left(F.sha2(F.concat(F.lit("key "), (c % 7).cast("string")), 256), F.lit(32)))
    all_ = customers.select(F.col("c_nationkey").alias("sequence"), c.alias("clip"), key.alias("key_id")).join(systems, "clip", "left")
    now = F.coalesce(F.concat("key_id", F.coalesce("sys", F.lit(""))), F.lit(""))
    before = F.coalesce(F.lag(F.concat("key_id", F.coalesce("sys", F.lit("")))).over(Window.partitionBy("sequence").orderBy("clip")), F.lit(""))
    return all_.select("sequence", "clip", F.when(now == before, "same").when(F.col("key_id").isNull(), "none").otherwise("keys").alias("transition"))


_UUID = "concat({0}[1:8], '-', {0}[9:12], '-', {0}[13:16], '-', {0}[17:20], '-', {0}[21:32])"


@_query(f"""WITH {KEYS_SQL} SELECT sequence, clip, concat('      <ContentProtection schemeIdUri="urn:mpeg:dash:mp4protection:2011" value="cbcs" cenc:default_KID="', {_UUID.format("any_value(key_id)")}, '" />', chr(10),
  string_agg(concat('      <ContentProtection schemeIdUri="urn:uuid:', {_UUID.format('sid')}, '">', chr(10), CASE WHEN system IN ('widevine', 'playready') THEN '        <cenc:pssh>' || pssh || '</cenc:pssh>' || chr(10) ELSE '' END,
    CASE system WHEN 'clearkey' THEN '        <dashif:Laurl>' || replace(replace(url, '&', '&amp;'), '<', '&lt;') || '</dashif:Laurl>' || chr(10) ELSE '' END, '      </ContentProtection>'), chr(10) ORDER BY place), chr(10)) AS elements FROM li GROUP BY sequence, clip""")
def content_protection(spark, sf_dir: str) -> DataFrame:
    """The ContentProtection elements of each clip: the scheme with the key id, then a system each."""
    keys = clip_keys(table(spark, sf_dir, "customer"))
    at = lambda c, a, n: F.substring(c, a, n)
    key = F.col("key_id")
    uuid = F.concat_ws("-", at(key, 1, 8), at(key, 9, 4), at(key, 13, 4), at(key, 17, 4), at(key, 21, 12))
    sid = F.element_at(F.create_map(*[F.lit(x) for pair in SYSTEMS.items() for x in pair]), F.col("system"))
    pssh = F.when(F.col("system") == "widevine", _pssh("widevine", F.col("data"))).when(F.col("system") == "playready", _pssh("playready", F.col("data")))
    url = F.when(F.col("system") == "clearkey", F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))
    line = _text('      <ContentProtection schemeIdUri="urn:uuid:', sid, '">\n', _optional("        <cenc:pssh>", F.base64(pssh), "</cenc:pssh>\n"), _optional("        <dashif:Laurl>", url, "</dashif:Laurl>\n"), "      </ContentProtection>")
    rows = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    per = keys.groupBy("sequence", "clip").agg(F.first(uuid).alias("uuid"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("lines"))
    head = _text('      <ContentProtection schemeIdUri="urn:mpeg:dash:mp4protection:2011" value="cbcs" cenc:default_KID="', F.col("uuid"), '" />\n')
    return per.select("sequence", "clip", _text(head, F.col("lines"), "\n").alias("elements"))
