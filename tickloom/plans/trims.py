"""Clips cut out of assets and edit lists applied to them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exact import rescale
from tickloom.operators.series import TRACK
from tickloom.plans.catalog import _with
from tickloom.plans.clips import COMMON
from tickloom.plans.segments import reference_track
from tickloom.sources.views import SAMPLES_SQL, samples, tracks

#: The scale of durations and delays in edit lists, and how many entries one may have.
MOVIE_SCALE, MAX_EDITS = 90_000, 16

Q: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def windows(assets: DataFrame) -> DataFrame:
    """(asset_id, from_ms, to_ms, start_ns, cut): the clip that is cut from each asset; to_ms may be null; cut: another clip follows."""
    a = F.col("asset_id")
    from_ms = (a % 5) * 15_000
    to_ms = F.when(a % 4 == 0, F.lit(None)).when(a % 7 == 0, from_ms).otherwise(from_ms + 40_000)
    return assets.select("asset_id", from_ms.cast("bigint").alias("from_ms"), to_ms.cast("bigint").alias("to_ms"), ((a % 3) * 1_500_000_000).cast("bigint").alias("start_ns"), (a % 2 == 0).alias("cut"))


def spans(s: DataFrame, clips: DataFrame) -> DataFrame:
    """What the reference track keeps of each clip: (asset_id, reference, ref_scale, outcome, origin, kept_end, lead, to_the_end, ...).

    Video: from the last sync sample presented by the start (or else the first) through the shortest prefix with all
    that is presented before the end.  Audio: from the frame that holds the start to the first one at the end or later.
    A window that reaches the end of the track keeps everything; lead is how much later the clip has to start so that
    nothing is presented before it.
    """
    t = tracks(s)
    ref = reference_track(t)
    scale = F.col("timescale")
    pts = F.col("decode_time") + F.col("composition_offset")
    own = s.join(ref, "asset_id").where("track_id = reference").join(clips, "asset_id")
    whole = Window.partitionBy("asset_id")
    end_time = F.max_by(F.col("decode_time") + F.col("duration"), F.col("sample_index")).over(whole)
    own = own.select("*", end_time.alias("end_time"), F.count(F.lit(1)).over(whole).alias("n"), rescale("from_ms", 1000, "timescale").alias("from_t"), rescale("to_ms", 1000, "timescale").alias("to_asked"))
    own = own.withColumn("to_t", F.when(F.col("to_asked") < F.col("end_time"), F.col("to_asked")))
    video, index = F.col("reference") == 1, F.col("sample_index")
    sync = F.when(F.col("is_sync"), index)
    video_first = F.coalesce(F.max(F.when(pts <= F.col("from_t"), sync)).over(whole), F.min(sync).over(whole), F.lit(0).cast("bigint"))
    audio_first = F.coalesce(F.max(F.when(F.col("decode_time") <= F.col("from_t"), index)).over(whole), F.lit(0).cast("bigint"))
    own = own.withColumn("first", F.when(video, video_first).otherwise(audio_first))
    video_end = F.max(F.when((index >= F.col("first")) & (pts < F.col("to_t")), index + 1)).over(whole)
    audio_end = F.min(F.when(F.col("decode_time") >= F.col("to_t"), index)).over(whole)
    end = F.when(F.col("to_t").isNull(), F.col("n")).when(video, F.coalesce(video_end, F.col("first") + 1)).otherwise(F.coalesce(audio_end, F.col("n")))
    own = own.withColumn("end", F.greatest(end, F.col("first") + 1))
    outcome = F.when(F.col("from_t") >= F.col("end_time"), "starts past the end").when(F.col("to_asked") <= F.col("from_t"), "ends before it starts").otherwise("ok")
    kept = own.where((index >= F.col("first")) & (index < F.col("end"))).groupBy("asset_id", "reference", scale.alias("ref_scale"), outcome.alias("outcome"), "start_ns", "cut").agg(
        F.min_by("decode_time", "sample_index").alias("origin"), F.max_by(F.col("decode_time") + F.col("duration"), index).alias("kept_end"), F.min(pts).alias("earliest"), F.max(F.col("end") == F.col("n")).alias("whole"),
    )
    return kept.select("*", F.greatest(F.col("origin") - F.col("earliest"), F.lit(0).cast("bigint")).alias("lead"), (F.col("whole") & ~F.col("cut")).alias("to_the_end"))


def trimmed(s: DataFrame, spans: DataFrame) -> DataFrame:
    """(asset_id, track_id, sample_index, decode_time) of the clips that are not refused; every track is cut at the reference's instants and moved to the clip's start."""
    ok = spans.where("outcome = 'ok'")
    own = s.join(ok, "asset_id").withColumn("from_", rescale("origin", "ref_scale", "timescale")).withColumn("until", rescale("kept_end", "ref_scale", "timescale"))
    is_ref = F.col("track_id") == F.col("reference")
    # the reference's kept samples are those between the times of its first and its last one
    within = (F.col("decode_time") >= F.col("from_")) & (F.col("to_the_end") | (F.col("decode_time") < F.col("until")))
    base = rescale("start_ns", 1_000_000_000, "timescale") + F.when(is_ref, F.col("lead")).otherwise(rescale("lead", "ref_scale", "timescale"))
    kept = own.where(within).select(*TRACK, "sample_index", (F.col("decode_time") - F.col("from_") + base).alias("decode_time"))
    complete = _complete(s, kept)
    return kept.join(complete, "asset_id", "left_semi")


def _complete(s: DataFrame, kept: DataFrame) -> DataFrame:
    """(asset_id) of the clips in which every track of the asset has a sample left."""
    all_ = s.groupBy("asset_id").agg(F.countDistinct("track_id").alias("n"))
    left = kept.groupBy("asset_id").agg(F.countDistinct("track_id").alias("m"))
    return all_.join(left, "asset_id").where("n = m").select("asset_id")


TRIM_SQL = """,
cw AS (SELECT DISTINCT asset_id, asset_id % 5 * 15000 AS from_ms, CASE WHEN asset_id % 4 = 0 THEN NULL WHEN asset_id % 7 = 0 THEN asset_id % 5 * 15000 ELSE asset_id % 5 * 15000 + 40000 END AS to_ms, asset_id % 3 * 1500000000 AS start_ns, asset_id % 2 = 0 AS cut FROM tr),
rf AS (SELECT asset_id, coalesce(min(track_id) FILTER (track_id = 1), min(track_id)) AS reference FROM tr GROUP BY asset_id),
r0 AS (SELECT s.*, decode_time + composition_offset AS pts, reference, t.end_time, t.samples AS n, start_ns, cut, (from_ms::HUGEINT * s.timescale // 1000)::BIGINT AS f, (to_ms::HUGEINT * s.timescale // 1000)::BIGINT AS asked
  FROM s JOIN rf USING (asset_id) JOIN cw USING (asset_id) JOIN tr t ON t.asset_id = s.asset_id AND t.track_id = s.track_id WHERE s.track_id = reference),
r1 AS (SELECT *, CASE WHEN asked < end_time THEN asked END AS t1, CASE WHEN reference = 1 THEN coalesce(max(sample_index) FILTER (is_sync AND pts <= f) OVER v, min(sample_index) FILTER (is_sync) OVER v, 0) ELSE coalesce(max(sample_index) FILTER (decode_time <= f) OVER v, 0) END AS a
  FROM r0 WINDOW v AS (PARTITION BY asset_id)),
r2 AS (SELECT *, greatest(a + 1, CASE WHEN t1 IS NULL THEN n WHEN reference = 1 THEN coalesce(max(sample_index + 1) FILTER (sample_index >= a AND pts < t1) OVER v, a + 1) ELSE coalesce(min(sample_index) FILTER (decode_time >= t1) OVER v, n) END) AS b FROM r1 WINDOW v AS (PARTITION BY asset_id)),
sp AS (SELECT *, greatest(origin - earliest, 0) AS lead, whole AND NOT cut AS to_the_end FROM (SELECT asset_id, reference, timescale AS ref_scale, CASE WHEN f >= end_time THEN 'starts past the end' WHEN asked <= f THEN 'ends before it starts' ELSE 'ok' END AS outcome, start_ns, cut,
  arg_min(decode_time, sample_index) AS origin, arg_max(decode_time + duration, sample_index) AS kept_end, min(pts) AS earliest, bool_or(b = n) AS whole FROM r2 WHERE sample_index >= a AND sample_index < b GROUP BY ALL)),
k0 AS (SELECT s.*, p.*, (origin::HUGEINT * s.timescale // ref_scale)::BIGINT AS x, (kept_end::HUGEINT * s.timescale // ref_scale)::BIGINT AS y, (start_ns::HUGEINT * s.timescale // 1000000000)::BIGINT + CASE WHEN s.track_id = reference THEN lead ELSE (lead::HUGEINT * s.timescale // ref_scale)::BIGINT END AS base
  FROM s JOIN sp p ON p.asset_id = s.asset_id WHERE outcome = 'ok'),
k1 AS (SELECT asset_id, track_id, sample_index, decode_time - x + base AS decode_time FROM k0 WHERE decode_time >= x AND (to_the_end OR decode_time < y)),
kc AS (SELECT asset_id FROM (SELECT asset_id, count(DISTINCT track_id) AS n FROM s GROUP BY asset_id) JOIN (SELECT asset_id, count(DISTINCT track_id) AS n FROM k1 GROUP BY asset_id) USING (asset_id, n))"""


@_query(_with(SAMPLES_SQL + TRIM_SQL, "SELECT k1.* FROM k1 WHERE asset_id IN (SELECT asset_id FROM kc)"))
def clip_trim(spark, sf_dir: str) -> DataFrame:
    """The samples of each clip, on the clip's own timeline."""
    s = samples(spark, sf_dir, reuse=True)
    return trimmed(s, spans(s, windows(s.select("asset_id").distinct())))


@_query(_with(SAMPLES_SQL + TRIM_SQL, """SELECT asset_id, CASE WHEN outcome = 'ok' AND asset_id NOT IN (SELECT asset_id FROM kc) THEN 'a track is left empty' ELSE outcome END AS outcome, (lead::HUGEINT * 1000 // ref_scale)::BIGINT AS lead_ms, (origin::HUGEINT * 1000 // ref_scale)::BIGINT AS span_from_ms,
  (kept_end::HUGEINT * 1000 // ref_scale)::BIGINT AS span_to_ms, start_ns + ((kept_end - origin + lead)::HUGEINT * 1000000000 // ref_scale)::BIGINT AS end_ns, ((kept_end - origin + lead)::HUGEINT * 90000 // ref_scale)::BIGINT AS movie_duration FROM sp"""))
def clip_spans(spark, sf_dir: str) -> DataFrame:
    """Of each clip whether it is refused, what was kept on the file's clock, and where the next clip starts."""
    s = samples(spark, sf_dir, reuse=True)
    found = spans(s, windows(s.select("asset_id").distinct()))
    complete = trimmed(s, found).select("asset_id").distinct().withColumn("complete", F.lit(True))
    length = F.col("kept_end") - F.col("origin") + F.col("lead")
    empty = (F.col("outcome") == "ok") & F.col("complete").isNull()
    return found.join(complete, "asset_id", "left").select(
        "asset_id", F.when(empty, "a track is left empty").otherwise(F.col("outcome")).alias("outcome"), rescale("lead", "ref_scale", 1000).alias("lead_ms"), rescale("origin", "ref_scale", 1000).alias("span_from_ms"),
        rescale("kept_end", "ref_scale", 1000).alias("span_to_ms"), (F.col("start_ns") + rescale(length, "ref_scale", 1_000_000_000)).alias("end_ns"), rescale(length, "ref_scale", MOVIE_SCALE).alias("movie_duration"),
    )


# --- edit lists ---


def edit_entries(t: DataFrame) -> DataFrame:
    """t with version (0 or 1) and entries, an array of (segment_duration, media_time, rate, fraction); all ones marks an empty edit."""
    a = F.col("asset_id")
    # a third of the assets have lists of all shapes, the others ones that can be honoured
    k = F.when(a % 3 == 0, F.expr("asset_id div 3 + 3 * track_id") % 9).otherwise(F.get(F.array(*map(F.lit, (0, 1, 2, 6))), ((a + F.col("track_id")) % 4).cast("int")))
    version = (F.col("asset_id") % 2).cast("bigint")
    none = F.when(version == 1, F.lit(-1)).otherwise(F.lit(4_294_967_295)).cast("bigint")
    entry = lambda d, m, rate=1, fraction=0: F.struct(F.lit(d).cast("bigint").alias("segment_duration"), (m if isinstance(m, Column) else F.lit(m)).cast("bigint").alias("media_time"), F.lit(rate).cast("bigint").alias("rate"), F.lit(fraction).cast("bigint").alias("fraction"))
    empty = entry(45_000, none)
    shapes = [
        (1, F.array(entry(0, 250))), (2, F.array(empty, entry(9_000_000, 0))), (3, F.array(entry(100, 0), entry(100, 500))), (4, F.array(entry(0, 0, 2))), (5, F.array(empty)),
        (6, F.array(entry(5_000_000, 1024))), (7, F.array(empty, empty)), (8, F.array_repeat(entry(1, 0), 17)),
    ]
    out = entry(0, 0)
    chosen = F.array(out)
    for n, shape in shapes:
        chosen = F.when(k == n, shape).otherwise(chosen)
    return t.withColumn("version", version).withColumn("entries", F.when(k == 0, F.slice(F.array(out), 1, 0)).otherwise(chosen))


def edits(t: DataFrame) -> DataFrame:
    """t (with entries) with outcome, media_time, delay and media_end (null: to the end): one edit at rate 1, after one empty one at most."""
    marked = F.when(F.col("version") == 1, F.lit(-1)).otherwise(F.lit(4_294_967_295)).cast("bigint")
    first, second, n = F.get("entries", F.lit(0)), F.get("entries", F.lit(1)), F.size("entries")
    empty = lambda e: e["media_time"] == F.col("_none")
    alone, after = (n == 1) & ~empty(first), (n == 2) & empty(first) & ~empty(second)
    edit = F.when(alone, first).when(after, second)
    parsed = t.withColumn("_none", marked).withColumn("_edit", edit).withColumn("_after", after)
    e = F.col("_edit")
    most = F.when(F.col("version") == 1, F.lit(9_223_372_036_854_775_807)).otherwise(F.lit(2_147_483_647)).cast("bigint")
    outcome = (
        F.when(n > MAX_EDITS, "too many entries").when(n == 0, "ok").when(e.isNull(), "shape").when((e["rate"] != 1) | (e["fraction"] != 0), "rate")
        .when((e["media_time"] < 0) | (e["media_time"] > most), "negative").otherwise("ok")
    )
    zero = F.lit(0).cast("bigint")
    end = F.when(e["segment_duration"] != 0, e["media_time"] + rescale(e["segment_duration"], MOVIE_SCALE, "timescale"))
    return parsed.withColumn("outcome", outcome).select(
        *t.columns, "outcome", F.when(F.col("outcome") == "ok", F.coalesce(e["media_time"], zero)).alias("media_time"),
        F.when(F.col("outcome") == "ok", F.when(F.col("_after"), first["segment_duration"]).otherwise(zero)).alias("delay"), F.when(F.col("outcome") == "ok", end).alias("media_end"),
    )


def _entry_sql(d: int, m: str, rate: int = 1) -> str:
    return f"{{'d': {d}::BIGINT, 'm': ({m})::BIGINT, 'r': {rate}, 'f': 0}}"


_EMPTY = "CASE asset_id % 2 WHEN 1 THEN -1 ELSE 4294967295 END"
EDITS_SQL = f""",
e0 AS (SELECT *, asset_id % 2 AS version, CASE WHEN asset_id % 3 = 0 THEN (asset_id // 3 + 3 * track_id) % 9 ELSE [0, 1, 2, 6][(asset_id + track_id) % 4 + 1] END AS k, {_EMPTY} AS mark FROM tr),
e1 AS (SELECT *, CASE k WHEN 0 THEN [] WHEN 1 THEN [{_entry_sql(0, '250')}] WHEN 2 THEN [{_entry_sql(45000, 'mark')}, {_entry_sql(9000000, '0')}] WHEN 3 THEN [{_entry_sql(100, '0')}, {_entry_sql(100, '500')}] WHEN 4 THEN [{_entry_sql(0, '0', 2)}]
  WHEN 5 THEN [{_entry_sql(45000, 'mark')}] WHEN 6 THEN [{_entry_sql(5000000, '1024')}] WHEN 7 THEN [{_entry_sql(45000, 'mark')}, {_entry_sql(45000, 'mark')}] ELSE list_transform(range(17), lambda i: {_entry_sql(1, '0')}) END AS en FROM e0),
e2 AS (SELECT *, len(en) AS n, len(list_filter(en, lambda x: x.m = mark)) AS gaps, en[1].m = mark AS first_gap, list_filter(en, lambda x: x.m <> mark)[1] AS ed FROM e1),
ed AS (SELECT asset_id, track_id, timescale, CASE WHEN n > {MAX_EDITS} THEN 'too many entries' WHEN n = 0 THEN 'ok' WHEN NOT ((n = 1 AND gaps = 0) OR (n = 2 AND gaps = 1 AND first_gap)) THEN 'shape' WHEN ed.r <> 1 OR ed.f <> 0 THEN 'rate' ELSE 'ok' END AS outcome,
  CASE WHEN n = 0 THEN 0 ELSE ed.m END AS mt, CASE WHEN gaps = 1 THEN en[1].d ELSE 0 END AS dl, CASE WHEN n > 0 AND ed.d <> 0 THEN ed.m + (ed.d::HUGEINT * timescale // {MOVIE_SCALE})::BIGINT END AS me_ FROM e2)"""


@_query(_with(SAMPLES_SQL + EDITS_SQL, "SELECT asset_id, track_id, outcome, CASE WHEN outcome = 'ok' THEN mt END::BIGINT AS media_time, CASE WHEN outcome = 'ok' THEN dl END::BIGINT AS delay, CASE WHEN outcome = 'ok' THEN me_ END::BIGINT AS media_end FROM ed"))
def edit_shapes(spark, sf_dir: str) -> DataFrame:
    """What each track's edit list asks for, or why it is refused."""
    return edits(edit_entries(tracks(samples(spark, sf_dir)))).select(*TRACK, "outcome", "media_time", "delay", "media_end")


def shifts(e: DataFrame) -> DataFrame:
    """e (edits of assets that are not refused) with offset_num (over COMMON) and shift: later than the media time by what the asset's tracks need together."""
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    asked = exact("media_time") * F.floor(F.lit(COMMON) / F.col("timescale")).cast("decimal(10,0)") - exact("delay") * F.lit(COMMON // MOVIE_SCALE).cast("decimal(10,0)")
    offset = F.greatest(F.max(asked).over(Window.partitionBy("asset_id")), F.lit(0).cast("decimal(31,0)"))
    at = e.withColumn("offset_num", offset)
    twice = (exact("delay") * F.lit(COMMON // MOVIE_SCALE).cast("decimal(10,0)") + F.col("offset_num")).cast("decimal(28,0)") * (2 * F.col("timescale")).cast("decimal(8,0)") + F.lit(COMMON).cast("decimal(10,0)")
    by = F.lit(2 * COMMON).cast("decimal(10,0)")
    return at.withColumn("_twice", twice.cast("decimal(38,0)")).withColumn("shift", ((F.col("_twice") - F.col("_twice") % by) / by).cast("decimal(38,0)").cast("bigint") - F.col("media_time")).drop("_twice")


SHIFT_SQL = f""",
ok AS (SELECT * FROM ed WHERE asset_id NOT IN (SELECT asset_id FROM ed WHERE outcome <> 'ok')),
of AS (SELECT *, greatest(max(mt::HUGEINT * ({COMMON} // timescale) - dl::HUGEINT * {COMMON // MOVIE_SCALE}) OVER (PARTITION BY asset_id), 0) AS o FROM ok),
sh AS (SELECT *, ((2 * (dl::HUGEINT * {COMMON // MOVIE_SCALE} + o) * timescale + {COMMON}) // {2 * COMMON})::BIGINT - mt AS shift FROM of)"""


def _accepted(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = samples(spark, sf_dir, reuse=True)
    e = edits(edit_entries(tracks(s)))
    refused = e.where("outcome <> 'ok'").select("asset_id").distinct()
    return s, shifts(e.join(refused, "asset_id", "left_anti"))


@_query(_with(SAMPLES_SQL + EDITS_SQL + SHIFT_SQL, f"SELECT asset_id, ((2 * any_value(o) * 1000 + {COMMON}) // {2 * COMMON})::BIGINT AS offset_ms FROM sh GROUP BY asset_id"))
def edit_offset_ms(spark, sf_dir: str) -> DataFrame:
    """How much later than the file's own clock everything is, to the nearest millisecond: sidecar captions move by it."""
    _, e = _accepted(spark, sf_dir)
    per = e.select("asset_id", F.col("offset_num").cast("decimal(28,0)").alias("o")).distinct()
    twice, by = F.col("o") * F.lit(2000).cast("decimal(5,0)") + F.lit(COMMON).cast("decimal(10,0)"), F.lit(2 * COMMON).cast("decimal(10,0)")
    per = per.select("asset_id", twice.cast("decimal(38,0)").alias("t"))
    return per.select("asset_id", ((F.col("t") - F.col("t") % by) / by).cast("decimal(38,0)").cast("bigint").alias("offset_ms"))


@_query(_with(SAMPLES_SQL + EDITS_SQL + SHIFT_SQL + """,
j AS (SELECT s.*, decode_time + composition_offset AS pts, mt, me_, shift, min(CASE WHEN decode_time + composition_offset >= me_ THEN sample_index END) OVER (PARTITION BY s.asset_id, s.track_id) AS cut FROM s JOIN sh ON sh.asset_id = s.asset_id AND sh.track_id = s.track_id),
bad AS (SELECT DISTINCT asset_id, track_id FROM j WHERE sample_index >= cut AND pts < me_ UNION SELECT DISTINCT asset_id, track_id FROM j WHERE cut = 0)""",
    """SELECT asset_id, track_id, sample_index, decode_time + shift AS decode_time FROM j WHERE (cut IS NULL OR sample_index < cut) AND (track_id = 1 OR decode_time + duration > mt) AND (asset_id, track_id) NOT IN (SELECT asset_id, track_id FROM bad)"""))
def edit_apply(spark, sf_dir: str) -> DataFrame:
    """Every track cut to its edit and moved to the shared timeline; a cut that isn't a suffix, or leaves nothing, refuses the track."""
    s, e = _accepted(spark, sf_dir)
    pts = F.col("decode_time") + F.col("composition_offset")
    whole = Window.partitionBy(*TRACK)
    own = s.join(e.select(*TRACK, "media_time", "media_end", "shift"), list(TRACK)).withColumn("cut", F.min(F.when(pts >= F.col("media_end"), F.col("sample_index"))).over(whole))
    reordered = F.max(F.coalesce((F.col("sample_index") >= F.col("cut")) & (pts < F.col("media_end")), F.lit(False))).over(whole)
    own = own.withColumn("refused", reordered | F.coalesce(F.col("cut") == 0, F.lit(False))).where(~F.col("refused"))
    padding = (F.col("track_id") != 1) & (F.col("decode_time") + F.col("duration") <= F.col("media_time"))
    kept = own.where((F.col("cut").isNull() | (F.col("sample_index") < F.col("cut"))) & ~padding)
    return kept.select(*TRACK, "sample_index", (F.col("decode_time") + F.col("shift")).alias("decode_time"))
