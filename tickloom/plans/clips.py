"""Clip windows, sequences of clips, ladder checks, key schedules and edits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exact import floor_div, rescale, seconds_text
from tickloom.operators.ordered import running_before
from tickloom.operators.series import TRACK, compress_runs, greedy_boundaries, keyframes
from tickloom.plans.catalog import BOUNDS_SQL, KEY_SQL, PART, PLAN_SQL, VARIANT_SQL, _with, global_segment_numbers, variant_rate
from tickloom.plans.segments import TARGET_MS, reference_track
from tickloom.sources.views import SAMPLES_SQL, samples, tracks

#: The clip that is cut from every asset, and the starts of the key periods, in milliseconds.
FROM_MS, TO_MS = 10_000, 60_000
PERIODS_MS = (0, 50_000, 120_000)
#: Assets whose ids agree modulo this are the renditions of a ladder or the clips of a sequence.
GROUPS = 10
#: Denominator of all timescales (1000, 44100, 48000, 90000), and the scale of edit delays.
COMMON, MOVIE_SCALE = 35_280_000, 90_000

Q: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _pts():
    return F.col("decode_time") + F.col("composition_offset")


@_query(_with(SAMPLES_SQL, "SELECT asset_id, track_id, sample_index, decode_time + composition_offset AS pts FROM s"))
def presentation_times(spark, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select(*TRACK, "sample_index", _pts().alias("pts"))


@_query(_with(SAMPLES_SQL, f", k AS ({KEY_SQL}) SELECT asset_id, track_id, sample_index, decode_time FROM k WHERE nth = 3"))
def nth_keyframe(spark, sf_dir: str) -> DataFrame:
    return keyframes(samples(spark, sf_dir)).where("nth = 3").select(*TRACK, "sample_index", "decode_time")


@_query(_with(SAMPLES_SQL, "SELECT asset_id, track_id, sample_index, decode_time, duration FROM s JOIN tr USING (asset_id, track_id) WHERE sample_index = samples // 2"))
def run_lookup(spark, sf_dir: str) -> DataFrame:
    """The middle sample of each track, from the timing run that holds it."""
    runs = compress_runs(samples(spark, sf_dir))
    total = Window.partitionBy(*TRACK)
    probed = runs.withColumn("sample_index", floor_div(F.sum("n").over(total), 2))
    held = probed.where("first_sample <= sample_index and sample_index < first_sample + n")
    return held.select(*TRACK, "sample_index", (F.col("first_time") + (F.col("sample_index") - F.col("first_sample")) * F.col("delta")).alias("decode_time"), F.col("delta").alias("duration"))


def video_windows(s: DataFrame, from_ms: int = FROM_MS, to_ms: int = TO_MS) -> DataFrame:
    """(asset_id, track_id, first_sample, end_sample) of video tracks that reach from_ms: from the last sync sample
    presented by then (or else the first) through the shortest prefix with all that is presented before to_ms."""
    begin, end = (F.expr(f"({ms} * timescale) div 1000") for ms in (from_ms, to_ms))
    # all rows of a track see its first sample: the second pass needs no join
    whole = Window.partitionBy(*TRACK)
    sync = F.when(F.col("is_sync"), F.col("sample_index"))
    first = F.coalesce(F.max(F.when(_pts() <= begin, sync)).over(whole), F.min(sync).over(whole))
    video = s.where("track_id = 1").withColumn("first_sample", first).withColumn("_end_time", F.max(F.col("decode_time") + F.col("duration")).over(whole)).where(F.col("_end_time") > begin)
    shown = F.max(F.when((F.col("sample_index") >= F.col("first_sample")) & (_pts() < end), F.col("sample_index") + 1))
    return video.groupBy(*TRACK, "first_sample").agg(F.greatest(shown, F.col("first_sample") + 1).alias("end_sample"))


VIDEO_SQL = f"""SELECT asset_id, track_id, f AS first_sample, greatest(f + 1, max(sample_index + 1) FILTER (sample_index >= f AND pts < t1)) AS end_sample FROM
  (SELECT *, coalesce(max(sample_index) FILTER (is_sync AND pts <= t0) OVER v, min(sample_index) FILTER (is_sync) OVER v) AS f, max(decode_time + duration) OVER v AS e
   FROM (SELECT *, decode_time + composition_offset AS pts, {FROM_MS} * timescale // 1000 AS t0, {TO_MS} * timescale // 1000 AS t1 FROM s WHERE track_id = 1) WINDOW v AS (PARTITION BY asset_id, track_id))
  WHERE e > t0 GROUP BY asset_id, track_id, f"""


@_query(_with(SAMPLES_SQL, VIDEO_SQL))
def clip_video_window(spark, sf_dir: str) -> DataFrame:
    return video_windows(samples(spark, sf_dir))


@_query(_with(SAMPLES_SQL, f"""SELECT asset_id, track_id, f AS first_sample, greatest(f + 1, e) AS end_sample FROM (SELECT asset_id, track_id,
  coalesce(max(sample_index) FILTER (decode_time <= {FROM_MS} * timescale // 1000), 0) AS f, coalesce(min(sample_index) FILTER (decode_time >= {TO_MS} * timescale // 1000), count(*)) AS e
  FROM s WHERE track_id > 1 GROUP BY asset_id, track_id)"""))
def clip_audio_window(spark, sf_dir: str) -> DataFrame:
    """The frame that holds the clip's start through the first frame at its end or later, one at least."""
    begin, end = (F.expr(f"({ms} * timescale) div 1000") for ms in (FROM_MS, TO_MS))
    per = samples(spark, sf_dir).where("track_id > 1").groupBy(*TRACK).agg(
        F.coalesce(F.max(F.when(F.col("decode_time") <= begin, F.col("sample_index"))), F.lit(0).cast("bigint")).alias("first_sample"),
        F.coalesce(F.min(F.when(F.col("decode_time") >= end, F.col("sample_index"))), F.count(F.lit(1))).alias("_end"),
    )
    return per.select(*TRACK, "first_sample", F.greatest(F.col("first_sample") + 1, "_end").alias("end_sample"))


@_query(_with(SAMPLES_SQL, f"""SELECT asset_id, greatest(0, arg_min(decode_time, sample_index) - min(decode_time + composition_offset))::BIGINT AS lead
  FROM s JOIN ({VIDEO_SQL}) v USING (asset_id, track_id) WHERE sample_index >= first_sample AND sample_index < end_sample GROUP BY asset_id"""))
def clip_lead(spark, sf_dir: str) -> DataFrame:
    """How much later a clip has to start, so that none of its frames is presented before its first decode time."""
    s = samples(spark, sf_dir, reuse=True)
    kept = s.join(video_windows(s), list(TRACK)).where("sample_index >= first_sample and sample_index < end_sample")
    per = kept.groupBy("asset_id").agg(F.min_by("decode_time", "sample_index").alias("origin"), F.min(_pts()).alias("shown"))
    return per.select("asset_id", F.greatest(F.lit(0).cast("bigint"), F.col("origin") - F.col("shown")).alias("lead"))


@_query(_with(SAMPLES_SQL, """SELECT asset_id, length_ns, coalesce(sum(length_ns) OVER (ORDER BY asset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ns
  FROM (SELECT asset_id, (end_time::HUGEINT * 1000000000 // timescale)::BIGINT AS length_ns FROM tr WHERE track_id = 1)"""))
def clip_starts(spark, sf_dir: str) -> DataFrame:
    """Assets as clips of one sequence: each length is rounded down once, a start is the sum of the lengths before."""
    lengths = tracks(samples(spark, sf_dir)).where("track_id = 1").select("asset_id", rescale("end_time", "timescale", 1_000_000_000).alias("length_ns"))
    return running_before(lengths, ["asset_id"], "length_ns", "start_ns").select("asset_id", "length_ns", F.col("start_ns").cast("bigint"))


@_query(_with(PLAN_SQL, """, n AS (SELECT asset_id, count(*) AS segments FROM own GROUP BY asset_id),
f AS (SELECT *, coalesce(sum(segments) OVER (ORDER BY asset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM n)
SELECT r.number, f.asset_id, r.number - f.a AS local FROM (SELECT unnest(range((SELECT sum(segments)::BIGINT FROM n))) AS number) r JOIN f ON r.number >= f.a AND r.number < f.a + f.segments"""))
def segment_to_clip(spark, sf_dir: str) -> DataFrame:
    """Each number of the sequence with its clip and the number within it: clips unfold their own numbers, nothing is joined."""
    clips = global_segment_numbers(spark, sf_dir)
    return clips.select("asset_id", "first_segment", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("segments") - 1)).alias("local")).select((F.col("first_segment") + F.col("local")).alias("number"), "asset_id", "local")


def _reference_cuts(s: DataFrame) -> DataFrame:
    """(asset_id, track_id, timescale, segment_index, start_ms) of each asset's reference track."""
    ref = reference_track(tracks(s))
    chosen = s.join(ref, "asset_id").where("track_id = reference").drop("reference")
    scale = chosen.groupBy(*TRACK).agg(F.first("timescale").alias("timescale"), F.floor(F.max("duration") * 1000 / F.first("timescale")).cast("bigint").alias("tolerance"))
    return greedy_boundaries(chosen, TARGET_MS).join(scale, list(TRACK)).select("asset_id", "segment_index", rescale("decode_time", "timescale", 1000).alias("start_ms"), "tolerance")


CUTS_SQL = """, rc AS (SELECT c.asset_id, c.segment_index, (c.decode_time::HUGEINT * 1000 // c.timescale)::BIGINT AS start_ms, x.tolerance
  FROM cuts c JOIN (SELECT asset_id, coalesce(min(track_id) FILTER (track_id = 1), min(track_id)) AS reference FROM tr GROUP BY asset_id) r ON c.asset_id = r.asset_id AND c.track_id = r.reference
  JOIN (SELECT asset_id, track_id, (max(duration) * 1000 // any_value(timescale))::BIGINT AS tolerance FROM s GROUP BY asset_id, track_id) x ON x.asset_id = c.asset_id AND x.track_id = c.track_id)"""


@_query(_with(BOUNDS_SQL + CUTS_SQL, f"""SELECT a.asset_id % {GROUPS} AS ladder, a.asset_id, a.segment_index, abs(a.start_ms - b.start_ms) AS apart_ms, abs(a.start_ms - b.start_ms) <= greatest(a.tolerance, b.tolerance) AS aligned
  FROM rc a JOIN rc b ON a.segment_index = b.segment_index AND a.asset_id % {GROUPS} = b.asset_id % {GROUPS} AND b.asset_id = (SELECT min(asset_id) FROM rc c WHERE c.asset_id % {GROUPS} = b.asset_id % {GROUPS})"""))
def ladder_alignment(spark, sf_dir: str) -> DataFrame:
    """Each rendition's segment starts against those of its ladder's first, within the longest sample of either."""
    cuts = _reference_cuts(samples(spark, sf_dir, reuse=True)).withColumn("ladder", F.col("asset_id") % GROUPS)
    firsts = cuts.groupBy("ladder").agg(F.min("asset_id").alias("first_asset"))
    first = cuts.join(firsts, "ladder").where("asset_id = first_asset").select("ladder", "segment_index", F.col("start_ms").alias("first_ms"), F.col("tolerance").alias("first_tolerance"))
    apart = F.abs(F.col("start_ms") - F.col("first_ms"))
    return cuts.join(first, ["ladder", "segment_index"]).select("ladder", "asset_id", "segment_index", apart.alias("apart_ms"), (apart <= F.greatest("tolerance", "first_tolerance")).alias("aligned"))


@_query(_with(SAMPLES_SQL, """, l AS (SELECT asset_id, track_id, ((end_time - first_time)::HUGEINT * 1000 // timescale)::BIGINT AS ms, (SELECT max(duration) FROM s WHERE s.asset_id = tr.asset_id AND s.track_id = tr.track_id) * 1000 // timescale AS tol FROM tr)
SELECT asset_id, track_id, ms, arg_min(ms, track_id) OVER w AS first_ms, abs(ms - arg_min(ms, track_id) OVER w) <= greatest(tol, arg_min(tol, track_id) OVER w) AS agrees FROM l WINDOW w AS (PARTITION BY asset_id)"""))
def clip_length_agreement(spark, sf_dir: str) -> DataFrame:
    """Lengths of an asset's tracks against its first track's, within the longest sample of either."""
    longest = samples(spark, sf_dir).groupBy(*TRACK, "timescale").agg(F.max("duration").alias("longest"), F.min("decode_time").alias("a"), F.max_by(F.col("decode_time") + F.col("duration"), F.col("sample_index")).alias("b"))
    per = longest.select(*TRACK, rescale(F.col("b") - F.col("a"), "timescale", 1000).alias("ms"), rescale("longest", "timescale", 1000).alias("tol"))
    w = Window.partitionBy("asset_id").orderBy("track_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return per.select(*TRACK, "ms", F.first("ms").over(w).alias("first_ms"), (F.abs(F.col("ms") - F.first("ms").over(w)) <= F.greatest("tol", F.first("tol").over(w))).alias("agrees"))


@_query(_with(PLAN_SQL, f""", v AS ({VARIANT_SQL}), d AS (SELECT asset_id, max(end_time::HUGEINT * 1000 // timescale)::BIGINT AS ms FROM tr GROUP BY asset_id)
SELECT asset_id % {GROUPS} AS sequence, max(peak_rate) AS peak_rate, (sum(average_rate::HUGEINT * ms) // sum(ms))::BIGINT AS average_rate FROM v JOIN d USING (asset_id) GROUP BY ALL"""))
def sequence_variant(spark, sf_dir: str) -> DataFrame:
    """The rates a sequence of clips declares: the highest peak, and the average weighted by length."""
    length = tracks(samples(spark, sf_dir)).groupBy("asset_id").agg(F.max(rescale("end_time", "timescale", 1000)).alias("ms"))
    per = variant_rate(spark, sf_dir).join(length, "asset_id").groupBy((F.col("asset_id") % GROUPS).alias("sequence")).agg(
        F.max("peak_rate").alias("peak_rate"), F.sum(F.col("average_rate").cast("decimal(19,0)") * F.col("ms").cast("decimal(10,0)")).cast("decimal(38,0)").alias("w"), F.sum("ms").cast("decimal(19,0)").alias("ms")
    )
    return per.select("sequence", "peak_rate", ((F.col("w") - F.col("w") % F.col("ms")) / F.col("ms")).cast("bigint").alias("average_rate"))


@_query(_with(SAMPLES_SQL, f""", l AS (SELECT asset_id, string_agg(track_id, '-' ORDER BY track_id) AS layout FROM tr GROUP BY asset_id)
SELECT asset_id, layout, layout = first_value(layout) OVER (PARTITION BY asset_id % {GROUPS} ORDER BY asset_id) AS fits FROM l"""))
def layout_check(spark, sf_dir: str) -> DataFrame:
    """Whether a clip has the same tracks as the first clip of its sequence."""
    per = tracks(samples(spark, sf_dir)).groupBy("asset_id").agg(F.array_join(F.array_sort(F.collect_list("track_id")).cast("array<string>"), "-").alias("layout"))
    w = Window.partitionBy(F.col("asset_id") % GROUPS).orderBy("asset_id")
    return per.select("asset_id", "layout", (F.col("layout") == F.first("layout").over(w)).alias("fits"))


KEYS_SQL = f", ks AS (SELECT asset_id, p.start_ms AS period_ms, min(segment_index) AS first_segment FROM rc, (SELECT unnest([{', '.join(map(str, PERIODS_MS))}])::BIGINT AS start_ms) p WHERE rc.start_ms >= p.start_ms GROUP BY ALL)"


def _key_schedule(cuts: DataFrame) -> DataFrame:
    """A conditional minimum a period, in one grouping; periods after the last segment have no row."""
    per = cuts.groupBy("asset_id").agg(*[F.min(F.when(F.col("start_ms") >= p, F.col("segment_index"))).alias(f"p{p}") for p in PERIODS_MS])
    each = per.select("asset_id", F.explode(F.array(*[F.struct(F.lit(p).cast("bigint").alias("period_ms"), F.col(f"p{p}").alias("first_segment")) for p in PERIODS_MS])).alias("x"))
    return each.select("asset_id", "x.*").where("first_segment is not null")


@_query(_with(BOUNDS_SQL + CUTS_SQL + KEYS_SQL, "SELECT * FROM ks"))
def key_schedule(spark, sf_dir: str) -> DataFrame:
    return _key_schedule(_reference_cuts(samples(spark, sf_dir, reuse=True)))


@_query(_with(BOUNDS_SQL + CUTS_SQL + KEYS_SQL, "SELECT rc.asset_id, rc.segment_index, max(period_ms) AS period_ms FROM rc JOIN ks ON rc.asset_id = ks.asset_id AND rc.segment_index >= ks.first_segment GROUP BY ALL"))
def segment_key(spark, sf_dir: str) -> DataFrame:
    """The key period in force at each segment."""
    cuts = _reference_cuts(samples(spark, sf_dir, reuse=True))
    starts = _key_schedule(cuts).groupBy("asset_id", F.col("first_segment").alias("segment_index")).agg(F.max("period_ms").alias("period_ms"))
    w = Window.partitionBy("asset_id").orderBy("segment_index")
    marked = cuts.select("asset_id", "segment_index").join(starts, ["asset_id", "segment_index"], "left")
    return marked.select("asset_id", "segment_index", F.last("period_ms", ignorenulls=True).over(w).alias("period_ms"))


_SHIFT = f"SELECT *, track_id * 100 AS delay, greatest(0, max(first_time::HUGEINT * ({COMMON} // timescale) - track_id * 100 * {COMMON // MOVIE_SCALE}) OVER (PARTITION BY asset_id)) AS o FROM tr"


@_query(_with(SAMPLES_SQL, f"SELECT asset_id, track_id, (((2 * (delay * {COMMON // MOVIE_SCALE} + o) * timescale + {COMMON}) // {2 * COMMON}) - first_time)::BIGINT AS shift FROM ({_SHIFT})"))
def edit_shift(spark, sf_dir: str) -> DataFrame:
    """Edits with a delay of 100 ticks times the track: all tracks move by what the earliest presentation needs, rounded half up."""
    t = tracks(samples(spark, sf_dir)).withColumn("delay", (F.col("track_id") * 100 * (COMMON // MOVIE_SCALE)).cast("decimal(20,0)"))
    late = F.col("first_time").cast("decimal(20,0)") * F.expr(f"{COMMON} div timescale").cast("decimal(10,0)") - F.col("delay")
    shared = F.greatest(F.lit(0).cast("decimal(31,0)"), F.max(late).over(Window.partitionBy("asset_id")).cast("decimal(31,0)"))
    twice = (2 * (F.col("delay") + shared)).cast("decimal(28,0)") * F.col("timescale").cast("decimal(9,0)") + COMMON
    return t.select(*TRACK, (((twice - twice % (2 * COMMON)) / (2 * COMMON)).cast("bigint") - F.col("first_time")).alias("shift"))


@_query(_with(SAMPLES_SQL, """SELECT asset_id, track_id, count(*) FILTER (pts < e) AS kept, coalesce(max(sample_index) FILTER (pts < e) < min(sample_index) FILTER (pts >= e), true) AS suffix
  FROM (SELECT s.*, s.decode_time + composition_offset AS pts, end_time * 3 // 4 AS e FROM s JOIN tr USING (asset_id, track_id)) GROUP BY ALL"""))
def trim_tail_suffix(spark, sf_dir: str) -> DataFrame:
    """Samples presented in the first three quarters, and whether what is cut off is the tail of the series."""
    whole = Window.partitionBy(*TRACK).orderBy("sample_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = _pts() < F.expr("(end_time * 3) div 4")
    s = samples(spark, sf_dir).withColumn("end_time", F.last(F.col("decode_time") + F.col("duration")).over(whole))
    per = s.groupBy(*TRACK).agg(F.count_if(inside).alias("kept"), F.max(F.when(inside, F.col("sample_index"))).alias("a"), F.min(F.when(~inside, F.col("sample_index"))).alias("b"))
    return per.select(*TRACK, "kept", F.coalesce(F.col("a") < F.col("b"), F.lit(True)).alias("suffix"))


#: The memory of each track's index, over s.
INDEX_SELECT = f"""SELECT asset_id, track_id, (4 * count(*) + 12 * sum(c) + 16 * sum(t) + 8 * sum(o) + 4 * count(*) FILTER (is_sync))::BIGINT AS bytes FROM (SELECT *, (lag("offset" + size) OVER w IS DISTINCT FROM "offset")::INT AS c, (lag(duration) OVER w IS DISTINCT FROM duration OR lag(decode_time + duration) OVER w IS DISTINCT FROM decode_time)::INT AS t,
  (lag(composition_offset) OVER w IS DISTINCT FROM composition_offset)::INT AS o FROM s WINDOW w AS ({PART})) GROUP BY ALL"""


@_query(_with(SAMPLES_SQL, INDEX_SELECT))
def index_bytes(spark, sf_dir: str) -> DataFrame:
    """Memory of a track's index: samples, chunks, timing and composition runs, and sync samples."""
    w = Window.partitionBy(*TRACK).orderBy("sample_index")

    def starts(before, now):
        return (~F.lag(before).over(w).eqNullSafe(now)).cast("bigint")

    same_time = F.lag("duration").over(w).eqNullSafe(F.col("duration")) & F.lag(F.col("decode_time") + F.col("duration")).over(w).eqNullSafe(F.col("decode_time"))
    flagged = samples(spark, sf_dir).select(*TRACK, "is_sync", starts(F.col("offset") + F.col("size"), F.col("offset")).alias("c"), (~same_time).cast("bigint").alias("t"), starts(F.col("composition_offset"), F.col("composition_offset")).alias("o"))
    return flagged.groupBy(*TRACK).agg((4 * F.count(F.lit(1)) + 12 * F.sum("c") + 16 * F.sum("t") + 8 * F.sum("o") + 4 * F.count_if("is_sync")).alias("bytes"))


@_query(_with(SAMPLES_SQL, f""", k AS ({KEY_SQL}) SELECT asset_id, track_id, string_agg(printf('#EXTINF:%d.%03d,', (ms // 1000)::BIGINT, (ms % 1000)::BIGINT), chr(10) ORDER BY nth) AS body
  FROM (SELECT *, ("interval"::HUGEINT * 1000 // timescale)::BIGINT AS ms FROM k WHERE track_id = 1) GROUP BY asset_id, track_id"""))
def iframe_lines(spark, sf_dir: str) -> DataFrame:
    """The segments of an I-frame playlist: one key frame each."""
    k = keyframes(samples(spark, sf_dir).where("track_id = 1"))
    line = F.concat(F.lit("#EXTINF:"), seconds_text(rescale("interval", "timescale", 1000)), F.lit(","))
    per = k.groupBy(*TRACK).agg(F.array_sort(F.collect_list(F.struct("nth", line.alias("x")))).alias("l"))
    return per.select(*TRACK, F.array_join(F.transform("l", lambda x: x["x"]), "\n").alias("body"))
