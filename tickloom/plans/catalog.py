"""All queries of the timeline engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exact import ceil_div, floor_div, rescale, seconds_text
from tickloom.functions.text import cue_time, url_identity, xml_escape
from tickloom.operators.ordered import exact_quantiles, running_before
from tickloom.operators.ranges import CHUNK, GAP_BUDGET, MAX_GAP, adjacent_ranges, gap_budget_reads
from tickloom.operators.series import TRACK, at_or_after, compress_runs, expand_runs, greedy_boundaries, keyframes
from tickloom.plans.segments import TARGET_MS, rates, reference_track, segment_bytes, segment_plan, target_durations, variant_rates
from tickloom.sources.views import SAMPLES_SQL, samples, table, tracks

PART = "PARTITION BY asset_id, track_id ORDER BY sample_index"

BOUNDS_SQL = f"""{SAMPLES_SQL},
sy AS (SELECT *, row_number() OVER ({PART}) AS k FROM s WHERE is_sync OR sample_index = 0),
walk AS (SELECT asset_id, track_id, timescale, k, sample_index, decode_time, decode_time + {TARGET_MS}::BIGINT * timescale // 1000 AS due, 0::BIGINT AS segment_index, true AS cut FROM sy WHERE k = 1
  UNION ALL SELECT w.asset_id, w.track_id, w.timescale, n.k, n.sample_index, n.decode_time,
    CASE WHEN n.decode_time >= w.due THEN n.decode_time + {TARGET_MS}::BIGINT * w.timescale // 1000 ELSE w.due END,
    w.segment_index + (n.decode_time >= w.due)::INT, n.decode_time >= w.due
  FROM walk w JOIN sy n ON n.asset_id = w.asset_id AND n.track_id = w.track_id AND n.k = w.k + 1),
cuts AS (SELECT asset_id, track_id, timescale, segment_index, sample_index AS first_sample, decode_time FROM walk WHERE cut)"""

PLAN_SQL = f"""{BOUNDS_SQL},
own AS (SELECT c.asset_id, c.track_id, c.timescale, segment_index, first_sample,
  coalesce(lead(first_sample) OVER w, t.samples) AS end_sample, decode_time, coalesce(lead(decode_time) OVER w, t.end_time) - decode_time AS duration, lead(decode_time) OVER w IS NULL AS last
  FROM cuts c JOIN tr t USING (asset_id, track_id) JOIN (SELECT asset_id, coalesce(min(track_id) FILTER (track_id = 1), min(track_id)) AS reference FROM tr GROUP BY asset_id) r USING (asset_id)
  WHERE c.track_id = r.reference WINDOW w AS (PARTITION BY c.asset_id ORDER BY segment_index)),
fo AS (SELECT t.asset_id, t.track_id, o.segment_index, o.last, t.samples, t.end_time, (o.decode_time::HUGEINT * t.timescale // o.timescale)::BIGINT AS t0 FROM own o JOIN tr t ON t.asset_id = o.asset_id AND t.track_id <> o.track_id),
f1 AS (SELECT fo.asset_id, fo.track_id, fo.segment_index, fo.last, fo.samples, fo.end_time, coalesce(min(x.sample_index), any_value(fo.samples)) AS first_sample
  FROM fo LEFT JOIN s x ON x.asset_id = fo.asset_id AND x.track_id = fo.track_id AND x.decode_time >= fo.t0 GROUP BY ALL),
f2 AS (SELECT *, CASE WHEN last THEN samples ELSE lead(first_sample) OVER (PARTITION BY asset_id, track_id ORDER BY segment_index) END AS end_sample FROM f1),
plan AS (SELECT asset_id, track_id, segment_index, first_sample, end_sample, decode_time, duration FROM own UNION ALL
  SELECT f.asset_id, f.track_id, f.segment_index, f.first_sample, f.end_sample, a.decode_time, greatest(coalesce(b.decode_time, f.end_time) - a.decode_time, 0)
  FROM f2 f JOIN s a ON a.asset_id = f.asset_id AND a.track_id = f.track_id AND a.sample_index = f.first_sample
  LEFT JOIN s b ON b.asset_id = f.asset_id AND b.track_id = f.track_id AND b.sample_index = f.end_sample WHERE f.first_sample < f.samples),
sized AS (SELECT p.*, coalesce(sum(x.size), 0)::BIGINT AS bytes FROM plan p LEFT JOIN s x ON x.asset_id = p.asset_id AND x.track_id = p.track_id AND x.sample_index >= p.first_sample AND x.sample_index < p.end_sample GROUP BY ALL),
rate AS (SELECT z.asset_id, z.track_id, any_value(a) AS average_rate, greatest(any_value(a), coalesce(max(CASE WHEN duration > 0 THEN (z.bytes * 8)::HUGEINT * timescale // duration END), 0))::BIGINT AS peak_rate
  FROM (SELECT sized.*, tr.timescale, (CASE WHEN tr.end_time > tr.first_time THEN (tr.bytes * 8)::HUGEINT * tr.timescale // (tr.end_time - tr.first_time) ELSE 0 END)::BIGINT AS a FROM sized JOIN tr USING (asset_id, track_id)) z GROUP BY ALL)"""


def _with(ctes: str, select: str, recursive: bool = True) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


Q: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@_query(_with(SAMPLES_SQL, "SELECT * FROM s"))
def series_from_events(spark, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir)


@_query(_with(SAMPLES_SQL, "SELECT asset_id, track_id, sample_index, (decode_time::HUGEINT * 1000 // timescale)::BIGINT AS ms, (decode_time::HUGEINT * 90000 // timescale)::BIGINT AS ticks_90k FROM s"))
def rescale_ticks(spark, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select(*TRACK, "sample_index", rescale("decode_time", "timescale", 1000).alias("ms"), rescale("decode_time", "timescale", 90000).alias("ticks_90k"))


@_query(_with(SAMPLES_SQL, "SELECT * FROM tr"))
def track_end(spark, sf_dir: str) -> DataFrame:
    return tracks(samples(spark, sf_dir))


@_query(_with(SAMPLES_SQL, """SELECT asset_id, max((end_time + timescale - 1) // timescale)::BIGINT AS seconds, max(end_time::HUGEINT * 1000 // timescale)::BIGINT AS ms,
  max(end_time::HUGEINT * 90000 // timescale)::BIGINT AS movie_duration FROM tr GROUP BY asset_id"""))
def presentation_duration(spark, sf_dir: str) -> DataFrame:
    t = tracks(samples(spark, sf_dir))
    return t.groupBy("asset_id").agg(F.max(ceil_div("end_time", "timescale")).alias("seconds"), F.max(rescale("end_time", "timescale", 1000)).alias("ms"), F.max(rescale("end_time", "timescale", 90000)).alias("movie_duration"))


@_query(_with(SAMPLES_SQL, """, o AS (SELECT asset_id, first_time AS num, timescale AS den FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY first_time::HUGEINT * (7056000 // timescale), track_id) AS k FROM tr) WHERE k = 1)
SELECT s.asset_id, s.track_id, s.sample_index, decode_time - (num::HUGEINT * s.timescale // den)::BIGINT AS decode_time FROM s JOIN o USING (asset_id)"""))
def normalise_origin(spark, sf_dir: str) -> DataFrame:
    """The earliest first sample, in seconds, over an asset's tracks becomes zero."""
    s = samples(spark, sf_dir, reuse=True)
    # fractions over their common denominator, the least common multiple of the three timescales
    key = F.col("first_time").cast("decimal(20,0)") * (F.lit(7_056_000) / F.col("timescale")).cast("decimal(10,0)")
    origin = tracks(s).groupBy("asset_id").agg(F.min_by(F.struct(F.col("first_time").alias("num"), F.col("timescale").alias("den")), F.struct(key, "track_id")).alias("o"))
    return s.join(origin, "asset_id").select(*TRACK, "sample_index", (F.col("decode_time") - rescale("o.num", "o.den", "timescale")).alias("decode_time"))


@_query(_with(SAMPLES_SQL, f""", a AS (SELECT *, CASE WHEN lag(duration) OVER w = duration AND lag(decode_time + duration) OVER w = decode_time THEN 0 ELSE 1 END AS new FROM s WINDOW w AS ({PART})),
b AS (SELECT *, sum(new) OVER ({PART}) - 1 AS run FROM a)
SELECT asset_id, track_id, run::BIGINT AS run, min(sample_index) AS first_sample, min(decode_time) AS first_time, count(*) AS n, min(duration) AS delta FROM b GROUP BY asset_id, track_id, run"""))
def runs_compress(spark, sf_dir: str) -> DataFrame:
    return compress_runs(samples(spark, sf_dir))


@_query(_with(SAMPLES_SQL, "SELECT asset_id, track_id, sample_index, decode_time, duration FROM s"))
def runs_expand(spark, sf_dir: str) -> DataFrame:
    """Compressed and expanded again: the series itself."""
    return expand_runs(compress_runs(samples(spark, sf_dir)))


CHUNK_SQL = """SELECT l_orderkey AS chunk, l_linenumber::BIGINT AS line, l_quantity::BIGINT AS size,
  coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk_offset FROM lineitem"""


@_query(CHUNK_SQL)
def chunk_map(spark, sf_dir: str) -> DataFrame:
    """Byte offset of each sample in its chunk; a chunk is an order, its samples are its lines."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("l_quantity").cast("bigint")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").cast("bigint").alias("line"), size.alias("size"), F.coalesce(F.sum(size).over(w), F.lit(0)).alias("chunk_offset"))


@_query(_with(SAMPLES_SQL, """, p AS (SELECT asset_id, track_id, unnest(range(0, 8)) AS probe, end_time, samples FROM tr), q AS (SELECT asset_id, track_id, probe, samples, (probe * end_time // 7)::BIGINT AS t FROM p)
SELECT q.asset_id, q.track_id, q.probe, q.t, coalesce(min(s.sample_index), any_value(q.samples)) AS first_sample FROM q LEFT JOIN s ON s.asset_id = q.asset_id AND s.track_id = q.track_id AND s.decode_time >= q.t GROUP BY ALL"""))
def first_at_or_after(spark, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir, reuse=True)
    probes = tracks(s).withColumn("probe", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint")))).select(*TRACK, floor_div(F.col("probe") * F.col("end_time"), 7).alias("t"), "probe", "samples")
    return at_or_after(s, probes).select(*TRACK, "probe", "t", F.coalesce("first_sample", "samples").alias("first_sample"))


@_query(_with(BOUNDS_SQL, "SELECT asset_id, track_id, segment_index, first_sample, decode_time FROM cuts"))
def greedy_cuts(spark, sf_dir: str) -> DataFrame:
    return greedy_boundaries(samples(spark, sf_dir), TARGET_MS)


@_query(_with(PLAN_SQL, "SELECT * FROM plan"))
def segment_plan_(spark, sf_dir: str) -> DataFrame:
    return segment_plan(samples(spark, sf_dir, reuse=True))


Q["segment_plan"], SQL["segment_plan"] = Q.pop("segment_plan_"), SQL.pop("segment_plan_")


@_query(_with(PLAN_SQL, "SELECT * FROM sized"))
def segment_sizes(spark, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir, reuse=True)
    return segment_bytes(s, segment_plan(s))


@_query(_with(PLAN_SQL, "SELECT * FROM rate"))
def avg_peak_rate(spark, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir, reuse=True)
    return rates(s, segment_plan(s))


VARIANT_SQL = "SELECT asset_id, sum(average_rate)::BIGINT AS average_rate, sum(peak_rate)::BIGINT AS peak_rate FROM (SELECT *, min(track_id) FILTER (track_id > 1) OVER (PARTITION BY asset_id) AS a FROM rate) WHERE track_id = 1 OR track_id = a GROUP BY asset_id"


@_query(_with(PLAN_SQL, VARIANT_SQL))
def variant_rate(spark, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir, reuse=True)
    return variant_rates(rates(s, segment_plan(s)))


@_query(_with(PLAN_SQL, f"SELECT row_number() OVER (ORDER BY peak_rate, asset_id)::BIGINT AS position, * FROM ({VARIANT_SQL})"))
def bandwidth_ladder(spark, sf_dir: str) -> DataFrame:
    """Assets as renditions of one ladder, by ascending peak, stable."""
    rated = variant_rate(spark, sf_dir).withColumn("one", F.lit(1).cast("bigint"))
    placed = running_before(rated, ["peak_rate", "asset_id"], "one", "before")
    return placed.select((F.col("before") + 1).cast("bigint").alias("position"), "asset_id", "average_rate", "peak_rate")


@_query(_with(PLAN_SQL, "SELECT asset_id, track_id, greatest(max((duration + timescale - 1) // timescale), 1)::BIGINT AS target_duration FROM plan JOIN tr USING (asset_id, track_id) GROUP BY ALL"))
def target_duration(spark, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir, reuse=True)
    return target_durations(segment_plan(s), tracks(s))


LINES_SQL = "SELECT asset_id, track_id, segment_index, printf('#EXTINF:%d.%03d,', (ms // 1000)::BIGINT, (ms % 1000)::BIGINT) AS extinf, printf('%d.m4s', segment_index) AS uri FROM (SELECT p.*, (p.duration::HUGEINT * 1000 // timescale)::BIGINT AS ms FROM plan p JOIN tr USING (asset_id, track_id))"


@_query(_with(PLAN_SQL, LINES_SQL))
def extinf_lines(spark, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir, reuse=True)
    return _lines(s, segment_plan(s))


def _lines(s: DataFrame, plan: DataFrame) -> DataFrame:
    ms = rescale("duration", "timescale", 1000)
    return plan.join(tracks(s).select(*TRACK, "timescale"), list(TRACK)).select(*TRACK, "segment_index", F.concat(F.lit("#EXTINF:"), seconds_text(ms), F.lit(",")).alias("extinf"), F.concat(F.col("segment_index").cast("string"), F.lit(".m4s")).alias("uri"))


KEY_SQL = f"SELECT s.asset_id, s.track_id, s.timescale, row_number() OVER w - 1 AS nth, sample_index, decode_time, coalesce(lead(decode_time) OVER w, end_time) - decode_time AS \"interval\", size FROM s JOIN tr USING (asset_id, track_id) WHERE is_sync WINDOW w AS (PARTITION BY s.asset_id, s.track_id ORDER BY sample_index)"


@_query(_with(SAMPLES_SQL, KEY_SQL))
def keyframe_intervals(spark, sf_dir: str) -> DataFrame:
    return keyframes(samples(spark, sf_dir))


@_query(_with(SAMPLES_SQL, f", k AS ({KEY_SQL}) SELECT asset_id, track_id, max(CASE WHEN \"interval\" > 0 THEN (size * 8)::HUGEINT * timescale // \"interval\" END)::BIGINT AS peak_rate, (CASE WHEN sum(\"interval\") > 0 THEN (sum(size) * 8)::HUGEINT * any_value(timescale) // sum(\"interval\") END)::BIGINT AS average_rate FROM k GROUP BY ALL"))
def keyframe_rates(spark, sf_dir: str) -> DataFrame:
    k = keyframes(samples(spark, sf_dir)).withColumn("rate", F.when(F.col("interval") > 0, rescale(F.col("size") * 8, "interval", "timescale")))
    per = k.groupBy(*TRACK, "timescale").agg(F.max("rate").alias("peak_rate"), (F.sum("size") * 8).alias("bits"), F.sum("interval").alias("span"))
    return per.select(*TRACK, "peak_rate", F.when(F.col("span") > 0, rescale("bits", "span", "timescale")).alias("average_rate"))


@_query(_with(SAMPLES_SQL, "SELECT asset_id, track_id, CASE WHEN kind = 'video' THEN 'video' ELSE 'audio-' || row_number() OVER (PARTITION BY asset_id, kind ORDER BY track_id) END AS track_key FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, kind ORDER BY track_id) AS nth FROM (SELECT asset_id, track_id, CASE WHEN track_id = 1 THEN 'video' ELSE 'audio' END AS kind FROM tr)) WHERE (kind = 'video' AND nth = 1) OR (kind = 'audio' AND nth = 2)"))
def track_selection(spark, sf_dir: str) -> DataFrame:
    """The selector v1-a2: the nth track of each kind in file order; what is left is numbered anew."""
    kind = F.when(F.col("track_id") == 1, "video").otherwise("audio")
    w = Window.partitionBy("asset_id", "kind").orderBy("track_id")
    chosen = tracks(samples(spark, sf_dir)).withColumn("kind", kind).withColumn("nth", F.row_number().over(w)).where("(kind = 'video' and nth = 1) or (kind = 'audio' and nth = 2)")
    return chosen.select(*TRACK, F.when(F.col("kind") == "video", "video").otherwise(F.concat(F.lit("audio-"), F.row_number().over(w).cast("string"))).alias("track_key"))


@_query(_with(PLAN_SQL, """, n AS (SELECT asset_id, count(*) AS segments FROM own GROUP BY asset_id)
SELECT asset_id, segments, coalesce(sum(segments) OVER (ORDER BY asset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_segment FROM n"""))
def global_segment_numbers(spark, sf_dir: str) -> DataFrame:
    """Assets as clips of one sequence: the number of each clip's first segment."""
    s = samples(spark, sf_dir, reuse=True)
    ref = reference_track(tracks(s))
    chosen = s.join(ref, "asset_id").where("track_id = reference").drop("reference")
    n = greedy_boundaries(chosen, TARGET_MS).groupBy("asset_id").agg(F.count(F.lit(1)).alias("segments"))
    return running_before(n, ["asset_id"], "segments", "first_segment").select("asset_id", "segments", F.col("first_segment").cast("bigint"))


@_query(_with(SAMPLES_SQL, f""", a AS (SELECT *, CASE WHEN lag("offset" + size) OVER w = "offset" THEN 0 ELSE 1 END AS new FROM s WINDOW w AS ({PART})), b AS (SELECT *, sum(new) OVER ({PART}) AS run FROM a)
SELECT asset_id, track_id, min(sample_index) AS first, min("offset") AS "offset", sum(size)::BIGINT AS length, count(*) AS pieces FROM b GROUP BY asset_id, track_id, run"""))
def adjacent_byte_ranges(spark, sf_dir: str) -> DataFrame:
    return adjacent_ranges(samples(spark, sf_dir).withColumnRenamed("size", "length"), list(TRACK), "sample_index")


@_query(_with(SAMPLES_SQL + f""",
pc AS (SELECT asset_id, track_id, row_number() OVER ({PART}) AS k, "offset" AS a, "offset" + size AS b FROM s),
rd AS (SELECT asset_id, track_id, k, a AS start, b AS "end", 0::BIGINT AS spent, 0::BIGINT AS read, b - a <= {CHUNK} AS open FROM pc WHERE k = 1
  UNION ALL SELECT asset_id, track_id, k, CASE WHEN fits THEN start ELSE a END, b, CASE WHEN fits THEN spent + a - "end" ELSE spent END, CASE WHEN fits THEN read ELSE read + 1 END, CASE WHEN fits THEN true ELSE b - a <= {CHUNK} END
  FROM (SELECT pc.*, r.start, r."end", r.spent, r.read, r.open AND pc.a >= r."end" AND pc.a - r."end" <= {MAX_GAP} AND r.spent + pc.a - r."end" <= {GAP_BUDGET} AND pc.b - r.start <= {CHUNK} AS fits
    FROM rd r JOIN pc ON pc.asset_id = r.asset_id AND pc.track_id = r.track_id AND pc.k = r.k + 1))""",
    "SELECT asset_id, track_id, read, min(start) AS start, max(\"end\") AS \"end\", count(*) AS pieces FROM rd GROUP BY asset_id, track_id, read"))
def gap_budget(spark, sf_dir: str) -> DataFrame:
    return gap_budget_reads(samples(spark, sf_dir).withColumnRenamed("size", "length"), list(TRACK), "sample_index")


_PARTS = ("o_orderkey::VARCHAR", "o_custkey::VARCHAR", "o_orderstatus", "o_orderpriority")


@_query(f"SELECT o_orderkey AS id, left(sha256(concat({', '.join(f'printf({chr(39)}%016x{chr(39)}, strlen({p})::BIGINT), {p}' for p in _PARTS)})), 16) AS version FROM orders")
def content_version(spark, sf_dir: str) -> DataFrame:
    """A digest of parts, each after its length, so that no two lists of parts run together alike."""
    parts = [F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")]
    joined = F.concat(*[x for p in parts for x in (F.lower(F.lpad(F.hex(F.octet_length(p).cast("bigint")), 16, "0")), p)])
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.left(F.sha2(joined, 256), F.lit(16)).alias("version"))


def _cues(spark, sf_dir: str) -> DataFrame:
    start = F.col("turn") * 2000
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", start.alias("start_ms"), (start + 50 * F.length("text")).cast("bigint").alias("end_ms"), "text")


_TIME = "printf('%02d:%02d:%02d.%03d', ({0} // 3600000)::BIGINT, ({0} // 60000 % 60)::BIGINT, ({0} // 1000 % 60)::BIGINT, ({0} % 1000)::BIGINT)"
_CUE_SQL = "cu AS (SELECT conv_id, turn, turn * 2000 AS start_ms, turn * 2000 + 50 * length(text) AS end_ms, text FROM conversations)"


@_query(f"WITH {_CUE_SQL} SELECT conv_id, turn, text, {_TIME.format('start_ms')} || ' --> ' || {_TIME.format('end_ms')} AS timing FROM cu")
def cue_timestamps(spark, sf_dir: str) -> DataFrame:
    return _cues(spark, sf_dir).select("conv_id", "turn", "text", F.concat(cue_time(F.col("start_ms")), F.lit(" --> "), cue_time(F.col("end_ms"))).alias("timing"))


@_query(f"WITH {_CUE_SQL} SELECT conv_id, concat('WEBVTT', chr(10), chr(10), string_agg(concat({_TIME.format('start_ms')}, ' --> ', {_TIME.format('end_ms')}, chr(10), replace(replace(text, '&', '&amp;'), '<', '&lt;'), chr(10)), chr(10) ORDER BY start_ms, turn, text)) AS body FROM cu GROUP BY conv_id")
def webvtt_document(spark, sf_dir: str) -> DataFrame:
    text = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    cue = F.concat(cue_time(F.col("start_ms")), F.lit(" --> "), cue_time(F.col("end_ms")), F.lit("\n"), text, F.lit("\n"))
    per = _cues(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "turn", "text", cue.alias("x")))).alias("l"))
    return per.select("conv_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("l", lambda c: c["x"]), "\n")).alias("body"))


@_query("SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS title FROM pages")
def xml_escape_titles(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", xml_escape(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"))


_ID_SQL = "lower(regexp_extract(url, '^([^:]+)://', 1)) || '://' || lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) || regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1)"


@_query(f"SELECT object, count(*) AS uses, min(page_id) AS first_use FROM (SELECT page_id, {_ID_SQL} AS object FROM pages) GROUP BY object")
def distinct_objects(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(url_identity(F.col("url")).alias("object")).agg(F.count(F.lit(1)).alias("uses"), F.min("page_id").alias("first_use"))


@_query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def grant_covers(spark, sf_dir: str) -> DataFrame:
    grants = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(grants, "doc_id", "left_semi")


@_query("""SELECT o_orderkey AS id, CASE WHEN NOT regexp_matches(o_orderkey::VARCHAR, '^[A-Za-z0-9_-]{1,128}$') THEN 'bad id' WHEN c_custkey IS NULL THEN 'no location' WHEN o_totalprice <= 0 THEN 'bad duration' ELSE 'ok' END AS outcome,
  least(greatest((CASE left(o_orderpriority, 1) WHEN '1' THEN 5 WHEN '2' THEN 60 WHEN '3' THEN 300 WHEN '4' THEN 3600 ELSE 100000 END), 30), 86400)::BIGINT AS ttl FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def answer_validation(spark, sf_dir: str) -> DataFrame:
    """Catalog answers: the first rule that fails, and the time to live within its limits."""
    answers = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    outcome = F.when(~F.col("o_orderkey").cast("string").rlike("^[A-Za-z0-9_-]{1,128}$"), "bad id").when(F.col("c_custkey").isNull(), "no location").when(F.col("o_totalprice") <= 0, "bad duration").otherwise("ok")
    first = F.left("o_orderpriority", F.lit(1))
    ttl = F.when(first == "1", 5).when(first == "2", 60).when(first == "3", 300).when(first == "4", 3600).otherwise(100_000)
    return answers.select(F.col("o_orderkey").alias("id"), outcome.alias("outcome"), F.least(F.greatest(ttl, F.lit(30)), F.lit(86_400)).cast("bigint").alias("ttl"))


_STATUS = "(CASE event_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END)"


@_query(f"SELECT event_type AS route, {_STATUS}::BIGINT AS status, count(*) AS n FROM events GROUP BY ALL")
def requests_by_route(spark, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 7 == 0, 404).when(F.col("event_id") % 7 == 1, 503).otherwise(200)
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("route"), status.cast("bigint").alias("status")).agg(F.count(F.lit(1)).alias("n"))


# fixed values: upper bounds of the latency histogram, in milliseconds
BOUNDS = (1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


@_query(f"SELECT event_type AS route, b AS bound, count(*) FILTER (value <= b) AS cumulative FROM events, (SELECT unnest([{', '.join(map(str, BOUNDS))}])::BIGINT AS b) GROUP BY ALL")
def latency_histogram(spark, sf_dir: str) -> DataFrame:
    """Cumulative counts for each bound: all in one pass, a conditional count a bound."""
    per = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("route")).agg(*[F.count_if(F.col("value") <= b).alias(f"b{b}") for b in BOUNDS])
    return per.select("route", F.explode(F.array(*[F.struct(F.lit(b).cast("bigint").alias("bound"), F.col(f"b{b}").alias("cumulative")) for b in BOUNDS])).alias("x")).select("route", "x.*")


@_query("SELECT event_type AS route, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), "value")
    return exact_quantiles(e, ["route"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@_query(_with(PLAN_SQL, "SELECT asset_id, count(DISTINCT track_id) AS tracks, count(DISTINCT segment_index) AS segments, sum(bytes)::BIGINT AS bytes FROM sized GROUP BY asset_id"))
def asset_rollup(spark, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir, reuse=True)
    return segment_bytes(s, segment_plan(s)).groupBy("asset_id").agg(F.countDistinct("track_id").alias("tracks"), F.countDistinct("segment_index").alias("segments"), F.sum("bytes").alias("bytes"))


def _parts() -> list:
    # they use this module's SQL, so they are imported when it is complete
    from tickloom.plans import clips, formats, grids, manifests, media_bytes, origin, playlists, requests, rules, status, trims

    return [clips, requests, formats, origin, playlists, manifests, trims, rules, status, media_bytes, grids]


def queries() -> dict:
    found = dict(Q)
    for part in _parts():
        found |= part.Q
    return found


def oracle_sql() -> dict[str, str]:
    found = dict(SQL)
    for part in _parts():
        found |= part.SQL
    return found
