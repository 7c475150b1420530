"""What an origin says of itself: counters, histograms, gauges, caches and reports, each with its SQL.

An event is a request: its type is the route, its value (in hundredths of a second) how long it took.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ordered import ordered_scan, running_before
from tickloom.plans.catalog import PLAN_SQL, _with
from tickloom.plans.clips import INDEX_SELECT, index_bytes
from tickloom.plans.playlists import CLIPS_SQL, MEDIA_PLAYLIST_SQL, SEGMENT_LINES_SQL, _prepared, clip_places, media_playlists
from tickloom.plans.segments import segment_bytes, segment_plan
from tickloom.sources.media import MEDIA_SQL, SUBTITLES_SQL, media, subtitles
from tickloom.sources.views import samples, table, tracks

Q: dict = {}
SQL: dict[str, str] = {}

# fixed values: closed domains of the counters, and the bounds of the histogram in seconds
ROUTES = ("click", "purchase", "view")
STATUSES = (200, 206, 304, 400, 404, 408, 416, 431, 500, 502, 503)
BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
RESOLVER, CACHE, ACCESS = ("ok", "unchanged", "not_found", "unavailable", "rejected"), ("hit", "miss", "revalidate", "stale", "negative_hit"), ("granted", "denied", "expired", "malformed")
#: Bytes of one cache, and of how many caches a user's requests are dealt to one.
CACHE_BYTES, CACHES = 1_000, 16
#: Limits of a segment.
MAX_SEGMENT_BYTES, MAX_SEGMENT_SAMPLES = 60_000, 12


def _query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_ANSWERS = (200, 206, 304, 404, 418, 503, 599)
_REQUEST_SQL = f"""re AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS matched, [{', '.join(map(str, _ANSWERS))}][event_id % {len(_ANSWERS)} + 1] AS status, round(value * 10000)::BIGINT AS micros FROM events),
rq AS (SELECT *, CASE WHEN matched IS NULL THEN 'unmatched' WHEN matched IN ({', '.join(f"'{r}'" for r in ROUTES)}) THEN matched ELSE 'other' END AS route FROM re)"""


def requests(spark, sf_dir: str) -> DataFrame:
    """(event_id, route, status, micros): routes within their closed domain."""
    e = table(spark, sf_dir, "events")
    matched = F.when(F.col("event_id") % 9 != 0, F.col("event_type"))
    route = F.when(matched.isNull(), "unmatched").when(matched.isin(*ROUTES), matched).otherwise("other")
    status = F.get(F.array(*map(F.lit, _ANSWERS)), (F.col("event_id") % len(_ANSWERS)).cast("int"))
    return e.select("event_id", route.alias("route"), status.alias("status"), F.round(F.col("value") * 10_000).cast("bigint").alias("micros"))


@_query(f"WITH {_REQUEST_SQL} SELECT route, CASE WHEN status IN ({', '.join(map(str, STATUSES))}) THEN status::VARCHAR ELSE 'other' END AS status, count(*) AS n FROM rq GROUP BY ALL")
def request_counters(spark, sf_dir: str) -> DataFrame:
    """Requests by route and status; what isn't in the domain is counted as other."""
    status = F.when(F.col("status").isin(*STATUSES), F.col("status").cast("string")).otherwise("other")
    return requests(spark, sf_dir).groupBy("route", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"""WITH {_REQUEST_SQL} SELECT route, le, n FROM (SELECT route, unnest([{', '.join(f"'{b:g}'" for b in BOUNDS)}, '+Inf', 'sum', 'count']) AS le, unnest([{', '.join(f"count(*) FILTER (micros <= {round(b * 1_000_000)})" for b in BOUNDS)}, count(*), sum(micros)::BIGINT, count(*)]) AS n FROM rq GROUP BY route)""")
def request_histogram(spark, sf_dir: str) -> DataFrame:
    """Cumulative counts by bound, with +Inf, the sum in microseconds and the count: one pass, a conditional count a bound."""
    within = [F.count_if(F.col("micros") <= round(b * 1_000_000)).alias(f"b{i}") for i, b in enumerate(BOUNDS)]
    per = requests(spark, sf_dir).groupBy("route").agg(*within, F.count(F.lit(1)).alias("all"), F.sum("micros").alias("total"))
    rows = [(f"{b:g}", f"b{i}") for i, b in enumerate(BOUNDS)] + [("+Inf", "all"), ("sum", "total"), ("count", "all")]
    return per.select("route", F.explode(F.array(*[F.struct(F.lit(le).alias("le"), F.col(c).alias("n")) for le, c in rows])).alias("x")).select("route", "x.*")


def _outcome_sql(name: str, values: tuple, by: int) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS counter, '{v}' AS outcome, count(*) FILTER (event_id // {by} % {len(values) + 1} = {i}) AS n FROM events" for i, v in enumerate(values))


@_query(" UNION ALL ".join((_outcome_sql("resolver", RESOLVER, 1), _outcome_sql("cache", CACHE, 3), _outcome_sql("access", ACCESS, 7))))
def outcome_counters(spark, sf_dir: str) -> DataFrame:
    """Outcomes of three kinds, each with its whole domain, in one pass."""
    kinds = (("resolver", RESOLVER, 1), ("cache", CACHE, 3), ("access", ACCESS, 7))
    cells = [(name, v, F.expr(f"event_id div {by}") % (len(values) + 1) == i) for name, values, by in kinds for i, v in enumerate(values)]
    one = table(spark, sf_dir, "events").agg(*[F.count_if(c).alias(f"c{i}") for i, (_, _, c) in enumerate(cells)])
    rows = [F.struct(F.lit(name).alias("counter"), F.lit(v).alias("outcome"), F.col(f"c{i}").alias("n")) for i, (name, v, _) in enumerate(cells)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


_SPAN_SQL = f"""WITH {_REQUEST_SQL}, sp AS (SELECT event_id, route, epoch_us(ts) AS t, epoch_us(ts) + micros * 1000 AS u FROM rq JOIN events USING (event_id)),
st AS (SELECT event_id, route, t, 1 AS d FROM sp UNION ALL SELECT event_id, route, u, -1 FROM sp)"""


@_query(f"{_SPAN_SQL} SELECT route, max(n)::BIGINT AS peak, sum(d)::BIGINT AS open_at_end FROM (SELECT route, d, sum(d) OVER (PARTITION BY route ORDER BY t, d, event_id ROWS UNBOUNDED PRECEDING) AS n FROM st) GROUP BY route")
def in_flight(spark, sf_dir: str) -> DataFrame:
    """The most requests at a time by route: a step up at each start and down at each end, summed in order by ranges of time."""
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    both = requests(spark, sf_dir).join(e, "event_id")
    steps = both.select("event_id", "route", "t", F.lit(1).cast("bigint").alias("d")).unionByName(both.select("event_id", "route", (F.col("t") + F.col("micros") * 1000).alias("t"), F.lit(-1).cast("bigint").alias("d")))
    run = running_before(steps, ["t", "d", "event_id"], "d", "before", ["route"])
    return run.groupBy("route").agg(F.max(F.col("before") + F.col("d")).cast("bigint").alias("peak"), F.sum("d").alias("open_at_end"))


@_query("""SELECT event_type AS scenario, avg(value) AS mean_cpu, max(value) AS max_memory, quantile_cont(value, 0.5) AS median_cold, count(*) / 30.0 AS per_second, count(*) / 30.0 / 4 AS per_core FROM events GROUP BY event_type""")
def bench_report(spark, sf_dir: str) -> DataFrame:
    """A report on runs: mean, highest and median figures, and rates (30 seconds, 4 cores)."""
    n = F.count(F.lit(1))
    per = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("scenario")).agg(F.avg("value").alias("mean_cpu"), F.max("value").alias("max_memory"), F.percentile("value", F.lit(0.5)).alias("median_cold"), n.alias("n"))
    return per.select("scenario", *[F.round(c, 6).alias(c) for c in ("mean_cpu", "max_memory", "median_cold")], F.round(F.col("n") / 30, 6).alias("per_second"), F.round(F.col("n") / 120, 6).alias("per_core"))


SQL["bench_report"] = f"SELECT scenario, round(mean_cpu, 6) AS mean_cpu, round(max_memory, 6) AS max_memory, round(median_cold, 6) AS median_cold, round(per_second, 6) AS per_second, round(per_core, 6) AS per_core FROM ({SQL['bench_report']})"


@_query()
def cache_events(spark, sf_dir: str) -> DataFrame:
    """Requests against caches that hold CACHE_BYTES and give up what was used longest ago.  No SQL: the tests compare with plain Python.

    An asset is a product's hundredth, its weight is fixed; users are dealt to CACHES caches, each scanned in order of its requests.
    """
    e = table(spark, sf_dir, "events")
    asset = (F.col("event_id") * 7919 % 101).cast("bigint")
    return lru(e.select((F.col("user_id") % CACHES).alias("cache"), "event_id", asset.alias("asset"), (asset % 23 * 13 + 5 + F.when(asset == 50, 2000).otherwise(0)).cast("bigint").alias("weight")), CACHE_BYTES)


def lru(asked: DataFrame, budget: int) -> DataFrame:
    """(cache, event_id, outcome, evicted, bytes): asked (cache, event_id, asset, weight) in order of event_id; what is heavier than the budget isn't kept."""

    def step(state, row):
        if row is None:
            return None, []
        held, total = state or (OrderedDict(), 0)
        event, asset, weight = row
        evicted = 0
        if asset in held:
            held.move_to_end(asset)
            outcome = "hit"
        elif weight > budget:
            outcome = "too heavy"
        else:
            outcome = "miss"
            while total + weight > budget:
                total -= held.popitem(last=False)[1]
                evicted += 1
            held[asset] = weight
            total += weight
        return (held, total), [(event, ("miss", "hit", "too heavy").index(outcome), evicted, total)]

    out = ordered_scan(asked, ["cache"], "event_id", ["event_id", "asset", "weight"], step, [(n, "bigint") for n in ("event_id", "code", "evicted", "bytes")])
    return out.select("cache", "event_id", F.get(F.array(*map(F.lit, ("miss", "hit", "too heavy"))), F.col("code").cast("int")).alias("outcome"), "evicted", "bytes")


@_query("SELECT user_id AS cache, string_agg(asset::VARCHAR, ',' ORDER BY last DESC) AS snapshot FROM (SELECT user_id, event_id % 40 AS asset, max(event_id) AS last FROM events GROUP BY ALL) GROUP BY user_id")
def cache_snapshot(spark, sf_dir: str) -> DataFrame:
    """What each user has asked for, most recently used first."""
    last = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 40).alias("asset")).agg(F.max("event_id").alias("last"))
    rows = F.sort_array(F.collect_list(F.struct("last", F.col("asset").cast("string").alias("a"))), asc=False)
    return last.groupBy(F.col("user_id").alias("cache")).agg(F.array_join(F.transform(rows, lambda x: x["a"]), ",").alias("snapshot"))


@_query(_with(PLAN_SQL, f"""SELECT asset_id, track_id, segment_index, CASE WHEN bytes > {MAX_SEGMENT_BYTES} THEN 'too many bytes' WHEN end_sample - first_sample > {MAX_SEGMENT_SAMPLES} THEN 'too many samples' ELSE 'ok' END AS outcome FROM sized"""))
def segment_limits(spark, sf_dir: str) -> DataFrame:
    """Segments against the limits on their bytes and samples."""
    s = samples(spark, sf_dir, reuse=True)
    outcome = F.when(F.col("bytes") > MAX_SEGMENT_BYTES, "too many bytes").when(F.col("end_sample") - F.col("first_sample") > MAX_SEGMENT_SAMPLES, "too many samples").otherwise("ok")
    return segment_bytes(s, segment_plan(s)).select("asset_id", "track_id", "segment_index", outcome.alias("outcome"))


@_query(_with(PLAN_SQL + SUBTITLES_SQL + CLIPS_SQL, """SELECT sequence, count(*) AS clips, sum(tracks)::BIGINT AS tracks, sum(segments)::BIGINT AS segments, sum(captions)::BIGINT AS captions, sum(seconds)::BIGINT AS seconds FROM (SELECT sequence, c.asset_id, (SELECT count(*) FROM tr WHERE tr.asset_id = c.asset_id) AS tracks,
  (SELECT max(segment_index) + 1 FROM plan WHERE plan.asset_id = c.asset_id) AS segments, (SELECT count(*) FROM su WHERE su.asset_id = c.asset_id) AS captions, (SELECT max((end_time - first_time + timescale - 1) // timescale) FROM tr WHERE tr.asset_id = c.asset_id) AS seconds FROM cp c) GROUP BY sequence"""))
def sequence_status(spark, sf_dir: str) -> DataFrame:
    """Counts of a sequence's clips, tracks, segments and captions, and its length in whole seconds a clip."""
    s = samples(spark, sf_dir, reuse=True)
    plan, m = segment_plan(s), media(tracks(s))
    own = m.groupBy("asset_id").agg(F.count(F.lit(1)).alias("tracks"), F.max(F.expr("(end_time - first_time + timescale - 1) div timescale")).alias("seconds"))
    segments = plan.groupBy("asset_id").agg((F.max("segment_index") + 1).alias("segments"))
    captions = subtitles(own.select("asset_id")).groupBy("asset_id").agg(F.count(F.lit(1)).alias("captions"))
    each = clip_places(plan, m).join(own, "asset_id").join(segments, "asset_id").join(captions, "asset_id", "left")
    return each.groupBy("sequence").agg(F.count(F.lit(1)).alias("clips"), F.sum("tracks").alias("tracks"), F.sum("segments").alias("segments"), F.coalesce(F.sum("captions"), F.lit(0)).alias("captions"), F.sum("seconds").alias("seconds"))


SQL["sequence_status"] = SQL["sequence_status"].replace("sum(captions)::BIGINT AS captions", "coalesce(sum(captions), 0)::BIGINT AS captions")


@_query(f"{_SPAN_SQL}, fl AS (SELECT a.event_id, a.route, count(b.event_id) AS others FROM sp a LEFT JOIN sp b ON a.route = b.route AND b.event_id <> a.event_id AND b.t <= a.t AND b.u > a.t GROUP BY a.event_id, a.route) SELECT route, count(*) FILTER (others > 0) AS coalesced FROM fl GROUP BY route")
def coalesced_waiters(spark, sf_dir: str) -> DataFrame:
    """Requests that find another one of their route in flight: the running count before each start, no join of intervals."""
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    both = requests(spark, sf_dir).join(e, "event_id")
    # requests that start together see each other: first ends, then all starts of that time are counted
    starts = both.groupBy("route", "t").agg(F.count(F.lit(1)).alias("d")).withColumn("late", F.lit(1))
    ends = both.where("micros > 0").groupBy("route", (F.col("t") + F.col("micros") * 1000).alias("t")).agg((-F.count(F.lit(1))).alias("d")).withColumn("late", F.lit(0))
    empty = both.where("micros = 0").groupBy("route", "t").agg((-F.count(F.lit(1))).alias("d")).withColumn("late", F.lit(2))
    run = running_before(starts.unionByName(ends).unionByName(empty), ["t", "late"], "d", "before", ["route"])
    return run.where("late = 1").groupBy("route").agg(F.coalesce(F.sum(F.when(F.col("before") + F.col("d") > 1, F.col("d"))), F.lit(0)).cast("bigint").alias("coalesced"))


@_query(_with(PLAN_SQL + CLIPS_SQL, "SELECT sequence, sum(bytes)::BIGINT AS payload, count(DISTINCT asset_id) AS files FROM sized JOIN cp USING (asset_id) GROUP BY sequence"))
def sequence_bytes(spark, sf_dir: str) -> DataFrame:
    """The payload of all clips of a sequence."""
    s = samples(spark, sf_dir, reuse=True)
    plan = segment_plan(s)
    return segment_bytes(s, plan).join(clip_places(plan, media(tracks(s))), "asset_id").groupBy("sequence").agg(F.sum("bytes").alias("payload"), F.countDistinct("asset_id").alias("files"))


#: How long an answer, a refusal and an error are believed, and when an answer is too old for anything, in microseconds.
GOOD_US, NOT_FOUND_US, ERROR_US, HARD_US = 12 * 3_600_000_000, 3_600_000_000, 24 * 3_600_000_000, 96 * 3_600_000_000


@_query(f"""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events), w AS (SELECT *, max(CASE WHEN event_type IN ('purchase', 'signup') THEN us * 2 + (event_type = 'purchase')::INT END) OVER v AS answered, max(us) FILTER (event_type = 'click') OVER v AS failed
  FROM e WINDOW v AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), a AS (SELECT *, us - answered // 2 AS age, answered % 2 = 1 AS good FROM w)
SELECT event_id, CASE WHEN answered IS NULL THEN 'miss' WHEN NOT good THEN CASE WHEN age <= {NOT_FOUND_US} THEN 'negative_hit' ELSE 'miss' END WHEN age <= {GOOD_US} THEN 'hit' WHEN age > {HARD_US} THEN 'expired' WHEN failed >= answered // 2 AND us - failed <= {ERROR_US} THEN 'stale' ELSE 'revalidate' END AS state FROM a""")
def cache_outcomes(spark, sf_dir: str) -> DataFrame:
    """Each request against what its user's catalog said last: an answer, a refusal, or an error since, for which an old answer may still be served."""
    before = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("event_type")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    answer = F.when(kind.isin("purchase", "signup"), F.struct("us", (kind == "purchase").alias("good")))
    w = e.select("event_id", "us", F.max(answer).over(before).alias("a"), F.max(F.when(kind == "click", F.col("us"))).over(before).alias("failed"))
    age = F.col("us") - F.col("a.us")
    stale = F.coalesce((F.col("failed") >= F.col("a.us")) & (F.col("us") - F.col("failed") <= ERROR_US), F.lit(False))
    good = F.when(age <= GOOD_US, "hit").when(age > HARD_US, "expired").when(stale, "stale").otherwise("revalidate")
    return w.select("event_id", F.when(F.col("a").isNull(), "miss").when(F.col("a.good"), good).when(age <= NOT_FOUND_US, "negative_hit").otherwise("miss").alias("state"))


@_query(_with(PLAN_SQL + MEDIA_SQL + SUBTITLES_SQL + SEGMENT_LINES_SQL, f"""SELECT asset_id, (ix.bytes + pb.bytes + coalesce(sb.bytes, 0))::BIGINT AS bytes FROM (SELECT asset_id, sum(bytes) AS bytes FROM ({{index}}) GROUP BY asset_id) ix JOIN (SELECT asset_id, sum(strlen(body)) AS bytes FROM ({MEDIA_PLAYLIST_SQL}) GROUP BY asset_id) pb USING (asset_id)
  LEFT JOIN (SELECT asset_id, sum(strlen(label) * 1000) AS bytes FROM su GROUP BY asset_id) sb USING (asset_id)""".replace("{index}", INDEX_SELECT)))
def asset_memory(spark, sf_dir: str) -> DataFrame:
    """What an asset keeps in memory: the indexes of its tracks, its rendered playlists, and its captions (a thousand bytes a letter of their label)."""
    s, plan, m, _ = _prepared(spark, sf_dir)
    index = index_bytes(spark, sf_dir).groupBy("asset_id").agg(F.sum("bytes").alias("i"))
    rendered = media_playlists(s, plan, m).groupBy("asset_id").agg(F.sum(F.octet_length("body")).alias("r"))
    captions = subtitles(m.select("asset_id").distinct()).groupBy("asset_id").agg(F.sum(F.octet_length("label") * 1000).alias("c"))
    both = index.join(rendered, "asset_id").join(captions, "asset_id", "left")
    return both.select("asset_id", (F.col("i") + F.col("r") + F.coalesce("c", F.lit(0))).cast("bigint").alias("bytes"))


# fixed values: what comes before the key in its encoding, and how many bytes the key has
KEY_PREFIXES = {"ES256": ("3059301306072a8648ce3d020106082a8648ce3d030107034200", 65), "EdDSA": ("302a300506032b6570032100", 32)}
_KEY_INPUT = """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'HS256' WHEN 1 THEN 'ES256' ELSE 'EdDSA' END AS algorithm, c_custkey % 7 AS v, substr(concat(sha2_a, sha2_b, sha2_c), 1, CASE c_custkey % 3 WHEN 1 THEN 130 ELSE 64 END) AS key_hex FROM (SELECT c_custkey, sha256('a' || c_custkey) AS sha2_a, sha256('b' || c_custkey) AS sha2_b, sha256('c' || c_custkey) AS sha2_c FROM customer)"""


@_query(f"""WITH k AS ({_KEY_INPUT}), d AS (SELECT *, CASE algorithm WHEN 'ES256' THEN '{KEY_PREFIXES['ES256'][0]}' ELSE '{KEY_PREFIXES['EdDSA'][0]}' END AS prefix, CASE WHEN v = 5 AND algorithm = 'ES256' THEN '03' || key_hex[3:] WHEN algorithm = 'ES256' THEN '04' || key_hex[3:] ELSE key_hex END AS body FROM k)
SELECT id, CASE WHEN algorithm = 'HS256' THEN CASE WHEN v < 3 THEN 'short secret' ELSE 'ok' END WHEN v = 1 THEN 'no key' WHEN v = 2 THEN 'no key' WHEN v = 3 THEN 'no key' WHEN v = 4 THEN 'no key' WHEN algorithm = 'ES256' AND v = 5 THEN 'compressed' ELSE 'ok' END AS outcome,
  CASE WHEN algorithm = 'HS256' THEN NULL WHEN v IN (1, 2, 3, 4) OR algorithm = 'ES256' AND v = 5 THEN NULL ELSE body END AS key_hex FROM d""")
def token_keys(spark, sf_dir: str) -> DataFrame:
    """Secrets long enough, and public keys read from their text form: four of seven are broken (one line too many, a byte too few, another kind, no end)."""
    source = table(spark, sf_dir, "customer")
    sha = lambda c: F.sha2(F.concat(F.lit(c), F.col("c_custkey").cast("string")), 256)
    k = F.col("c_custkey")
    algorithm = F.get(F.array(*map(F.lit, ("HS256", "ES256", "EdDSA"))), (k % 3).cast("int"))
    length = F.when(k % 3 == 1, 130).otherwise(64)
    base = source.select(k.alias("id"), algorithm.alias("algorithm"), (k % 7).alias("v"), F.substring(F.concat(sha("a"), sha("b"), sha("c")), F.lit(1), length).alias("key"))
    v, own = F.col("v"), F.col("key")
    point = F.when(v == 5, "03").otherwise("04")
    own = F.when(F.col("algorithm") == "ES256", F.concat(point, F.substring(own, 3, 200))).otherwise(own)
    prefix = F.when((F.col("algorithm") == "ES256") == (v != 3), KEY_PREFIXES["ES256"][0]).otherwise(KEY_PREFIXES["EdDSA"][0])
    der = F.unhex(F.concat(prefix, F.when(v == 2, F.substring(own, 1, 60)).otherwise(own)))
    pem = F.concat(F.lit("-----BEGIN PUBLIC KEY-----\n"), F.base64(der), F.when(v == 4, "\n").otherwise("\n-----END PUBLIC KEY-----\n"), F.when(v == 1, " more\n").otherwise("\n"))
    secret = F.when(v < 3, "a short secret").otherwise(F.concat(F.lit("a secret of many more bytes, "), own))
    given = base.select("id", "algorithm", F.when(F.col("algorithm") == "HS256", secret).otherwise(pem).alias("material"))
    return parse_token_keys(given).select("id", "outcome", "key_hex")


def parse_token_keys(given: DataFrame) -> DataFrame:
    """given (with algorithm and material) with outcome and key_hex."""
    lines = F.filter(F.transform(F.split("material", "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    step = given.withColumn("_lines", lines).withColumn("_n", F.size("_lines"))
    framed = (F.get("_lines", F.lit(0)) == "-----BEGIN PUBLIC KEY-----") & (F.element_at("_lines", -1) == "-----END PUBLIC KEY-----") & (F.size(F.filter("_lines", lambda x: x.startswith("-----"))) == 2)
    text = F.when((F.col("_n") >= 2) & framed, F.array_join(F.slice(F.col("_lines"), F.lit(2), F.greatest(F.col("_n") - 2, F.lit(0))), ""))
    step = step.withColumn("_der", F.lower(F.hex(F.try_to_binary(text, F.lit("base64")))))
    prefix = F.element_at(F.create_map(*[F.lit(x) for a, (p, _) in KEY_PREFIXES.items() for x in (a, p)]), F.col("algorithm"))
    size = F.element_at(F.create_map(*[F.lit(x) for a, (_, n) in KEY_PREFIXES.items() for x in (a, n)]), F.col("algorithm"))
    step = step.withColumn("_prefix", prefix).withColumn("_size", size)
    fits = F.startswith("_der", F.col("_prefix")) & (F.length("_der") == F.length("_prefix") + 2 * F.col("_size"))
    key = F.when(F.coalesce(fits, F.lit(False)), F.substring(F.col("_der"), F.length("_prefix") + 1, 2 * F.col("_size")))
    step = step.withColumn("_key", key)
    secret = F.col("algorithm") == "HS256"
    outcome = (
        F.when(secret, F.when(F.octet_length("material") < 32, "short secret").otherwise("ok")).when(F.col("_key").isNull(), "no key")
        .when((F.col("algorithm") == "ES256") & ~F.startswith("_key", F.lit("04")), "compressed").otherwise("ok")
    )
    step = step.withColumn("outcome", outcome)
    return step.select(*given.columns, "outcome", F.when(~secret & (F.col("outcome") == "ok"), F.col("_key")).alias("key_hex"))
