"""Requests, answers and captions: cache states, headers, policies and cue shifts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.text import cue_time
from tickloom.plans.catalog import _CUE_SQL, _TIME, _cues
from tickloom.sources.views import table

#: Time to live of a cached answer, and what is added to a cue's times, in microseconds and milliseconds.
TTL_US, SHIFT_MS = 6 * 3_600_000_000, -2500

Q: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@_query(f"""SELECT event_id, CASE WHEN answered IS NULL THEN 'miss' WHEN us - answered <= {TTL_US} THEN 'hit' WHEN us - answered <= {2 * TTL_US} THEN 'stale' ELSE 'expired' END AS state
  FROM (SELECT event_id, epoch_us(ts) AS us, max(epoch_us(ts)) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS answered FROM events)""")
def cache_state(spark, sf_dir: str) -> DataFrame:
    """Each request against the last answer (a purchase of the same user) before it: one window, no range join."""
    before = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    aged = e.select("event_id", (F.col("us") - F.max(F.when(F.col("event_type") == "purchase", F.col("us"))).over(before)).alias("age"))
    return aged.select("event_id", F.when(F.col("age").isNull(), "miss").when(F.col("age") <= TTL_US, "hit").when(F.col("age") <= 2 * TTL_US, "stale").otherwise("expired").alias("state"))


@_query("SELECT o_orderkey AS id, greatest(ttl - 60, ttl // 2)::BIGINT AS refresh_in FROM (SELECT o_orderkey, (o_custkey % 1000)::BIGINT AS ttl FROM orders)")
def refresh_deadline(spark, sf_dir: str) -> DataFrame:
    """When an answer is asked for anew: a minute before it ends, but not before half its time."""
    ttl = F.col("o_custkey") % 1000
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.greatest(ttl - 60, F.expr("(o_custkey % 1000) div 2")).cast("bigint").alias("refresh_in"))


@_query("SELECT o_custkey AS list, o_orderkey AS id, coalesce(o_orderdate > lag(o_orderdate) OVER w, true) AS later, coalesce(o_orderpriority <> lag(o_orderpriority) OVER w, true) AS new_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def period_monotonic(spark, sf_dir: str) -> DataFrame:
    """Periods of a list have to start later than the one before and change the key."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    later, new = F.col("o_orderdate") > F.lag("o_orderdate").over(w), F.col("o_orderpriority") != F.lag("o_orderpriority").over(w)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("list"), F.col("o_orderkey").alias("id"), F.coalesce(later, F.lit(True)).alias("later"), F.coalesce(new, F.lit(True)).alias("new_key"))


@_query("SELECT host, count(*) AS n FROM (SELECT lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS host FROM pages) GROUP BY host HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir: str) -> DataFrame:
    """Hosts that more than one page names, whatever their case."""
    host = F.lower(F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1))
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@_query("SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'scheme' WHEN regexp_matches(url, '^[^/]*//[^/?#]*@') THEN 'credentials' WHEN regexp_matches(url, '^[^/]*//[0-9.]+([:/?#]|$)') THEN 'literal address' ELSE 'ok' END AS verdict FROM pages")
def location_policy(spark, sf_dir: str) -> DataFrame:
    """The first rule on locations that a url breaks."""
    url = F.col("url")
    verdict = F.when(~url.rlike("^https?://"), "scheme").when(url.rlike("^[^/]*//[^/?#]*@"), "credentials").when(url.rlike("^[^/]*//[0-9.]+([:/?#]|$)"), "literal address").otherwise("ok")
    return table(spark, sf_dir, "pages").select("page_id", verdict.alias("verdict"))


_HEADER_SQL = "CASE doc_id % 3 WHEN 0 THEN concat('bytes=', doc_id % 500, '-', doc_id % 500 + 99) WHEN 1 THEN concat('bytes=', doc_id % 500, '-') ELSE concat('bytes=-', doc_id % 500) END"
_RANGE_SQL = f"""SELECT doc_id, CASE WHEN ok THEN a END AS first, CASE WHEN ok THEN b END AS last, (CASE WHEN ok THEN 206 ELSE 416 END)::BIGINT AS status FROM (SELECT *, b >= a AND a < n AS ok FROM
  (SELECT doc_id, n, CASE WHEN x = '' THEN greatest(n - y::BIGINT, 0) ELSE x::BIGINT END AS a, CASE WHEN x = '' OR y = '' THEN n - 1 ELSE least(y::BIGINT, n - 1) END AS b FROM
  (SELECT doc_id, coalesce(n_chars, 0) AS n, regexp_extract(h, '^bytes=([0-9]*)-', 1) AS x, regexp_extract(h, '-([0-9]*)$', 1) AS y FROM (SELECT doc_id, n_chars, {_HEADER_SQL} AS h FROM documents))))"""


@_query(_RANGE_SQL)
def range_header(spark, sf_dir: str) -> DataFrame:
    """Byte range headers (first-last, first-, -suffix) against the length: the bytes to send, or 416."""
    at = (F.col("doc_id") % 500).cast("string")
    header = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("bytes="), at, F.lit("-"), (F.col("doc_id") % 500 + 99).cast("string"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("bytes="), at, F.lit("-"))).otherwise(F.concat(F.lit("bytes=-"), at))
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).cast("bigint").alias("n"), F.regexp_extract(header, "^bytes=([0-9]*)-", 1).alias("x"), F.regexp_extract(header, "-([0-9]*)$", 1).alias("y"))
    x, y = (F.expr(f"try_cast({c} as bigint)") for c in "xy")
    first = F.when(F.col("x") == "", F.greatest(F.col("n") - y, F.lit(0).cast("bigint"))).otherwise(x)
    last = F.when((F.col("x") == "") | (F.col("y") == ""), F.col("n") - 1).otherwise(F.least(y, F.col("n") - 1))
    d = d.select("doc_id", "n", first.alias("a"), last.alias("b")).withColumn("ok", (F.col("b") >= F.col("a")) & (F.col("a") < F.col("n")))
    return d.select("doc_id", F.when(F.col("ok"), F.col("a")).alias("first"), F.when(F.col("ok"), F.col("b")).alias("last"), F.when(F.col("ok"), 206).otherwise(416).cast("bigint").alias("status"))


@_query("""SELECT page_id, h = '*' OR list_contains(list_transform(string_split(h, ','), lambda x: regexp_replace(trim(x), '^W/', '')), concat('"', page_id, '"')) AS matches FROM
  (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '*' WHEN 1 THEN concat('"a", W/"', page_id, '"') WHEN 2 THEN concat('"', page_id, '"') ELSE '"b"' END AS h FROM pages)""")
def etag_match(spark, sf_dir: str) -> DataFrame:
    """If-None-Match lists, compared weakly."""
    own = F.concat(F.lit('"'), F.col("page_id").cast("string"), F.lit('"'))
    k = F.col("page_id") % 4
    header = F.when(k == 0, "*").when(k == 1, F.concat(F.lit('"a", W/'), own)).when(k == 2, own).otherwise('"b"')
    tags = F.transform(F.split(header, ","), lambda x: F.regexp_replace(F.trim(x), "^W/", ""))
    return table(spark, sf_dir, "pages").select("page_id", ((header == "*") | F.exists(tags, lambda x: x == own)).alias("matches"))


@_query(f"""WITH {_CUE_SQL} SELECT conv_id, turn, text, {_TIME.format('a')} || ' --> ' || {_TIME.format('b')} AS timing
  FROM (SELECT conv_id, turn, text, greatest(start_ms + {SHIFT_MS}, 0) AS a, end_ms + {SHIFT_MS} AS b FROM cu) WHERE b > 0""")
def cue_shift(spark, sf_dir: str) -> DataFrame:
    """Cues moved in time; what ends by zero goes, what starts before it starts at zero."""
    moved = _cues(spark, sf_dir).withColumn("a", F.greatest(F.col("start_ms") + SHIFT_MS, F.lit(0))).withColumn("b", F.col("end_ms") + SHIFT_MS).where("b > 0")
    return moved.select("conv_id", "turn", "text", F.concat(cue_time(F.col("a")), F.lit(" --> "), cue_time(F.col("b"))).alias("timing"))
