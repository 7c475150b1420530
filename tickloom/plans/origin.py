"""What an origin decides a request or an answer at a time, each with its SQL.

Headers and paths aren't in the test tables.  Such queries give every page a combination of hand-made
arguments, and their SQL has the rule again; the tests have the results of cases by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import origin as f
from tickloom.functions.exact import ceil_div, rescale
from tickloom.plans.catalog import _CUE_SQL, _cues, _with
from tickloom.sources.views import SAMPLES_SQL, samples, table, tracks

Q: dict = {}
SQL: dict[str, str] = {}

MAX_LISTED, STYLE_DEPTH = 1000, 8


def _query(sql: str):
    def add(g):
        Q[g.__name__], SQL[g.__name__] = g, sql
        return g

    return add


def _literal(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower()


def _crossed(name: str, result: str, function, values: list[list], rule: str, kind: str = "string") -> None:
    """A rule on every page: its arguments run through all combinations of their values; rule is the same on a0, a1, ... in SQL."""
    sql_kind = {"string": "VARCHAR"}
    columns, parts, stride = [], [], 1
    for i, own in enumerate(values):
        columns.append(lambda own=own, stride=stride: F.get(F.array(*[F.lit(x).cast("string") if x is None else F.lit(x) for x in own]), (F.expr(f"page_id div {stride}") % len(own)).cast("int")))
        parts.append(f"[{', '.join(map(_literal, own))}][page_id // {stride} % {len(own)} + 1] AS a{i}")
        stride *= len(own)

    def run(spark, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "pages").select("page_id", function(*[c() for c in columns]).cast(kind).alias(result))

    Q[name] = run
    SQL[name] = f"SELECT page_id, CAST({rule} AS {sql_kind.get(kind, kind)}) AS {result} FROM (SELECT page_id, {', '.join(parts)} FROM pages)"


_crossed("validator_choice", "validator", f.validator, [['"a"', 'W/"a"', None, '"b"'], ["Mon", None, "Tue"]], "CASE WHEN a0 IS NOT NULL AND NOT starts_with(a0, 'W/') THEN a0 ELSE a1 END")
_RANGE = "TRY_CAST(regexp_extract(a0, '^bytes ([0-9]+)-([0-9]+)/([0-9]+)$', {}) AS BIGINT)"
_crossed(
    "content_range", "total", f.content_range_total,
    [["bytes 0-9/100", "bytes 0-9/10", "bytes 0-9/9", "bytes 1-9/100", "bytes 0-9/*", "items 0-9/100", None, "bytes 0-9/99999999999999999999", "bytes 5-20/21", " bytes 0-9/100"], [0, 1, 5], [9, 20]],
    f"CASE WHEN {_RANGE.format(1)} = a1 AND {_RANGE.format(2)} = a2 AND {_RANGE.format(3)} > a2 THEN {_RANGE.format(3)} END", "bigint",
)

_V4 = r"regexp_full_match({0}, '[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}') AND list_max(list_transform(string_split({0}, '.'), lambda x: TRY_CAST(x AS INT))) <= 255"
_OPEN_V4 = """NOT (p[1] IN (0, 10, 127) OR p[1] >= 224 OR (p[1] = 100 AND p[2] // 64 = 1) OR (p[1] = 169 AND p[2] = 254) OR (p[1] = 172 AND p[2] // 16 = 1) OR (p[1] = 192 AND p[2] = 168) OR (p[1] = 192 AND p[2] = 0 AND p[3] IN (0, 2)) OR (p[1] = 198 AND p[2] // 2 = 9)
  OR (p[1] = 198 AND p[2] = 51 AND p[3] = 100) OR (p[1] = 203 AND p[2] = 0 AND p[3] = 113))"""
_ADDRESSES = [
    "8.8.8.8", "10.1.2.3", "100.64.0.1", "100.128.0.1", "172.31.255.255", "172.32.0.0", "198.19.0.1", "198.20.0.1", "192.0.1.1", "192.0.2.7", "203.0.113.9", "255.255.255.255", "223.255.255.255", "0.1.2.3", "127.0.0.1", "169.254.169.254", "1.2.3.256", "host", None,
    "::1", "::", "::2", "fe80::1", "febf::1", "fec0::1", "fc00::1", "fdff::1", "ff02::1", "2606:4700:4700::1111", "2001:db8::5", "2001:db9::5", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::FFFF:808:808", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "1:2:3:4:5:6:7::", "12345::1", "g::1", ":1:2:3:4:5:6:7", "::ffff:1.2.3.300",
]


@_query(rf"""WITH a AS (SELECT page_id, [{', '.join(map(_literal, _ADDRESSES))}][page_id % {len(_ADDRESSES)} + 1] AS t FROM pages), b AS (SELECT *, CASE WHEN contains(t, ':') THEN regexp_extract(t, ':([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$', 1) END AS d FROM a),
c AS (SELECT *, CASE WHEN d <> '' THEN CASE WHEN {_V4.format('d')} THEN list_transform(string_split(d, '.'), lambda x: x::INT) END END AS q FROM b),
e AS (SELECT *, lower(CASE WHEN d <> '' THEN left(t, length(t) - length(d)) || printf('%x:%x', (q[1] * 256 + q[2])::BIGINT, (q[3] * 256 + q[4])::BIGINT) ELSE t END) AS u FROM c),
g AS (SELECT *, string_split(u, '::') AS s, CASE WHEN string_split(u, '::')[1] = '' THEN []::VARCHAR[] ELSE string_split(string_split(u, '::')[1], ':') END AS l, CASE WHEN string_split(u, '::')[2] = '' THEN []::VARCHAR[] ELSE string_split(string_split(u, '::')[2], ':') END AS r FROM e),
h AS (SELECT *, CASE WHEN len(s) = 1 THEN string_split(u, ':') WHEN len(s) = 2 AND len(l) + len(r) <= 7 THEN list_concat(list_concat(l, list_resize([]::VARCHAR[], 8 - len(l) - len(r), '0')), r) END AS w FROM g),
k AS (SELECT page_id, t, CASE WHEN len(w) = 8 AND len(list_filter(w, lambda x: regexp_full_match(x, '[0-9a-f]{{1,4}}'))) = 8 THEN list_transform(w, lambda x: ('0x' || x)::BIGINT) END AS n FROM h),
m AS (SELECT *, CASE WHEN contains(t, ':') THEN CASE WHEN list_sum(n[1:5]) = 0 AND n[6] = 65535 THEN [n[7] // 256, n[7] % 256, n[8] // 256, n[8] % 256] END WHEN {_V4.format('t')} THEN list_transform(string_split(t, '.'), lambda x: x::BIGINT) END AS p FROM k)
SELECT page_id, CASE WHEN p IS NOT NULL THEN {_OPEN_V4} WHEN contains(t, ':') AND n IS NOT NULL THEN NOT ((list_sum(n[1:7]) = 0 AND n[8] <= 1) OR n[1] // 256 = 255 OR n[1] // 512 = 126 OR n[1] // 64 = 1018 OR (n[1] = 8193 AND n[2] = 3512)) END AS is_public FROM m""")
def public_address(spark, sf_dir: str) -> DataFrame:
    """Whether an address may be fetched from: both kinds, and one mapped into the other."""
    address = F.get(F.array(*[F.lit(x).cast("string") for x in _ADDRESSES]), (F.col("page_id") % len(_ADDRESSES)).cast("int"))
    return f.public_addresses(table(spark, sf_dir, "pages").select("page_id", address.alias("a")), "a", "is_public").drop("a")


_ITEMS = r"""list_transform(string_split(coalesce(a0, ''), ','), lambda x: {'c': lower(trim(string_split(x, ';')[1])), 'q': list_filter(list_transform(string_split(x, ';')[2:], lambda y: trim(y)), lambda y: regexp_matches(y, '^[qQ]\s*='))[-1]})"""
_OK = r"(y.q IS NULL OR coalesce(TRY_CAST(regexp_replace(y.q, '^[^=]*=\s*', '') AS DOUBLE) > 0, false))"


def _said(codings: str) -> str:
    return f"list_transform(list_filter({_ITEMS}, lambda y: y.c IN ({codings})), lambda y: {_OK})[-1]"


_crossed(
    "encoding_negotiation", "encoding", f.negotiated,
    [["gzip, br", "gzip;q=1, br;q=0", "x-gzip", "*", "*, br;q=0", "*;q=0", "BR ; Q = 0.1", "br;q=x", "br;q=0;q=1", "br, br;q=0", "", None, "identity, gzip;q=0.000", "deflate, GZIP;q=0.5", "*;q=0, gzip", "br;level=5;q=0, *"]],
    f"""CASE WHEN coalesce({_said("'br'")}, {_said("'*'")}, false) THEN 'br' WHEN coalesce({_said("'gzip', 'x-gzip'")}, {_said("'*'")}, false) THEN 'gzip' ELSE 'identity' END""",
)
_crossed(
    "path_resources", "resource", lambda p, q: F.to_json(f.resource(F.concat(p, q))), [["/hls/a", "/dash/b", "/hls/", "/other/a", "hls/a", "/HLS/a"], ["", "/master.m3u8", "/video-hd/x", "/subtitles/en/index.m3u8", "/video-/y", "/subtitles"]],
    r"""CASE WHEN string_split(a0 || a1, '/')[1] = '' AND string_split(a0 || a1, '/')[2] IN ('hls', 'dash') AND coalesce(string_split(a0 || a1, '/')[3], '') <> '' THEN '{"asset":"' || string_split(a0 || a1, '/')[3] || '"' ||
  CASE WHEN starts_with(string_split(a0 || a1, '/')[4], 'video-') THEN ',"rendition":"' || string_split(a0 || a1, '/')[4][7:] || '"' ELSE '' END || CASE WHEN string_split(a0 || a1, '/')[4] = 'subtitles' AND len(string_split(a0 || a1, '/')) > 4 THEN ',"subtitle":"' || string_split(a0 || a1, '/')[5] || '"' ELSE '' END || '}' END""",
)
_AMONG = "trim(regexp_replace(list_filter(list_transform(string_split({0}, '{1}'), lambda x: trim(x)), lambda x: starts_with(x, 'token='))[1], '^[^=]*=', ''))"
_crossed(
    "token_transport", "token", f.carried_token, [["Bearer  t1 ", "Basic x", None, "bearer t4", "Bearer"], ["token=t2", "a=1; token=t2", "tokens=1", None, "token=a=b"], ["token=t3", "a=b&token=t3", None]],
    f"coalesce(CASE WHEN regexp_matches(a0, '^[bB][eE][aA][rR][eE][rR] ') THEN trim(regexp_replace(a0, '^[^ ]* ', '')) END, {_AMONG.format('a1', ';')}, {_AMONG.format('a2', '&')})",
)
_crossed("error_classes", "status", f.error_status, [["not found", "upstream", "location rejected", "unavailable", "invalid media", None]], "CASE a0 WHEN 'not found' THEN 404 WHEN 'upstream' THEN 502 WHEN 'location rejected' THEN 502 WHEN 'unavailable' THEN 503 ELSE 500 END", "bigint")
_crossed("known_languages", "language", f.known_language, [["eng", "und", "EN", "deu", "en1", None, "engl", "fr"]], "CASE WHEN regexp_full_match(a0, '[a-z]{3}') AND a0 <> 'und' THEN a0 END")
_crossed("fourcc_text", "text", lambda a, b: f.printable(F.concat(a, b)), [["avc", "a\x01b", "mp4", "  ~"], ["1", "\x7f", "é", " "]], "regexp_replace(a0 || a1, '[^ -~]', '?', 'g')")
_crossed("avc_codecs", "codec", f.avc_codec, [[100, 66, 77, 88], [0, 192, 64], [31, 30, 10, 51]], "printf('avc1.%02x%02x%02x', a0, a1, a2)")
_FLAGS = "list_reverse(string_split(printf('%032b', a2::BIGINT), ''))"
_crossed(
    "hevc_codecs", "codec", f.hevc_codec, [["hvc1", "hev1"], [1, 0x22, 0x41, 0xE4], [0x60000000, 0x20000000, 1, 6], ["900000000000", "b00000000000", "000000000000", "900100000000", "0a0000000010"], [60, 93, 120]],
    f"""a0 || '.' || ['', 'A', 'B', 'C'][a1 // 64 + 1] || (a1 % 32) || '.' || printf('%X', list_sum(list_transform({_FLAGS}, lambda x, i: CASE x WHEN '1' THEN (1::BIGINT << (32 - i)) ELSE 0 END))::BIGINT) || '.' || CASE a1 // 32 % 2 WHEN 0 THEN 'L' ELSE 'H' END || a4
  || list_aggregate(list_transform(range(coalesce(list_max(list_filter(range(1, 7), lambda i: a3[2 * i - 1:2 * i] <> '00')), 0)), lambda i: '.' || printf('%X', ('0x' || a3[2 * i + 1:2 * i + 2])::BIGINT)) || [''], 'string_agg', '')""",
)


@_query("SELECT c_custkey AS id, concat(chr(((p >> 10) & 31)::INT + 96), chr(((p >> 5) & 31)::INT + 96), chr((p & 31)::INT + 96)) AS language FROM (SELECT c_custkey, (c_custkey * 37 % 32768)::BIGINT AS p FROM customer)")
def packed_languages(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), f.packed_language(F.col("c_custkey") * 37 % 32768).alias("language"))


@_query(f"SELECT DISTINCT source AS id FROM documents WHERE regexp_matches(source, '^[A-Za-z0-9_-]{{1,128}}$') ORDER BY id LIMIT {MAX_LISTED}")
def catalog_listing(spark, sf_dir: str) -> DataFrame:
    """Valid ids of a listing, once each and in order; the cap is the listing's own."""
    return table(spark, sf_dir, "documents").where(F.col("source").rlike("^[A-Za-z0-9_-]{1,128}$")).select(F.col("source").alias("id")).distinct().orderBy("id").limit(MAX_LISTED)


@_query("SELECT conv_id, CASE WHEN count(DISTINCT lower(role)) < count(*) THEN 'language twice' WHEN max(length(text)) > 200 THEN 'label too long' WHEN count(*) FILTER (turn = 0) > 1 THEN 'two defaults' ELSE 'ok' END AS outcome FROM conversations GROUP BY conv_id")
def subtitle_rules(spark, sf_dir: str) -> DataFrame:
    """Caption lists: a language once, whatever its case; labels of bounded length; one default."""
    twice, label, defaults = F.countDistinct(F.lower("role")) < F.count(F.lit(1)), F.max(F.length("text")) > 200, F.count_if(F.col("turn") == 0) > 1
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.when(twice, "language twice").when(label, "label too long").when(defaults, "two defaults").otherwise("ok").alias("outcome"))


@_query("""SELECT o_custkey AS asset, CASE WHEN count(DISTINCT o_orderkey % 10) < count(*) THEN 'id twice' WHEN count(*) FILTER (o_orderstatus = 'P') > 1 THEN 'two defaults' WHEN min(clips) <> max(clips) THEN 'clip counts differ' WHEN sum(clips) > 12 THEN 'too many files' ELSE 'ok' END AS outcome
  FROM (SELECT *, o_orderkey % 2 + 1 AS clips FROM orders) GROUP BY o_custkey""")
def rendition_rules(spark, sf_dir: str) -> DataFrame:
    """Renditions of an answer: ids once, one default, as many clips in each, and not too many files in all."""
    clips = F.col("o_orderkey") % 2 + 1
    twice, defaults = F.countDistinct(F.col("o_orderkey") % 10) < F.count(F.lit(1)), F.count_if(F.col("o_orderstatus") == "P") > 1
    outcome = F.when(twice, "id twice").when(defaults, "two defaults").when(F.min(clips) != F.max(clips), "clip counts differ").when(F.sum(clips) > 12, "too many files").otherwise("ok")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("asset")).agg(outcome.alias("outcome"))


_KEYS_SQL = "SELECT n_nationkey % 10 AS key_id, CASE WHEN n_nationkey < 10 THEN NULL WHEN n_nationkey < 15 THEN 'video' WHEN n_nationkey < 20 THEN 'audio' END AS kind, n_name AS key FROM nation WHERE n_nationkey < 20"


@_query(f"""WITH k AS ({_KEYS_SQL}), t AS (SELECT c_custkey AS track, c_nationkey % 12 AS key_id, CASE c_custkey % 2 WHEN 0 THEN 'video' ELSE 'audio' END AS kind FROM customer)
  SELECT track, coalesce((SELECT key FROM k WHERE k.key_id = t.key_id AND k.kind = t.kind), (SELECT key FROM k WHERE k.key_id = t.key_id AND k.kind IS NULL)) AS key FROM t""")
def track_keys(spark, sf_dir: str) -> DataFrame:
    """The key of each track: one for its kind of track before one for any."""
    n = F.col("n_nationkey")
    keys = table(spark, sf_dir, "nation").where(n < 20).select((n % 10).alias("key_id"), F.when(n >= 15, "audio").when(n >= 10, "video").alias("own_kind"), F.col("n_name").alias("key"))
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track"), (F.col("c_nationkey") % 12).alias("key_id"), F.when(F.col("c_custkey") % 2 == 0, "video").otherwise("audio").alias("kind"))
    fits = (t.key_id == keys.key_id) & (keys.own_kind.isNull() | (keys.own_kind == t.kind))
    # false sorts before true: keys of a kind come first
    return t.join(keys, fits, "left").groupBy("track").agg(F.min_by("key", F.col("own_kind").isNull()).alias("key"))


@_query(f"""WITH RECURSIVE r AS (SELECT n_nationkey AS id, n_nationkey // 2 AS style, 1 AS depth FROM nation WHERE n_nationkey > 0
  UNION ALL SELECT id, style // 2, depth + 1 FROM r WHERE style > 0 AND depth < {STYLE_DEPTH}) SELECT id::BIGINT AS id, style::BIGINT AS style, depth::BIGINT AS depth FROM r""")
def style_references(spark, sf_dir: str) -> DataFrame:
    """Styles that refer to styles, STYLE_DEPTH deep at most: a join a level."""
    refs = table(spark, sf_dir, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").cast("bigint").alias("of"), F.expr("n_nationkey div 2").cast("bigint").alias("to"))
    level = refs.select(F.col("of").alias("id"), F.col("to").alias("style"), F.lit(1).cast("bigint").alias("depth"))
    found = level
    for _ in range(STYLE_DEPTH - 1):
        level = level.join(refs, level.style == refs.of).select("id", F.col("to").alias("style"), (F.col("depth") + 1).alias("depth"))
        found = found.unionByName(level)
    return found


@_query("SELECT o_orderkey AS id, left(sha256(concat('iv of ', o_orderkey)), 32) AS derived, right(concat(repeat('0', 32), lower(hex(o_orderkey))), 32) AS numbered FROM orders")
def segment_ivs(spark, sf_dir: str) -> DataFrame:
    """Sixteen bytes in hex: from a digest of the key id, and a number as 128 bits."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.left(F.sha2(F.concat(F.lit("iv of "), k.cast("string")), 256), F.lit(32)).alias("derived"), F.lower(F.lpad(F.hex(k), 32, "0")).alias("numbered"))


@_query(_with(SAMPLES_SQL, "SELECT asset_id, max(((end_time - first_time)::HUGEINT * 90000 // timescale)::BIGINT) AS duration FROM tr GROUP BY asset_id"))
def movie_duration(spark, sf_dir: str) -> DataFrame:
    """The longest track in the movie's scale."""
    return tracks(samples(spark, sf_dir)).groupBy("asset_id").agg(F.max(rescale(F.col("end_time") - F.col("first_time"), "timescale", 90_000)).alias("duration"))


_NL = "chr(10)"


@_query(f"""WITH {_CUE_SQL} SELECT conv_id, concat('#EXTM3U', {_NL}, '#EXT-X-VERSION:7', {_NL}, '#EXT-X-TARGETDURATION:', s, {_NL}, '#EXT-X-MEDIA-SEQUENCE:0', {_NL}, '#EXT-X-PLAYLIST-TYPE:VOD', {_NL}, '#EXTINF:', s, '.000,', {_NL}, 'sub.vtt?v=', conv_id, {_NL}, '#EXT-X-ENDLIST', {_NL}) AS playlist
  FROM (SELECT conv_id, greatest((coalesce(max(end_ms), 0) + 999) // 1000, 1) AS s FROM cu GROUP BY conv_id)""")
def subtitle_playlist(spark, sf_dir: str) -> DataFrame:
    """One caption file a conversation, as long as its last cue."""
    s = F.greatest(ceil_div(F.coalesce(F.max("end_ms"), F.lit(0)), 1000), F.lit(1).cast("bigint")).cast("string")
    per = _cues(spark, sf_dir).groupBy("conv_id").agg(s.alias("s"))
    lines = ["#EXTM3U", "#EXT-X-VERSION:7", "#EXT-X-TARGETDURATION:{s}", "#EXT-X-MEDIA-SEQUENCE:0", "#EXT-X-PLAYLIST-TYPE:VOD", "#EXTINF:{s}.000,", "sub.vtt?v={v}", "#EXT-X-ENDLIST", ""]
    text = F.replace(F.replace(F.lit("\n".join(lines)), F.lit("{s}"), F.col("s")), F.lit("{v}"), F.col("conv_id").cast("string"))
    return per.select("conv_id", text.alias("playlist"))


@_query("""SELECT l_orderkey AS asset, string_agg(l_returnflag, ',' ORDER BY first, l_returnflag) AS codecs FROM (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""")
def codecs_in_order(spark, sf_dir: str) -> DataFrame:
    """Distinct values in the order of their first appearance; what first appears together is in order of value."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.min("l_linenumber").alias("first"))
    return first.groupBy(F.col("l_orderkey").alias("asset")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "l_returnflag"))), lambda x: x["l_returnflag"]), ",").alias("codecs"))


@_query("SELECT o_custkey AS sequence, o_orderkey AS id, coalesce(o_orderpriority <> lag(o_orderpriority) OVER w, true) AS key_line, coalesce(o_orderstatus <> lag(o_orderstatus) OVER w, false) AS discontinuity FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def transition_lines(spark, sf_dir: str) -> DataFrame:
    """Where a playlist needs a new key line or a discontinuity: what differs from the neighbour before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    differs = lambda c, first: F.coalesce(F.col(c) != F.lag(c).over(w), F.lit(first))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sequence"), F.col("o_orderkey").alias("id"), differs("o_orderpriority", True).alias("key_line"), differs("o_orderstatus", False).alias("discontinuity"))
