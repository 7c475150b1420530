"""What an answer, a track or a request is refused for, each rule set with its SQL.

The tables have no such answers, so their fields follow from ids by expressions that both engines read (INPUTS);
the rules are written twice, as columns and as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ordered import ordered_scan
from tickloom.sources.views import table

Q: dict = {}
SQL: dict[str, str] = {}

# fixed values: limits of answers
MAX_CLIP_MS, MAX_CLIPS, MAX_SYSTEMS, MAX_SOURCE_KEYS, MAX_PERIODS, MAX_URI = 4_294_967_295, 4, 8, 16, 256, 2048

#: Name: (table, {column: expression that Spark and DuckDB read alike}).
INPUTS: dict[str, tuple[str, dict[str, str]]] = {
    "raw_tracks": ("part", {
        "track": "p_partkey", "file": "p_partkey % 97", "id": "p_partkey % 89", "samples": "p_size % 3", "descriptions": "CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE 1 END",
        "handler": "CASE p_partkey % 4 WHEN 0 THEN 'vide' WHEN 1 THEN 'soun' WHEN 2 THEN 'vide' ELSE 'text' END",
        "entry": "CASE p_partkey % 7 WHEN 0 THEN 'avc1' WHEN 1 THEN 'mp4a' WHEN 2 THEN 'png ' WHEN 3 THEN 'encv' WHEN 4 THEN 'hev1' WHEN 5 THEN 'tx3g' ELSE 'Opus' END",
        "has_sinf": "p_partkey % 3 = 0", "references": "CASE WHEN p_partkey % 13 = 0 THEN 2 ELSE 1 END", "own_data": "p_partkey % 17 <> 0",
    }),
    "wire_clips": ("orders", {
        "answer": "o_custkey", "place": "o_orderkey", "from_ms": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 1000 * 10 END",
        "to_ms": "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN 5000000000 ELSE o_orderkey % 37 * 300 END",
    }),
    "wire_keys": ("customer", {
        "answer": "c_custkey % 500", "place": "c_custkey", "key_id": "c_custkey % 3", "kind": "CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'all' WHEN 2 THEN 'video' WHEN 3 THEN 'audio' WHEN 4 THEN 'video' WHEN 5 THEN 'audio' WHEN 6 THEN 'text' ELSE 'all' END",
        "passthrough": "c_custkey % 500 % 23 = 0",
    }),
    "key_sets": ("orders", {
        "answer": "o_orderkey", "scheme": "CASE WHEN o_orderkey % 19 = 0 THEN 'cenc' ELSE 'cbcs' END", "clear_lead": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 * 4000 END", "n_periods": "CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 300 ELSE 0 END",
        "n_keys": "o_orderkey % 3", "url": "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'http://x.org/l' ELSE 'https://x.org/l' END", "uri": "CASE o_orderkey % 6 WHEN 0 THEN 'skd://a\"b' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'skd://key' END",
    }),
    "answers": ("orders", {
        "answer": "o_orderkey", "files": "1 + o_orderkey % 3", "tracks": "CASE WHEN o_orderkey % 4 = 0 THEN 'v1-a2' END", "rendition_clips": "o_orderkey % 5 = 0", "captions": "o_orderkey % 7 = 0", "keys": "o_orderkey % 11 = 0", "whole_keys": "o_orderkey % 13 = 0",
        "source_keys": "o_orderkey % 17 = 0", "clip_keys": "o_orderkey % 3 = 0", "clip_periods": "o_orderkey % 9 = 0", "rotating": "o_orderkey % 8 = 0", "kind": "CASE o_orderkey % 4 WHEN 0 THEN 'single' WHEN 1 THEN 'ladder' WHEN 2 THEN 'sequence' ELSE 'grid' END", "has_video": "o_orderkey % 6 <> 0",
    }),
    "protections": ("supplier", {
        "track": "s_suppkey", "scheme": "CASE s_suppkey % 6 WHEN 0 THEN 'cenc' WHEN 1 THEN 'cens' WHEN 2 THEN 'cbc1' WHEN 3 THEN 'cbcs' WHEN 4 THEN 'piff' ELSE 'cbcs' END", "iv_size": "CASE s_suppkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 8 WHEN 2 THEN 16 WHEN 3 THEN 12 ELSE 8 END",
        "has_seig": "s_suppkey % 11 = 0", "senc_count": "s_suppkey % 4", "run_count": "CASE WHEN s_suppkey % 13 = 0 THEN 9 ELSE s_suppkey % 4 END", "iv": "CASE WHEN s_suppkey % 2 = 0 THEN '0011223344556677' ELSE '00112233445566778899aabbccddeeff' END",
    }),
    "route_requests": ("pages", {
        "page_id": "page_id", "pinned": "CASE page_id % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' WHEN 2 THEN NULL ELSE 'v1' END", "current": "'v1'", "hls_only": "page_id % 5 = 0", "protocol": "CASE WHEN page_id % 3 = 0 THEN 'dash' ELSE 'hls' END",
        "track": "CASE page_id % 11 WHEN 0 THEN 'video' WHEN 1 THEN 'video-720p' WHEN 2 THEN 'audio-1' WHEN 3 THEN 'audio-0' WHEN 4 THEN 'audio-02' WHEN 5 THEN 'video-' WHEN 6 THEN 'video-x_y' WHEN 7 THEN 'muxed' WHEN 8 THEN 'text' WHEN 9 THEN 'audio-70000' ELSE 'audio-65535' END",
    }),
}


def _input(spark, sf_dir: str, name: str) -> DataFrame:
    source, columns = INPUTS[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def _sql(name: str, select: str, more: str = "") -> str:
    source, columns = INPUTS[name]
    return f'WITH {name} AS (SELECT {", ".join(f"{e} AS {c}" for c, e in columns.items())} FROM {source}){more} {select}'


def _query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _first(*rules: tuple[Column, str], otherwise: str = "ok") -> Column:
    """The name of the first rule that fails."""
    out = F.lit(otherwise)
    for failed, name in reversed(rules):
        out = F.when(F.coalesce(failed, F.lit(False)), name).otherwise(out)
    return out


_KNOWN = ("avc1", "hvc1", "hev1", "vp09", "av01", "mp4a", "ac-3", "ec-3", "Opus", "fLaC")


@_query(_sql("raw_tracks", f"""SELECT track, CASE WHEN twice THEN 'id twice' WHEN handler NOT IN ('vide', 'soun') THEN 'skip: no media' WHEN "references" <> 1 THEN 'data references' WHEN NOT own_data THEN 'other file' WHEN descriptions <> 1 THEN 'descriptions'
  WHEN entry IN ({', '.join(f"'{k}'" for k in _KNOWN)}) THEN 'package' WHEN entry IN ('encv', 'enca') THEN CASE WHEN has_sinf THEN 'package' ELSE 'no protection' END WHEN handler = 'vide' AND samples <= 1 THEN 'skip: still' ELSE 'entry' END AS disposition
  FROM (SELECT *, row_number() OVER (PARTITION BY file, id ORDER BY track) > 1 AS twice FROM raw_tracks)""").replace("AS references", 'AS "references"'))
def track_disposition(spark, sf_dir: str) -> DataFrame:
    """Whether a track is packaged, skipped, or why it is refused."""
    twice = F.row_number().over(Window.partitionBy("file", "id").orderBy("track")) > 1
    protected = F.col("entry").isin("encv", "enca")
    out = _first(
        (twice, "id twice"), (~F.col("handler").isin("vide", "soun"), "skip: no media"), (F.col("references") != 1, "data references"), (~F.col("own_data"), "other file"), (F.col("descriptions") != 1, "descriptions"),
        (F.col("entry").isin(*_KNOWN), "package"), (protected & F.col("has_sinf"), "package"), (protected, "no protection"), ((F.col("handler") == "vide") & (F.col("samples") <= 1), "skip: still"), otherwise="entry",
    )
    return _input(spark, sf_dir, "raw_tracks").select("track", out.alias("disposition"))


@_query(_sql("raw_tracks", "SELECT file, CASE WHEN n <> 1 THEN 'not one audio track' ELSE 'ok' END AS outcome, CASE WHEN n = 1 THEN CASE file % 3 WHEN 0 THEN 'eng' WHEN 1 THEN own ELSE 'fra' END END AS language FROM (SELECT file, count(*) FILTER (handler = 'soun') AS n, min(CASE WHEN handler = 'soun' THEN entry END) AS own FROM raw_tracks GROUP BY file)").replace("AS references", 'AS "references"'))
def audio_overrides(spark, sf_dir: str) -> DataFrame:
    """An answer's language takes the place of the file's, where exactly one audio track is left."""
    audio = F.col("handler") == "soun"
    per = _input(spark, sf_dir, "raw_tracks").groupBy("file").agg(F.count_if(audio).alias("n"), F.min(F.when(audio, F.col("entry"))).alias("own"))
    asked = F.when(F.col("file") % 3 == 0, "eng").when(F.col("file") % 3 == 2, "fra")
    one = F.col("n") == 1
    return per.select("file", F.when(one, "ok").otherwise("not one audio track").alias("outcome"), F.when(one, F.coalesce(asked, "own")).alias("language"))


@_query(_sql("wire_clips", f"""SELECT answer, CASE WHEN any_value(n) > {MAX_CLIPS} THEN 'too many clips' ELSE coalesce(min(why), 'ok') END AS outcome, CASE WHEN any_value(n) <= {MAX_CLIPS} THEN min(CASE WHEN why IS NOT NULL THEN k END) END AS clip
  FROM (SELECT *, CASE WHEN k = min(CASE WHEN bad IS NOT NULL THEN k END) OVER (PARTITION BY answer) THEN bad END AS why FROM (SELECT answer, count(*) OVER (PARTITION BY answer) AS n, row_number() OVER (PARTITION BY answer ORDER BY place) - 1 AS k,
    CASE WHEN coalesce(from_ms, 0) > {MAX_CLIP_MS} OR to_ms > {MAX_CLIP_MS} THEN 'times too large' WHEN to_ms <= coalesce(from_ms, 0) THEN 'ends before it starts' END AS bad FROM wire_clips)) GROUP BY answer"""))
def clip_rules(spark, sf_dir: str) -> DataFrame:
    """The first clip of an answer that breaks a rule, and which."""
    k = (F.row_number().over(Window.partitionBy("answer").orderBy("place")) - 1).cast("bigint")
    start = F.coalesce("from_ms", F.lit(0))
    bad = F.when((start > MAX_CLIP_MS) | F.coalesce(F.col("to_ms") > MAX_CLIP_MS, F.lit(False)), "times too large").when(F.col("to_ms") <= start, "ends before it starts")
    each = _input(spark, sf_dir, "wire_clips").withColumn("k", k).withColumn("bad", bad)
    per = each.groupBy("answer").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("bad").isNotNull(), F.struct("k", "bad"))).alias("first"))
    many = F.col("n") > MAX_CLIPS
    return per.select("answer", F.when(many, "too many clips").otherwise(F.coalesce("first.bad", F.lit("ok"))).alias("outcome"), F.when(~many, F.col("first.k")).alias("clip"))


@_query(_sql("wire_keys", """SELECT answer, CASE WHEN bool_or(kind = 'text') THEN 'tracks' WHEN count(*) FILTER (kind IS NULL OR kind = 'all') > 1 OR count(*) FILTER (kind = 'video') > 1 OR count(*) FILTER (kind = 'audio') > 1 THEN 'shape'
  WHEN count(*) = 1 AND count(*) FILTER (kind IS NULL OR kind = 'all') = 1 THEN 'one key' WHEN count(*) = 2 AND count(*) FILTER (kind = 'video') = 1 AND count(*) FILTER (kind = 'audio') = 1 THEN 'video and audio' ELSE 'shape' END AS outcome FROM wire_keys GROUP BY answer"""))
def content_key_rules(spark, sf_dir: str) -> DataFrame:
    """One key for all tracks, or one for video and one for audio."""
    any_, video, audio = (F.count_if(c) for c in (F.col("kind").isNull() | (F.col("kind") == "all"), F.col("kind") == "video", F.col("kind") == "audio"))
    n = F.count(F.lit(1))
    out = _first((F.max(F.col("kind") == "text"), "tracks"), ((any_ > 1) | (video > 1) | (audio > 1), "shape"), ((n == 1) & (any_ == 1), "one key"), ((n == 2) & (video == 1) & (audio == 1), "video and audio"), otherwise="shape")
    return _input(spark, sf_dir, "wire_keys").groupBy("answer").agg(out.alias("outcome"))


@_query(_sql("wire_keys", f"""SELECT answer, CASE WHEN bool_or(passthrough) THEN 'passthrough' WHEN count(*) > {MAX_SOURCE_KEYS} THEN 'too many keys' WHEN bool_or(kind = 'text') THEN 'tracks' WHEN count(DISTINCT key_id || '/' || CASE WHEN kind IS NULL THEN 'all' ELSE kind END) < count(*) THEN 'key twice' ELSE 'ok' END AS outcome FROM wire_keys GROUP BY answer"""))
def source_key_rules(spark, sf_dir: str) -> DataFrame:
    """Keys to a file's own protection: not too many, none twice for the same tracks."""
    tracks = F.coalesce("kind", F.lit("all"))
    out = _first((F.max("passthrough"), "passthrough"), (F.count(F.lit(1)) > MAX_SOURCE_KEYS, "too many keys"), (F.max(F.col("kind") == "text"), "tracks"), (F.countDistinct("key_id", tracks) < F.count(F.lit(1)), "key twice"))
    return _input(spark, sf_dir, "wire_keys").groupBy("answer").agg(out.alias("outcome"))


@_query(_sql("wire_keys", """SELECT answer, sha256(string_agg(entry, '' ORDER BY entry)) AS fingerprint FROM (SELECT answer, printf('%08x', key_id) || CASE kind WHEN 'video' THEN '01' WHEN 'audio' THEN '02' ELSE '00' END || sha256('key ' || place) AS entry FROM wire_keys) GROUP BY answer"""))
def key_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The same for the same keys in any order; of a key only its digest enters."""
    kind = F.when(F.col("kind") == "video", "01").when(F.col("kind") == "audio", "02").otherwise("00")
    entry = F.concat(F.lower(F.lpad(F.hex(F.col("key_id").cast("bigint")), 8, "0")), kind, F.sha2(F.concat(F.lit("key "), F.col("place").cast("string")), 256))
    return _input(spark, sf_dir, "wire_keys").groupBy("answer").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ""), 256).alias("fingerprint"))


@_query(_sql("key_sets", f"""SELECT answer, CASE WHEN scheme <> 'cbcs' THEN 'scheme' WHEN n_periods > 0 AND (n_keys > 0 OR clear_lead IS NOT NULL) THEN 'periods and keys' WHEN n_periods > {MAX_PERIODS} THEN 'too many periods' WHEN url IS NOT NULL AND (NOT starts_with(url, 'https://') OR length(url) > {MAX_URI}) THEN 'licence address'
  WHEN uri = '' OR length(uri) > {MAX_URI} OR contains(uri, '"') THEN 'key address' WHEN n_periods > 0 THEN 'periods' WHEN clear_lead > 0 THEN 'clear lead' ELSE 'one period' END AS outcome FROM key_sets"""))
def key_set_rules(spark, sf_dir: str) -> DataFrame:
    """What is wrong with a key set, or how its time is divided."""
    out = _first(
        (F.col("scheme") != "cbcs", "scheme"), ((F.col("n_periods") > 0) & ((F.col("n_keys") > 0) | F.col("clear_lead").isNotNull()), "periods and keys"), (F.col("n_periods") > MAX_PERIODS, "too many periods"),
        (~F.startswith("url", F.lit("https://")) | (F.length("url") > MAX_URI), "licence address"), ((F.col("uri") == "") | (F.length("uri") > MAX_URI) | F.contains("uri", F.lit('"')), "key address"),
        (F.col("n_periods") > 0, "periods"), (F.col("clear_lead") > 0, "clear lead"), otherwise="one period",
    )
    return _input(spark, sf_dir, "key_sets").select("answer", out.alias("outcome"))


@_query(_sql("answers", """SELECT answer, CASE WHEN tracks IS NOT NULL AND files > 1 THEN 'tracks of several files' WHEN clip_keys AND clip_periods THEN 'periods of a clip' WHEN rendition_clips AND captions THEN 'captions' WHEN rendition_clips AND keys THEN 'encryption' WHEN rendition_clips AND whole_keys THEN 'whole-segment keys'
  WHEN rendition_clips AND source_keys THEN 'source keys' WHEN rendition_clips AND clip_keys THEN 'keys of a clip' ELSE 'ok' END AS outcome FROM answers"""))
def unsupported_combinations(spark, sf_dir: str) -> DataFrame:
    clips = F.col("rendition_clips")
    out = _first(
        (F.col("tracks").isNotNull() & (F.col("files") > 1), "tracks of several files"), (F.col("clip_keys") & F.col("clip_periods"), "periods of a clip"),
        *[(clips & F.col(c), name) for c, name in (("captions", "captions"), ("keys", "encryption"), ("whole_keys", "whole-segment keys"), ("source_keys", "source keys"), ("clip_keys", "keys of a clip"))],
    )
    return _input(spark, sf_dir, "answers").select("answer", out.alias("outcome"))


@_query(_sql("answers", "SELECT answer, CASE WHEN kind IN ('sequence', 'grid') THEN 'sequence' WHEN whole_keys THEN 'whole-segment keys' WHEN rotating THEN 'key periods' WHEN source_keys THEN 'decrypted source' WHEN NOT has_video THEN 'no video' ELSE 'offered' END AS outcome FROM answers"))
def iframe_offers(spark, sf_dir: str) -> DataFrame:
    """Whether an asset has an I-frame playlist, or why not."""
    out = _first((F.col("kind").isin("sequence", "grid"), "sequence"), (F.col("whole_keys"), "whole-segment keys"), (F.col("rotating"), "key periods"), (F.col("source_keys"), "decrypted source"), (~F.col("has_video"), "no video"), otherwise="offered")
    return _input(spark, sf_dir, "answers").select("answer", out.alias("outcome"))


@_query(_sql("protections", """SELECT track, CASE WHEN scheme NOT IN ('cenc', 'cens', 'cbc1', 'cbcs') THEN 'scheme' WHEN iv_size NOT IN (0, 8, 16) THEN 'iv size' WHEN has_seig THEN 'keys change' WHEN senc_count <> run_count THEN 'sample count' ELSE 'ok' END AS outcome,
  CASE scheme WHEN 'cenc' THEN 'ctr' WHEN 'cens' THEN 'ctr, pattern' WHEN 'cbc1' THEN 'cbc' WHEN 'cbcs' THEN 'cbc, pattern' END AS mode, rpad(iv, 32, '0') AS iv FROM protections"""))
def source_protection(spark, sf_dir: str) -> DataFrame:
    """Whether a protected track can be read: scheme, size of its initialisation vectors, one key for all, a vector a sample."""
    out = _first((~F.col("scheme").isin("cenc", "cens", "cbc1", "cbcs"), "scheme"), (~F.col("iv_size").isin(0, 8, 16), "iv size"), (F.col("has_seig"), "keys change"), (F.col("senc_count") != F.col("run_count"), "sample count"))
    mode = F.element_at(F.create_map(*[F.lit(x) for x in ("cenc", "ctr", "cens", "ctr, pattern", "cbc1", "cbc", "cbcs", "cbc, pattern", "piff", None)]), F.col("scheme"))
    return _input(spark, sf_dir, "protections").select("track", out.alias("outcome"), mode.alias("mode"), F.rpad("iv", 32, "0").alias("iv"))


@_query(_sql("route_requests", """SELECT page_id, CASE WHEN pinned IS DISTINCT FROM current THEN 'version' WHEN hls_only AND protocol = 'dash' THEN 'protocol' WHEN track = 'muxed' AND protocol <> 'hls' THEN 'track' ELSE 'ok' END AS outcome FROM route_requests""").replace("AS current", 'AS "current"').replace("FROM current", 'FROM "current"'))
def version_pins(spark, sf_dir: str) -> DataFrame:
    """A URL has to name the current version; some assets and streams are HLS only."""
    out = _first((~F.col("pinned").eqNullSafe(F.col("current")), "version"), (F.col("hls_only") & (F.col("protocol") == "dash"), "protocol"), ((F.col("track") == "muxed") & (F.col("protocol") != "hls"), "track"))
    return _input(spark, sf_dir, "route_requests").select("page_id", out.alias("outcome"))


@_query(_sql("route_requests", """SELECT page_id, CASE WHEN track = 'video' OR regexp_full_match(track, 'video-[A-Za-z0-9-]{1,32}') THEN 'video' WHEN regexp_full_match(track, 'audio-[1-9][0-9]{0,4}') AND regexp_extract(track, '[0-9]+$')::INT <= 65535 THEN 'audio' END AS kind,
  CASE WHEN regexp_full_match(track, 'video-[A-Za-z0-9-]{1,32}') THEN track[7:] END AS rendition, CASE WHEN regexp_full_match(track, 'audio-[1-9][0-9]{0,4}') AND regexp_extract(track, '[0-9]+$')::INT <= 65535 THEN regexp_extract(track, '[0-9]+$')::BIGINT END AS ordinal FROM route_requests""").replace("AS current", 'AS "current"'))
def url_tracks(spark, sf_dir: str) -> DataFrame:
    """video, video-{rendition} or audio-{ordinal}; an ordinal is written without zeros before it."""
    rendition = F.when(F.col("track").rlike("^video-[A-Za-z0-9-]{1,32}$"), F.substring("track", 7, 99))
    digits = F.when(F.col("track").rlike("^audio-[1-9][0-9]{0,4}$"), F.substring("track", 7, 99).cast("bigint"))
    ordinal = F.when(digits <= 65_535, digits)
    kind = F.when((F.col("track") == "video") | rendition.isNotNull(), "video").when(ordinal.isNotNull(), "audio")
    return _input(spark, sf_dir, "route_requests").select("page_id", kind.alias("kind"), rendition.alias("rendition"), ordinal.alias("ordinal"))


# --- answers with several files: an order is an answer, its lines are the cells of renditions and clips ---


@_query("SELECT l_orderkey AS answer, l_suppkey % 3 AS rendition, count(*) AS clips, CASE WHEN count(DISTINCT l_returnflag = 'N') > 1 THEN 'video in some clips' ELSE 'ok' END AS outcome FROM lineitem GROUP BY l_orderkey, l_suppkey % 3")
def video_everywhere(spark, sf_dir: str) -> DataFrame:
    """A rendition is video in every clip or in none."""
    mixed = F.countDistinct(F.col("l_returnflag") == "N") > 1
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("answer"), (F.col("l_suppkey") % 3).alias("rendition")).agg(F.count(F.lit(1)).alias("clips"), F.when(mixed, "video in some clips").otherwise("ok").alias("outcome"))


@_query("""WITH p AS (SELECT l_orderkey AS answer, l_suppkey % 3 AS rendition, list(l_linenumber // 2 ORDER BY l_linenumber // 2) AS starts FROM lineitem GROUP BY ALL), f AS (SELECT answer, arg_min(starts, rendition) AS lead, arg_min(rendition, rendition) AS first FROM p GROUP BY answer)
SELECT p.answer, rendition, starts = lead AS agrees FROM p JOIN f ON p.answer = f.answer WHERE rendition <> first""")
def period_agreement(spark, sf_dir: str) -> DataFrame:
    """Renditions change their keys at the same segments as the first one."""
    starts = F.array_sort(F.collect_list(F.expr("l_linenumber div 2")))
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("answer"), (F.col("l_suppkey") % 3).alias("rendition")).agg(starts.alias("starts"))
    w = Window.partitionBy("answer").orderBy("rendition")
    return p.withColumn("lead", F.first("starts").over(w)).withColumn("k", F.row_number().over(w)).where("k > 1").select("answer", "rendition", (F.col("starts") == F.col("lead")).alias("agrees"))


@_query("""WITH t AS (SELECT l_orderkey AS answer, l_suppkey % 3 AS rendition, l_linenumber AS track, l_returnflag = 'N' AS video, l_partkey AS part, l_suppkey AS supp, l_quantity AS qty FROM lineitem), o AS (SELECT *, bool_or(video) OVER (PARTITION BY answer, rendition) AS with_video FROM t),
d AS (SELECT *, bool_or(NOT with_video) OVER (PARTITION BY answer) AS dedicated FROM o), a AS (SELECT *, CASE WHEN dedicated THEN NOT with_video ELSE rendition = min(CASE WHEN NOT video THEN rendition END) OVER (PARTITION BY answer) END AS chosen FROM d)
SELECT answer, row_number() OVER (PARTITION BY answer ORDER BY rendition, track, part, supp, qty) AS ordinal, rendition, row_number() OVER (PARTITION BY answer, rendition ORDER BY track, part, supp, qty) AS internal FROM a WHERE chosen AND NOT video""")
def audio_owners(spark, sf_dir: str) -> DataFrame:
    """The shared audio group: of the audio-only renditions if there are any, else of the first rendition that has audio; numbered anew."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer"), (F.col("l_suppkey") % 3).alias("rendition"), F.col("l_linenumber").alias("track"), (F.col("l_returnflag") == "N").alias("video"), "l_partkey", "l_suppkey", "l_quantity")
    answer = Window.partitionBy("answer")
    t = t.withColumn("with_video", F.max("video").over(Window.partitionBy("answer", "rendition")))
    t = t.withColumn("dedicated", F.max(~F.col("with_video")).over(answer)).withColumn("lead", F.min(F.when(~F.col("video"), F.col("rendition"))).over(answer))
    chosen = t.where(F.when(F.col("dedicated"), ~F.col("with_video")).otherwise(F.col("rendition") == F.col("lead")) & ~F.col("video"))
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("rendition", "track", "l_partkey", "l_suppkey", "l_quantity")).cast("bigint")
    return chosen.select("answer", number("answer").alias("ordinal"), "rendition", number("answer", "rendition").alias("internal"))


@_query("""WITH a AS (SELECT l_orderkey AS answer, l_linenumber AS place, l_partkey AS object FROM lineitem WHERE l_orderkey % 3 <> 0), b AS (SELECT l_orderkey AS answer, l_linenumber AS place, CASE WHEN l_orderkey % 5 = 0 THEN l_partkey + l_linenumber % 2 ELSE l_partkey END AS object FROM lineitem WHERE l_orderkey % 4 <> 0)
SELECT answer, CASE WHEN count(a_object) = 0 THEN 'new' WHEN count(b_object) = 0 THEN 'gone' WHEN bool_or(a_object IS DISTINCT FROM b_object) THEN 'other objects' ELSE 'same objects' END AS change FROM (SELECT coalesce(a.answer, b.answer) AS answer, a.object AS a_object, b.object AS b_object FROM a FULL JOIN b ON a.answer = b.answer AND a.place = b.place) GROUP BY answer""")
def answer_changes(spark, sf_dir: str) -> DataFrame:
    """A new answer against the old one: whether it names the same objects at the same places."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("object"))
    old = lines.where("answer % 3 <> 0").withColumnRenamed("object", "old")
    new = lines.where("answer % 4 <> 0").withColumn("new", F.when(F.col("answer") % 5 == 0, F.col("object") + F.col("place") % 2).otherwise(F.col("object"))).drop("object")
    both = old.join(new, ["answer", "place"], "full")
    change = F.when(F.count("old") == 0, "new").when(F.count("new") == 0, "gone").when(F.max(~F.col("old").eqNullSafe(F.col("new"))), "other objects").otherwise("same objects")
    return both.groupBy("answer").agg(change.alias("change"))


@_query("""SELECT l_orderkey AS answer, l_linenumber AS clip, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN 'clip ' || l_partkey % 7 END, CASE WHEN l_orderkey % 3 <> 0 THEN 'answer ' || l_orderkey % 11 END) AS keys FROM lineitem""")
def clip_key_fallback(spark, sf_dir: str) -> DataFrame:
    """A clip's own keys, or else the answer's."""
    own = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("clip "), (F.col("l_partkey") % 7).cast("string")))
    shared = F.when(F.col("l_orderkey") % 3 != 0, F.concat(F.lit("answer "), (F.col("l_orderkey") % 11).cast("string")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("clip"), F.coalesce(own, shared).alias("keys"))


@_query("""WITH l AS (SELECT l_orderkey AS answer, l_linenumber AS place, l_suppkey % 2 AS rendition, l_partkey % 50 AS location FROM lineitem) SELECT answer, location, count(*) AS uses, min(place) AS first_place, arg_min(rendition, (place, rendition)) AS rendition FROM l GROUP BY answer, location""")
def answer_locations(spark, sf_dir: str) -> DataFrame:
    """All locations of an answer, from its nested renditions and clips, each once with where it is used first."""
    clips = F.struct(F.col("l_linenumber").alias("place"), (F.col("l_partkey") % 50).alias("location"))
    nested = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("answer"), (F.col("l_suppkey") % 2).alias("rendition")).agg(F.collect_list(clips).alias("clips"))
    each = nested.select("answer", "rendition", F.explode("clips").alias("c")).select("answer", "rendition", "c.*")
    return each.groupBy("answer", "location").agg(F.count(F.lit(1)).alias("uses"), F.min("place").alias("first_place"), F.min_by("rendition", F.struct("place", "rendition")).alias("rendition"))


@_query("""WITH l AS (SELECT l_orderkey AS answer, l_linenumber AS place, l_partkey AS object, 'https://a/' || l_partkey || '?s=' || l_linestatus AS url FROM lineitem), r AS (SELECT p_partkey AS object, 'https://a/' || p_partkey || '?s=new' AS url FROM part WHERE p_partkey % 4 = 0)
SELECT answer, place, coalesce(r.url, l.url) AS url, r.url IS NOT NULL AS rotated FROM l LEFT JOIN r ON l.object = r.object""")
def rotated_locations(spark, sf_dir: str) -> DataFrame:
    """Fresh signatures put in place by object; what has none keeps its own."""
    old = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("object"), F.concat(F.lit("https://a/"), F.col("l_partkey").cast("string"), F.lit("?s="), "l_linestatus").alias("url"))
    fresh = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("object"), F.concat(F.lit("https://a/"), F.col("p_partkey").cast("string"), F.lit("?s=new")).alias("fresh"))
    return old.join(fresh, "object", "left").select("answer", "place", F.coalesce("fresh", "url").alias("url"), F.col("fresh").isNotNull().alias("rotated"))


@_query("""SELECT answer, string_agg(key_id::VARCHAR, ',' ORDER BY first, key_id::VARCHAR) AS key_ids FROM (SELECT l_orderkey AS answer, l_suppkey % 4 AS key_id, min(l_linenumber) AS first FROM lineitem WHERE l_suppkey % 4 > 0 GROUP BY ALL) GROUP BY answer""")
def key_ids_in_order(spark, sf_dir: str) -> DataFrame:
    """The key ids of all clips, each once, in the order in which they are first seen."""
    first = table(spark, sf_dir, "lineitem").where("l_suppkey % 4 > 0").groupBy(F.col("l_orderkey").alias("answer"), (F.col("l_suppkey") % 4).alias("key_id")).agg(F.min("l_linenumber").alias("first"))
    return first.groupBy("answer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", F.col("key_id").cast("string").alias("k")))), lambda x: x["k"]), ",").alias("key_ids"))


# --- numbers, texts and bytes with rules ---


@_query("""SELECT o_orderkey AS id, TRY_CAST(o_orderkey::HUGEINT * 3000000000000000 AS BIGINT) AS product, TRY_CAST(9223372036854770000::HUGEINT + o_custkey * 7 AS BIGINT) AS total, greatest(o_custkey - o_orderkey, 0) AS saturated, least(9223372036854770000::HUGEINT + o_custkey * 7, 9223372036854775807)::BIGINT AS capped FROM orders""")
def checked_arithmetic(spark, sf_dir: str) -> DataFrame:
    """Sums and products that don't fit are null, never wrapped; saturating ones stop at the bound."""
    big, most = F.lit(9_223_372_036_854_770_000).cast("bigint"), F.lit(9_223_372_036_854_775_807).cast("bigint")
    total = F.try_add(big, F.col("o_custkey").cast("bigint") * 7)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.try_multiply(F.col("o_orderkey").cast("bigint"), F.lit(3_000_000_000_000_000).cast("bigint")).alias("product"), total.alias("total"),
        F.greatest(F.col("o_custkey") - F.col("o_orderkey"), F.lit(0)).alias("saturated"), F.coalesce(total, most).alias("capped"),
    )


_TEXTS = {"id": "p_partkey", "uuid": "CASE p_partkey % 4 WHEN 0 THEN substr(md5(p_name), 1, 8) || '-' || substr(md5(p_name), 9, 4) || '-' || substr(md5(p_name), 13, 4) || '-' || substr(md5(p_name), 17, 4) || '-' || substr(md5(p_name), 21, 12) WHEN 1 THEN upper(md5(p_name)) WHEN 2 THEN substr(md5(p_name), 1, 31) ELSE 'g' || substr(md5(p_name), 2, 31) END"}
INPUTS["texts"] = ("part", _TEXTS)
_PLAIN = "lower(replace(uuid, '-', ''))"


@_query(_sql("texts", f"""SELECT id, CASE WHEN ok THEN hex END AS hex, CASE WHEN ok THEN concat(hex[1:8], '-', hex[9:12], '-', hex[13:16], '-', hex[17:20], '-', hex[21:32]) END AS uuid, CASE WHEN ok THEN to_base64(unhex(hex)) END AS base64 FROM (SELECT id, {_PLAIN} AS hex, regexp_full_match({_PLAIN}, '[0-9a-f]{{32}}') AS ok FROM texts)"""))
def key_id_texts(spark, sf_dir: str) -> DataFrame:
    """Sixteen bytes as hex, with or without hyphens; what has another length or other digits is null."""
    plain = F.lower(F.replace("uuid", F.lit("-"), F.lit("")))
    ok = F.when(plain.rlike("^[0-9a-f]{32}$"), plain)
    parts = F.concat_ws("-", *[F.substring(ok, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return _input(spark, sf_dir, "texts").select("id", ok.alias("hex"), F.when(ok.isNotNull(), parts).alias("uuid"), F.base64(F.unhex(ok)).alias("base64"))


@_query("""SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'size' WHEN 3 THEN 'name' WHEN 4 THEN 'version' WHEN 5 THEN 'left over' ELSE 'data size' END AS outcome,
  CASE WHEN c_custkey % 7 < 2 THEN lower(hex(c_name)) END AS data FROM customer""")
def pssh_boxes(spark, sf_dir: str) -> DataFrame:
    """Boxes built from rows, five of seven broken in some way, and what their parse says."""
    k, data = F.col("c_custkey") % 7, F.col("c_name").cast("binary")
    number = lambda n: F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0"))
    length = F.octet_length(data)
    version = F.when(k == 1, 1).when(k == 4, 2).otherwise(0)
    kids = F.when(k == 1, F.concat(number(F.lit(1)), F.lit(bytes(16)))).otherwise(F.lit(b""))
    tail = F.when(k == 5, F.lit(b"xx")).otherwise(F.lit(b""))
    stated = length + F.when(k == 6, 1000).otherwise(0)
    body = F.concat(F.when(k == 3, F.lit(b"free")).otherwise(F.lit(b"pssh")), F.substring(number(version), 4, 1), F.lit(bytes(3)), F.lit(bytes(range(16))), kids, number(stated), data, tail)
    boxes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(number(F.octet_length(body) + 4 + F.when(k == 2, 1).otherwise(0)), body).alias("bytes"))
    return parse_pssh(boxes).select("id", "outcome", F.lower(F.hex("data")).alias("data"))


def parse_pssh(boxes: DataFrame) -> DataFrame:
    """boxes (with bytes) with outcome, system and data: exactly one well-formed box."""
    at = lambda a, n=4: F.conv(F.hex(F.substring(F.col("bytes"), a, n)), 16, 10).cast("bigint")
    step = boxes.withColumn("_size", at(1)).withColumn("_version", at(9, 1)).withColumn("_kids", F.when(F.col("_version") == 1, 4 + 16 * at(29)).otherwise(F.lit(0).cast("bigint")))
    begin = (F.col("_kids") + 33).cast("int")
    step = step.withColumn("_n", F.conv(F.hex(F.expr("substring(bytes, cast(_kids + 29 as int), 4)")), 16, 10).cast("bigint")).withColumn("_data", F.expr("substring(bytes, cast(_kids + 33 as int), cast(_n as int))"))
    whole = F.octet_length("bytes")
    outcome = _first(
        (F.col("_size") != whole, "size"), (F.substring("bytes", 5, 4) != F.lit(b"pssh"), "name"), (~F.col("_version").isin(0, 1), "version"), (F.octet_length("_data") < F.col("_n"), "data size"), (begin + F.col("_n") - 1 < whole, "left over"),
    )
    step = step.withColumn("outcome", outcome)
    return step.select(*boxes.columns, "outcome", F.when(F.col("outcome") == "ok", F.expr("substring(bytes, 13, 16)")).alias("system"), F.when(F.col("outcome") == "ok", F.col("_data")).alias("data"))


# --- sources and resolvers ---


@_query("""SELECT event_id, CASE WHEN status = 200 THEN 'ok' WHEN status = 304 AND known THEN 'unchanged' WHEN status IN (404, 410) THEN 'not found' WHEN status = 429 OR status >= 500 THEN 'unavailable' ELSE 'rejected' END AS outcome,
  CASE WHEN status = 429 OR status >= 500 THEN CASE WHEN status = 429 THEN CASE WHEN asked <= 1 THEN asked * 1000 END ELSE 100 END END::BIGINT AS retry_ms
  FROM (SELECT event_id, [200, 304, 404, 410, 401, 403, 429, 503, 500, 302, 206][event_id % 11 + 1] AS status, event_id % 2 = 0 AS known, event_id % 4 AS asked FROM events)""")
def resolver_outcomes(spark, sf_dir: str) -> DataFrame:
    """What a status of the catalog means, and after how long to ask again: a Retry-After of over a second isn't waited for."""
    e = F.col("event_id")
    status = F.get(F.array(*map(F.lit, (200, 304, 404, 410, 401, 403, 429, 503, 500, 302, 206))), (e % 11).cast("int"))
    base = table(spark, sf_dir, "events").select("event_id", status.alias("status"), (e % 2 == 0).alias("known"), (e % 4).alias("asked"))
    s = F.col("status")
    busy = (s == 429) | (s >= 500)
    outcome = F.when(s == 200, "ok").when((s == 304) & F.col("known"), "unchanged").when(s.isin(404, 410), "not found").when(busy, "unavailable").otherwise("rejected")
    retry = F.when(s == 429, F.when(F.col("asked") <= 1, F.col("asked") * 1000)).when(busy, 100)
    return base.select("event_id", outcome.alias("outcome"), retry.cast("bigint").alias("retry_ms"))


@_query("""WITH q AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'films/' || page_id || '.mp4' WHEN 1 THEN '../films/a.mp4' WHEN 2 THEN '/etc/a.mp4' WHEN 3 THEN 'films/./a.mp4' WHEN 4 THEN 'films/x/../../../a.mp4' ELSE 'links/out.mp4' END AS path FROM pages)
SELECT page_id, CASE WHEN starts_with(path, '/') THEN 'absolute' WHEN list_contains(string_split(path, '/'), '..') OR list_contains(string_split(path, '/'), '.') THEN 'leaves the root' WHEN starts_with(path, 'links/') THEN 'leaves the root' ELSE 'ok' END AS outcome FROM q""")
def confined_paths(spark, sf_dir: str) -> DataFrame:
    """A location has to lie under the root, its links followed (links/ stands for one that leads out)."""
    p = F.col("page_id")
    path = F.when(p % 6 == 0, F.concat(F.lit("films/"), p.cast("string"), F.lit(".mp4")))
    for i, text in enumerate(("../films/a.mp4", "/etc/a.mp4", "films/./a.mp4", "films/x/../../../a.mp4", "links/out.mp4"), 1):
        path = F.when(p % 6 == i, text).otherwise(path)
    real = F.when(F.startswith("path", F.lit("links/")), F.lit("/elsewhere/out.mp4")).otherwise(F.concat(F.lit("/root/"), F.col("path")))
    parts = F.split("path", "/")
    outcome = _first((F.startswith("path", F.lit("/")), "absolute"), (F.array_contains(parts, "..") | F.array_contains(parts, "."), "leaves the root"), (~F.startswith("real", F.lit("/root/")), "leaves the root"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("real", real).select("page_id", outcome.alias("outcome"))


@_query("SELECT p.doc_id, CASE WHEN s.id IS NULL THEN 'unknown' ELSE 'known' END AS outcome, s.path FROM (SELECT doc_id, source || '-' || lang AS id FROM documents) p LEFT JOIN (SELECT DISTINCT source || '-en' AS id, 'films/' || source || '.mp4' AS path FROM documents) s ON p.id = s.id")
def static_catalog(spark, sf_dir: str) -> DataFrame:
    """Requests against a catalog that is a list: known ids have a path and never expire."""
    docs = table(spark, sf_dir, "documents")
    known = docs.select(F.concat("source", F.lit("-en")).alias("id"), F.concat(F.lit("films/"), "source", F.lit(".mp4")).alias("path")).distinct()
    asked = docs.select("doc_id", F.concat("source", F.lit("-"), "lang").alias("id"))
    return asked.join(known, "id", "left").select("doc_id", F.when(F.col("path").isNull(), "unknown").otherwise("known").alias("outcome"), "path")


MAX_SMALL = 2000


@_query(f"SELECT doc_id, CASE WHEN strlen(text) > {MAX_SMALL} THEN 'too large' ELSE 'ok' END AS outcome, CASE WHEN strlen(text) <= {MAX_SMALL} THEN sha256(text) END AS digest FROM documents WHERE text IS NOT NULL")
def capped_reads(spark, sf_dir: str) -> DataFrame:
    """Small objects read whole, where their size allows it; larger ones aren't touched."""
    size = F.octet_length("text")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.when(size > MAX_SMALL, "too large").otherwise("ok").alias("outcome"), F.when(size <= MAX_SMALL, F.sha2("text", 256)).alias("digest"))


@_query("""WITH r AS (SELECT page_id, unnest(range(0, 4)) AS k, html FROM pages WHERE html IS NOT NULL), q AS (SELECT page_id, k, encode(html) AS b, k * 700 + page_id % 50 AS first, (page_id % 9 + 1) * 100 AS n FROM r)
SELECT page_id, k, CASE WHEN first + n > octet_length(b) THEN 'out of bounds' ELSE 'ok' END AS outcome, CASE WHEN first + n <= octet_length(b) THEN sha256(unhex(hex(b)[2 * first + 1:2 * (first + n)])) END AS digest FROM q""")
def range_reads(spark, sf_dir: str) -> DataFrame:
    """Ranges of each file, checked against its length before anything is read."""
    base = table(spark, sf_dir, "pages").where("html is not null").select("page_id", F.col("html").cast("binary").alias("b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("k"))
    base = base.withColumn("first", (F.col("k") * 700 + F.col("page_id") % 50).cast("int")).withColumn("n", ((F.col("page_id") % 9 + 1) * 100).cast("int"))
    fits = F.col("first") + F.col("n") <= F.octet_length("b")
    return base.select("page_id", "k", F.when(fits, "ok").otherwise("out of bounds").alias("outcome"), F.when(fits, F.sha2(F.expr("substring(b, first + 1, n)"), 256)).alias("digest"))


MAX_HEADER_BYTES, MAX_BOXES = 150, 5


@_query(f"""SELECT l_orderkey AS file, count(*) FILTER (bytes <= {MAX_HEADER_BYTES} AND boxes <= {MAX_BOXES}) AS accepted, coalesce(max(bytes) FILTER (bytes <= {MAX_HEADER_BYTES} AND boxes <= {MAX_BOXES}), 0)::BIGINT AS bytes, CASE WHEN bool_or(bytes > {MAX_HEADER_BYTES}) THEN 'too many bytes' WHEN bool_or(boxes > {MAX_BOXES}) THEN 'too many boxes' ELSE 'ok' END AS outcome
  FROM (SELECT l_orderkey, sum(l_quantity::BIGINT) OVER w AS bytes, row_number() OVER w AS boxes FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)) GROUP BY l_orderkey""")
def header_accounting(spark, sf_dir: str) -> DataFrame:
    """Header boxes in order of the file, counted and summed against their limits."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    run = table(spark, sf_dir, "lineitem").select("l_orderkey", F.sum(F.col("l_quantity").cast("bigint")).over(w).alias("bytes"), F.row_number().over(w).alias("boxes"))
    ok = (F.col("bytes") <= MAX_HEADER_BYTES) & (F.col("boxes") <= MAX_BOXES)
    outcome = F.when(F.max(F.col("bytes") > MAX_HEADER_BYTES), "too many bytes").when(F.max(F.col("boxes") > MAX_BOXES), "too many boxes").otherwise("ok")
    return run.groupBy(F.col("l_orderkey").alias("file")).agg(F.count_if(ok).alias("accepted"), F.coalesce(F.max(F.when(ok, F.col("bytes"))), F.lit(0).cast("bigint")).alias("bytes"), outcome.alias("outcome"))


INPUTS["responses"] = ("events", {
    "event_id": "event_id", "status": "CASE event_id % 12 WHEN 0 THEN 200 WHEN 1 THEN 412 WHEN 2 THEN 401 WHEN 3 THEN 410 WHEN 4 THEN 503 WHEN 5 THEN 429 WHEN 6 THEN 404 ELSE 206 END", "own_tag": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'a' END", "tag": "CASE WHEN event_id % 5 = 0 THEN 'b' ELSE 'a' END",
    "wanted": "1 + event_id % 100", "total": "CASE WHEN event_id % 11 = 0 THEN 999 ELSE 1000 END", "body": "1 + event_id % 100 + CASE WHEN event_id % 13 = 0 THEN 1 WHEN event_id % 17 = 0 THEN -1 ELSE 0 END",
})


@_query(_sql("responses", """SELECT event_id, CASE WHEN status IN (200, 412) THEN 'changed' WHEN status IN (401, 403, 410) THEN 'location rejected' WHEN status = 429 OR status >= 500 THEN 'unavailable' WHEN status <> 206 THEN 'upstream' WHEN own_tag IS NOT NULL AND tag <> own_tag THEN 'changed' WHEN total <> 1000 THEN 'changed'
  WHEN body > wanted THEN 'upstream' WHEN body < wanted THEN 'unavailable' ELSE 'ok' END AS outcome FROM responses"""))
def range_responses(spark, sf_dir: str) -> DataFrame:
    """What the answer to a range request means: the same object still, all of the bytes, and no more."""
    s = F.col("status")
    out = _first(
        (s.isin(200, 412), "changed"), (s.isin(401, 403, 410), "location rejected"), ((s == 429) | (s >= 500), "unavailable"), (s != 206, "upstream"), (F.col("own_tag").isNotNull() & (F.col("tag") != F.col("own_tag")), "changed"),
        (F.col("total") != 1000, "changed"), (F.col("body") > F.col("wanted"), "upstream"), (F.col("body") < F.col("wanted"), "unavailable"),
    )
    return _input(spark, sf_dir, "responses").select("event_id", out.alias("outcome"))


#: Retries of a read, and milliseconds more to wait before each.
MAX_RETRIES, BACK_OFF_MS = 2, 50
_ATTEMPTS = ("unavailable", "unavailable", "location rejected", "ok", "changed")


@_query(f"""WITH RECURSIVE a AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k, [{', '.join(f"'{x}'" for x in _ATTEMPTS)}][l_partkey % 5 + 1] AS o FROM lineitem),
w AS (SELECT id, 0::BIGINT AS k, 0 AS retries, 0 AS fresh, 0 AS waited, 'running' AS outcome FROM a WHERE k = 1
  UNION ALL SELECT w.id, a.k, w.retries + (o = 'unavailable' AND w.retries < {MAX_RETRIES})::INT, w.fresh + (o = 'location rejected' AND w.fresh = 0)::INT, w.waited + CASE WHEN o = 'unavailable' AND w.retries < {MAX_RETRIES} THEN {BACK_OFF_MS} * (w.retries + 1) ELSE 0 END,
    CASE WHEN o = 'unavailable' AND w.retries < {MAX_RETRIES} OR o = 'location rejected' AND w.fresh = 0 THEN 'running' ELSE o END FROM w JOIN a ON a.id = w.id AND a.k = w.k + 1 WHERE w.outcome = 'running')
SELECT id, outcome, k AS tries, waited::BIGINT AS waited_ms FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS last FROM w) WHERE last = 1""")
def read_retries(spark, sf_dir: str) -> DataFrame:
    """Reads as runs of attempts: what is unavailable is tried again after a while, a rejected location is asked for anew once, all else ends the read."""

    def step(state, row):
        if row is None:
            return None, [state[:3]] if state else []
        code, tries, waited, retries, fresh = state or (0, 0, 0, 0, False)
        if code:
            return state, []
        (attempt,) = row
        outcome = _ATTEMPTS[attempt]
        if outcome == "unavailable" and retries < MAX_RETRIES:
            return (0, tries + 1, waited + BACK_OFF_MS * (retries + 1), retries + 1, fresh), []
        if outcome == "location rejected" and not fresh:
            return (0, tries + 1, waited, retries, True), []
        return (attempt + 1, tries + 1, waited, retries, fresh), []

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("place"), (F.col("l_partkey") % 5).alias("attempt"))
    out = ordered_scan(lines, ["id"], "place", ["attempt"], step, [(n, "bigint") for n in ("code", "tries", "waited_ms")])
    return out.select("id", F.get(F.array(*map(F.lit, ("running", *_ATTEMPTS))), F.col("code").cast("int")).alias("outcome"), "tries", "waited_ms")
