"""Movie boxes, sample entries, segment indexes and bit codes, from bytes; each with its SQL.

The bytes are written from rows and read again; the tests read bytes written out by hand as well.
"""

from __future__ import annotations

import gzip
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.captions import caption_kind
from tickloom.operators.series import TRACK
from tickloom.plans.catalog import PLAN_SQL, _with
from tickloom.plans.playlists import MEDIA_PLAYLIST_SQL, SEGMENT_LINES_SQL, media_playlist
from tickloom.plans.trims import EDITS_SQL, MOVIE_SCALE, edit_entries
from tickloom.sources.boxes import (
    BASE_IS_MOOF, BASE_OFFSET, DATA_OFFSET, DEFAULT_DURATION, DEFAULT_SIZE, FIRST_FLAGS, RUN_SIZE, SYNC_FLAGS, BoxError, box, boxes, fragment_rows, full_box, keep_header, sample_tables,
)
from tickloom.sources.entries import Bits, aac_config, audio_entry, edit_box, entry_codec, escaped, golomb, index_box, index_ranges, movie_box, read_protection, read_tracks, start_of_stream, subsegment_fragments, track_box, unescaped, units_tile, video_entry
from tickloom.sources.media import MEDIA_SQL, media
from tickloom.sources.views import SAMPLES_SQL, samples, table, tracks

Q: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _by_row(df: DataFrame, make, ddl: str) -> DataFrame:
    """A row of df, as a dictionary, to rows of tuples."""
    fields = [f.strip().split(" ", 1) for f in ddl.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}

    def run(batches):
        for batch in batches:
            out = [row for x in batch.to_pylist() for row in make(x)]
            columns = list(zip(*out, strict=True)) if out else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return df.mapInArrow(run, ddl)


# --- sample entries: a part's numbers are the fields of its entry ---

NAMES = ("avc1", "hvc1", "vp09", "av01", "mp4a", "Opus", "fLaC", "ac-3")


def _entry(x: dict) -> bytes:
    k, name = x["k"], NAMES[x["k"] % len(NAMES)]
    w, h, rate, channels = 16 * (k % 100 + 1), 16 * (k % 60 + 1), (44_100, 48_000)[k % 2], k % 6 + 1
    if name == "avc1":
        return video_entry(name, w, h, box("avcC", bytes([1, 64 + k % 50, k % 256, 10 + k % 40, 255, 225, 0, 0, 1, 0, 0])))
    if name == "hvc1":
        return video_entry(name, w, h, box("hvcC", bytes([1, k % 32 | (k % 2) << 5 | (k % 4) << 6]) + struct.pack(">I", 1 << (31 - k % 8)) + bytes([k % 256, 0, k % 3, 0, 0, 0]) + bytes([30 + k % 100])))
    if name == "vp09":
        return video_entry(name, w, h, full_box("vpcC", bytes([k % 4, 10 + k % 50, (8 + 2 * (k % 3)) << 4, 0, 0, 0]), version=1))
    if name == "av01":
        return video_entry(name, w, h, box("av1C", bytes([0x81, (k % 3) << 5 | k % 24, (k % 2) << 7 | (0, 0x40, 0x60)[k % 3], 0])))
    if name == "mp4a":
        return audio_entry(name, rate, channels, aac_config((2, 5, 29)[k % 3]))
    if name == "Opus":
        return audio_entry(name, rate, 2, box("dOps", bytes([0, channels]) + bytes(9)))
    if name == "fLaC":
        return audio_entry(name, 0, 2, full_box("dfLa", bytes([0x80, 0, 0, 34]) + bytes(10) + (96_000 << 4 | (channels - 1) << 1).to_bytes(3, "big") + bytes(21)))
    return audio_entry(name, rate, channels, box("dac3", bytes(3)))


_ENTRY_SQL = """SELECT p_partkey AS id, CASE n WHEN 0 THEN 'avc1.' || printf('%02x%02x%02x', 64 + k % 50, k % 256, 10 + k % 40)
  WHEN 1 THEN 'hvc1.' || ['', 'A', 'B', 'C'][k % 4 + 1] || (k % 32) || '.' || printf('%X', (1 << (k % 8))::BIGINT) || '.' || CASE k % 2 WHEN 1 THEN 'H' ELSE 'L' END || (30 + k % 100) || CASE WHEN k % 3 > 0 THEN printf('.%X.0.%X', k % 256, k % 3) WHEN k % 256 > 0 THEN printf('.%X', k % 256) ELSE '' END
  WHEN 2 THEN printf('vp09.%02d.%02d.%02d', k % 4, 10 + k % 50, 8 + 2 * (k % 3)) WHEN 3 THEN printf('av01.%d.%02d', k % 3, k % 24) || CASE k % 2 WHEN 1 THEN 'H' ELSE 'M' END || ['.08', '.10', '.12'][k % 3 + 1]
  WHEN 4 THEN 'mp4a.40.' || [2, 5, 29][k % 3 + 1] WHEN 5 THEN 'opus' WHEN 6 THEN 'fLaC' ELSE 'ac-3' END AS codec,
  CASE WHEN n < 4 THEN 16 * (k % 100 + 1) END::BIGINT AS width, CASE WHEN n < 4 THEN 16 * (k % 60 + 1) END::BIGINT AS height, CASE WHEN n = 5 THEN 48000 WHEN n = 6 THEN 96000 WHEN n > 3 THEN 44100 + k % 2 * 3900 END::BIGINT AS rate, CASE WHEN n > 3 THEN k % 6 + 1 END::BIGINT AS channels
  FROM (SELECT p_partkey, p_partkey AS k, p_partkey % 8 AS n FROM part)"""


@_query(_ENTRY_SQL)
def sample_entries(spark, sf_dir: str) -> DataFrame:
    """The codec string, picture size or sound of sample entries of eight kinds."""

    def read(x):
        data = _entry(x)
        name, _, a, b = next(boxes(data))
        r = entry_codec(name, data[a:b])
        yield (x["k"], r["codec"], r["width"], r["height"], r["rate"], r["channels"])

    return _by_row(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), read, "id long, codec string, width long, height long, rate long, channels long")


# --- movies: an asset's tracks ---

_CODECS = {"avc1.64001f": lambda w, h: video_entry("avc1", w, h, box("avcC", bytes([1, 0x64, 0, 0x1F, 255, 225, 0, 0, 1, 0, 0]))), "hvc1.1.6.L93.B0": lambda w, h: video_entry("hvc1", w, h, box("hvcC", bytes([1, 1]) + struct.pack(">I", 0x60000000) + bytes([0xB0, 0, 0, 0, 0, 0, 93])))}


def _track(t: dict) -> bytes:
    if t["kind"] == "video":
        entry, handler = _CODECS[t["codec"]](t["width"], t["height"]), "vide"
    else:
        entry, handler = (audio_entry("mp4a", t["rate"], t["channels"], aac_config(2)) if t["codec"] == "mp4a.40.2" else audio_entry("Opus", t["rate"], 2, box("dOps", bytes([0, t["channels"]]) + bytes(9)))), "soun"
    edits = edit_box(t["version"], [tuple(e.values()) for e in t["entries"]]) if t["entries"] else b""
    tables = b"".join((full_box("stts", struct.pack(">III", 1, t["samples"], 1)), full_box("stsc", bytes(4)), full_box("stsz", struct.pack(">II", 1, t["samples"])), full_box("stco", bytes(4))))
    return track_box(t["track_id"], handler, t["timescale"], t["end_time"] - t["first_time"], t["language"] or "und", entry, edits, tables)


def movies(spark, sf_dir: str) -> DataFrame:
    """(asset_id, content): the movie box of each asset."""
    t = edit_entries(media(tracks(samples(spark, sf_dir))).withColumnRenamed("version", "content_version"))
    own = F.struct("track_id", "kind", "codec", "width", "height", "rate", "channels", "language", "timescale", "first_time", "end_time", "samples", "version", "entries")

    def write(x):
        yield (x["asset_id"], movie_box(MOVIE_SCALE, 0, *[_track(t) for t in x["tracks"]]))

    return _by_row(t.groupBy("asset_id").agg(F.array_sort(F.collect_list(own)).alias("tracks")), write, "asset_id long, content binary")


_TRACK_DDL = "asset_id long, track_id long, handler string, timescale long, duration long, language string, codec string, width long, height long, rate long, channels long, samples long, edits long, first_media_time long, extended boolean"


def _read(x):
    moov = next(x["content"][a:b] for n, _, a, b in boxes(x["content"]) if n == "moov")
    for r in read_tracks(moov):
        yield (x["asset_id"], r["track"], r["handler"], r["timescale"], r["duration"], r["language"], r["codec"], r["width"], r["height"], r["rate"], r["channels"], r["samples"], r["edits"], r["first_media_time"], r["extended"])


_MOVIE_SQL = """, mo AS (SELECT me.asset_id, me.track_id, CASE kind WHEN 'video' THEN 'vide' ELSE 'soun' END AS handler, me.timescale, {duration} AS duration, coalesce(language, 'und') AS language, codec, width, height, CASE codec WHEN 'opus' THEN 48000 ELSE rate END AS rate, channels, {samples} AS samples,
  {edits} AS edits, {media_time} AS first_media_time, {extended} AS extended FROM me JOIN e1 ON me.asset_id = e1.asset_id AND me.track_id = e1.track_id)"""


@_query(_with(PLAN_SQL + MEDIA_SQL + EDITS_SQL + _MOVIE_SQL.format(duration="me.end_time - me.first_time", samples="me.samples", edits="len(en)::BIGINT", media_time="en[1].m", extended="false"), "SELECT * FROM mo"))
def movie_tracks(spark, sf_dir: str) -> DataFrame:
    """What each movie box says of its tracks: headers, languages, sample entries, edit lists."""
    return _by_row(movies(spark, sf_dir), _read, _TRACK_DDL)


@_query(_with(PLAN_SQL + MEDIA_SQL + EDITS_SQL + _MOVIE_SQL.format(duration="0", samples="0", edits="0", media_time="NULL::BIGINT", extended="true"), "SELECT * FROM mo"))
def init_segments(spark, sf_dir: str) -> DataFrame:
    """What the start of each track's stream says: the same description, but no samples, length or edits, and a place for fragments."""

    def each(x):
        moov = next(x["content"][a:b] for n, _, a, b in boxes(x["content"]) if n == "moov")
        for r in read_tracks(moov):
            yield from _read({"asset_id": x["asset_id"], "content": start_of_stream(moov, [r["track"]])})

    return _by_row(movies(spark, sf_dir), each, _TRACK_DDL)


@_query(_with(PLAN_SQL + MEDIA_SQL, "SELECT asset_id, string_agg(track_id::VARCHAR, ',' ORDER BY track_id) AS tracks FROM (SELECT *, min(track_id) FILTER (kind = 'audio') OVER (PARTITION BY asset_id) AS a FROM me) WHERE kind = 'video' OR track_id = a GROUP BY asset_id"))
def muxed_init_segments(spark, sf_dir: str) -> DataFrame:
    """One start for video and the default audio: the tracks it names, in order."""

    def each(x):
        moov = next(x["content"][a:b] for n, _, a, b in boxes(x["content"]) if n == "moov")
        rows = list(read_tracks(moov))
        audio = [r["track"] for r in rows if r["handler"] == "soun"]
        start = start_of_stream(moov, sorted([r["track"] for r in rows if r["handler"] == "vide"] + audio[:1]))
        inner = next(start[a:b] for n, _, a, b in boxes(start) if n == "moov")
        yield (x["asset_id"], ",".join(str(r["track"]) for r in read_tracks(inner) if r["extended"]))

    return _by_row(movies(spark, sf_dir), each, "asset_id long, tracks string")


# --- segment indexes: a track is a file, four samples are a subsegment ---

PER_SUBSEGMENT = 4
_SUBSEGMENT_SQL = f"""sb AS (SELECT asset_id, track_id, sample_index // {PER_SUBSEGMENT} AS part, sum(size)::BIGINT + 24 AS n FROM s GROUP BY ALL),
sx AS (SELECT *, count(*) OVER (PARTITION BY asset_id, track_id) AS parts, 12 + 20 + 12 * count(*) OVER (PARTITION BY asset_id, track_id) AS head, coalesce(sum(n) OVER (PARTITION BY asset_id, track_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sb)"""


@_query(_with(f"{SAMPLES_SQL}, {_SUBSEGMENT_SQL}", """SELECT asset_id, track_id, CASE WHEN parts < 4 THEN 'few' WHEN (asset_id + track_id) % 5 = 0 THEN 'nested' WHEN (asset_id + track_id) % 7 = 0 THEN 'wrong' ELSE 'index' END AS outcome, sum(CASE WHEN parts >= 4 AND (asset_id + track_id) % 5 <> 0 AND (asset_id + track_id) % 7 <> 0 THEN 1 ELSE 0 END)::BIGINT AS fragments,
  max(CASE WHEN parts >= 4 AND (asset_id + track_id) % 5 <> 0 AND (asset_id + track_id) % 7 <> 0 THEN head + before END)::BIGINT AS last_start FROM sx GROUP BY asset_id, track_id, parts"""))
def index_partitions(spark, sf_dir: str) -> DataFrame:
    """Subsegments found by a file's index, each then walked to its own end; an index that is too short, nested or wrong isn't used."""
    sized = samples(spark, sf_dir).groupBy(*TRACK, F.expr(f"sample_index div {PER_SUBSEGMENT}").alias("part")).agg(F.sum("size").alias("n"))
    files = sized.groupBy(*TRACK).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "n"))), lambda x: x["n"]).alias("sizes"))

    def read(x):
        media_bytes = [box("moof", bytes(8)) + box("mdat", bytes(n)) for n in x["sizes"]]
        sizes, odd = [len(m) for m in media_bytes], x["asset_id"] + x["track_id"]
        if odd % 5 == 0:
            sizes[0] |= 1 << 31
        elif odd % 7 == 0:
            sizes[0] += 1
        index = index_box(0, sizes)
        data = index + b"".join(media_bytes)
        _, _, a, b = next(boxes(data))
        ranges = index_ranges(data[a:b], b)
        if ranges is None:
            yield (x["asset_id"], x["track_id"], "few" if len(sizes) < 4 else "nested", 0, None)
            return
        found = [subsegment_fragments(data, start, end) for start, end in ranges]
        if None in found:
            yield (x["asset_id"], x["track_id"], "wrong", 0, None)
        else:
            yield (x["asset_id"], x["track_id"], "index", sum(map(len, found)), found[-1][0])

    return _by_row(files, read, "asset_id long, track_id long, outcome string, fragments long, last_start long")


# --- bits ---


@_query("SELECT o_orderkey AS id, o_custkey::BIGINT AS a, (o_orderkey % 7)::BIGINT AS b, CASE WHEN o_orderkey % 2 = 1 THEN (o_orderkey + 1) // 2 ELSE -(o_orderkey // 2) END::BIGINT AS c, CASE WHEN o_orderkey % 11 = 0 THEN 'cut' ELSE 'ok' END AS outcome FROM orders WHERE o_orderkey % 11 > 0 UNION ALL SELECT o_orderkey, NULL, NULL, NULL, 'cut' FROM orders WHERE o_orderkey % 11 = 0")
def golomb_codes(spark, sf_dir: str) -> DataFrame:
    """Three numbers from bit codes in a unit whose bytes are escaped; one of eleven units is cut."""

    def read(x):
        # a cut within the first code, whose one comes after its zeros
        nal = escaped(golomb([x["b"], x["a"], x["k"]]) if x["k"] % 11 else b"\0\0")
        bits = Bits(unescaped(nal))
        try:
            b, a, c = bits.unsigned(), bits.unsigned(), bits.signed()
            yield (x["k"], a, b, c, "ok")
        except BoxError:
            yield (x["k"], None, None, None, "cut")

    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 7).alias("b"))
    return _by_row(rows, read, "id long, a long, b long, c long, outcome string")


@_query("SELECT doc_id, NOT (doc_id % 4 = 0 AND length(text) > 0) AND length(text) > 0 AND NOT contains(text, ' ' || ' ') AND NOT starts_with(text, ' ') AND NOT ends_with(text, ' ') AS tiles FROM documents WHERE text IS NOT NULL AND NOT contains(text, ' ' || ' ') AND NOT starts_with(text, ' ') AND NOT ends_with(text, ' ') AND length(text) > 0")
def unit_tiling(spark, sf_dir: str) -> DataFrame:
    """Whether units with a length of four bytes before each cover a sample: the words of a text are the units, every fourth sample is a byte short."""

    def read(x):
        sample = b"".join(struct.pack(">I", len(w)) + w for w in (w.encode() for w in x["text"].split(" ")))
        yield (x["doc_id"], units_tile(sample[:-1] if x["doc_id"] % 4 == 0 else sample, 4))

    rows = table(spark, sf_dir, "documents").where("text is not null and length(text) > 0 and not contains(text, '  ') and not startswith(text, ' ') and not endswith(text, ' ')").select("doc_id", "text")
    return _by_row(rows, read, "doc_id long, tiles boolean")


# --- fragments whose fields fall back, headers with cut tails, packed sizes, caption files: a customer's number says how each is made ---

#: A movie's defaults for the samples of a track: duration, size, flags.
DEFAULTS = (7, 30, 0x01010000)
MOOF_AT = 100


def _fragment(k: int) -> bytes:
    """A fragment of track 1 after one of track 2 that is only measured (three samples of eleven bytes)."""
    other = box("traf", full_box("tfhd", struct.pack(">II", 2, 11), flags=DEFAULT_SIZE), full_box("trun", struct.pack(">I", 3)))
    flags, fields = 0, struct.pack(">I", 1)
    if k % 3 == 0:
        flags, fields = flags | BASE_OFFSET, fields + struct.pack(">Q", 1_000_000 + k)
    elif k % 3 == 1:
        flags |= BASE_IS_MOOF
    if k % 2:
        flags, fields = flags | DEFAULT_DURATION, fields + struct.pack(">I", 3 + k % 4)
    if k % 8 == 0:
        flags, fields = flags | DEFAULT_SIZE, fields + struct.pack(">I", 50)
    time = full_box("tfdt", struct.pack(">Q" if k % 2 else ">I", 10 * k), version=k % 2)
    n, bits, run = k % 6 + 1, 0, b""
    if k % 7 == 0:
        bits, run = bits | DATA_OFFSET, run + struct.pack(">i", 200)
    if k % 5 == 0:
        bits, run = bits | FIRST_FLAGS, run + struct.pack(">I", SYNC_FLAGS)
    if k % 4:
        bits, run = bits | RUN_SIZE, run + b"".join(struct.pack(">I", (k * 7 + i * 13) % 97 + 1) for i in range(n))
    own = box("traf", full_box("tfhd", fields, flags=flags), time, full_box("trun", struct.pack(">I", n) + run, flags=bits))
    return box("moof", full_box("mfhd", struct.pack(">I", 1)), other, own)


@_query(f"""WITH f AS (SELECT c_custkey AS id, c_custkey AS k, unnest(range(0, c_custkey % 6 + 1)) AS i FROM customer), g AS (SELECT *, CASE k % 3 WHEN 0 THEN 1000000 + k WHEN 1 THEN {MOOF_AT} ELSE {MOOF_AT} + 33 END + CASE k % 7 WHEN 0 THEN 200 ELSE 0 END AS base,
  CASE WHEN k % 4 > 0 THEN (k * 7 + i * 13) % 97 + 1 WHEN k % 8 = 0 THEN 50 ELSE {DEFAULTS[1]} END AS size, CASE k % 2 WHEN 1 THEN 3 + k % 4 ELSE {DEFAULTS[0]} END AS duration FROM f)
SELECT id, i AS sample, (base + coalesce(sum(size) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, size::BIGINT AS size, (10 * k + i * duration)::BIGINT AS decode_time, duration::BIGINT AS duration, k % 5 = 0 AND i = 0 AS is_sync FROM g""")
def fragment_fallbacks(spark, sf_dir: str) -> DataFrame:
    """Samples of fragments that leave fields to their header or the movie, with each kind of base offset, behind another track's run."""

    def read(x):
        rows, _ = fragment_rows(_fragment(x["k"]), MOOF_AT, 1, 0, DEFAULTS)
        for i, (offset, size, time, duration, _, sync) in enumerate(rows):
            yield (x["k"], i, offset, size, time, duration, sync)

    return _by_row(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), read, "id long, sample long, start long, size long, decode_time long, duration long, is_sync boolean")


@_query("""SELECT c_custkey AS id, NOT (c_custkey % 3 = 0 AND c_custkey % 5 = 0) AS has_movie, (c_custkey % 5 - CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 > 0 THEN 1 ELSE 0 END)::BIGINT AS fragments,
  CASE WHEN c_custkey % 5 - CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 > 0 THEN 1 ELSE 0 END > 0 THEN 24 + (c_custkey % 5 - CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 > 0 THEN 1 ELSE 0 END - 1) * (26 + c_custkey % 7) END::BIGINT AS last_start, CASE WHEN c_custkey % 3 = 0 THEN 'cut' ELSE 'ok' END AS strict FROM customer""")
def header_walks(spark, sf_dir: str) -> DataFrame:
    """What a walk keeps of files, a third of them cut in their last box: the movie and whole fragments; a strict one refuses what is cut."""

    def read(x):
        k = x["k"]
        data = box("free", bytes(0)) + box("moov", bytes(8)) + (box("moof", b"x" * 8) + box("mdat", bytes(2 + k % 7))) * (k % 5)
        data = data[:-1] if k % 3 == 0 else data
        moov, moofs = keep_header(data)
        try:
            strict = "ok" if sum(1 for _ in boxes(data)) else "empty"
        except BoxError:
            strict = "cut"
        yield (k, bool(moov), len(moofs), moofs[-1][0] if moofs else None, strict)

    return _by_row(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), read, "id long, has_movie boolean, fragments long, last_start long, strict string")


@_query("SELECT c_custkey AS id, i AS sample, ((c_custkey * 31 + i * 17) % [16, 256, 65536][c_custkey % 3 + 1])::BIGINT AS size FROM (SELECT c_custkey, unnest(range(0, c_custkey % 9)) AS i FROM customer)")
def packed_sizes(spark, sf_dir: str) -> DataFrame:
    """Sample sizes of 4, 8 or 16 bits."""

    def read(x):
        k, bits, n = x["k"], (4, 8, 16)[x["k"] % 3], x["k"] % 9
        values = [(k * 31 + i * 17) % (1 << bits) for i in range(n)]
        packed = int("".join(f"{v:0{bits}b}" for v in values).ljust(-(-n * bits // 8) * 8, "0") or "0", 2).to_bytes(-(-n * bits // 8), "big")
        stbl = b"".join((full_box("stts", bytes(4)), full_box("stsc", bytes(4)), full_box("stz2", bytes([0, 0, 0, bits]) + struct.pack(">I", n) + packed), full_box("stco", bytes(4))))
        for i, size in enumerate(sample_tables(stbl)["sizes"].tolist()):
            yield (k, i, size)

    return _by_row(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), read, "id long, sample long, size long")


# fixed values: how caption files may begin
_HEADS = ("WEBVTT\n\n", "\ufeffWEBVTT - title\n", "WEBVTTX\n", '<?xml version="1.0"?>\n<tt xmlns="x">', "<tt:tt >", "<html>", "1\n00:00:01,000 --> ", "00:01.0 --> ", "  \n12\n0:0:1,5-->", "plain ")
_HEADS_SQL = ", ".join("'" + h.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\ufeff", "' || chr(65279) || '") + "'" for h in _HEADS)


@_query(rf"""SELECT conv_id, turn, CASE WHEN regexp_matches(h, '^WEBVTT($|[ \t\n\r])') THEN 'webvtt' WHEN regexp_matches(regexp_replace(h, '^<\?xml[^>]*>\s*', ''), '^<([a-zA-Z0-9]+:)?tt[\s>]') THEN 'ttml' WHEN regexp_matches(regexp_replace(h, '^[0-9]+\s*\n', ''), '^[0-9:]+[,.][0-9]{{1,3}}\s*-->') THEN 'srt' END AS kind
  FROM (SELECT conv_id, turn, ltrim(replace([{_HEADS_SQL}][(length(text) + turn) % {len(_HEADS)} + 1] || text, chr(65279), ''), ' ' || chr(10)) AS h FROM conversations)""")
def caption_sources(spark, sf_dir: str) -> DataFrame:
    """Which kind of captions a file holds, by how it begins."""
    head = F.get(F.array(*map(F.lit, _HEADS)), ((F.length("text") + F.col("turn")) % len(_HEADS)).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", caption_kind(F.concat(head, "text")).alias("kind"))


# --- the protection of samples: an order is a fragment, its vectors are of 0, 8 or 16 bytes ---


@_query("""SELECT id, sample, CASE v WHEN 0 THEN '' ELSE left(sha256(id || '/' || sample), 2 * v) END AS iv, parts, clear::BIGINT AS clear, protected::BIGINT AS protected, first_part::BIGINT AS first_part FROM (SELECT *, sum(parts) OVER (PARTITION BY id ORDER BY sample) - parts AS first_part FROM (
  SELECT o_orderkey AS id, i AS sample, [0, 8, 16][o_orderkey % 3 + 1] AS v, CASE WHEN o_orderkey % 2 = 1 THEN (o_orderkey + i) % 3 ELSE 0 END::BIGINT AS parts, CASE WHEN o_orderkey % 2 = 1 THEN (o_orderkey + i) % 3 * (10 + i) ELSE 0 END AS clear, CASE WHEN o_orderkey % 2 = 1 THEN (o_orderkey + i) % 3 * (o_orderkey % 1000) ELSE 0 END AS protected
  FROM (SELECT o_orderkey, unnest(range(0, o_orderkey % 4)) AS i FROM orders)))""")
def sample_protection(spark, sf_dir: str) -> DataFrame:
    """The vector of each sample and its clear and protected parts, which lie one after the other: a sample has those from first_part on."""

    def read(x):
        k, v = x["k"], (0, 8, 16)[x["k"] % 3]
        mapped = k % 2 == 1
        payload = struct.pack(">II", 2 if mapped else 0, k % 4)
        for i in range(k % 4):
            payload += hashlib.sha256(f"{k}/{i}".encode()).digest()[:v]
            if mapped:
                n = (k + i) % 3
                payload += struct.pack(">H", n) + struct.pack(">HI", 10 + i, k % 1000) * n
        vectors, starts, parts = read_protection(payload, v, k % 4)
        for i, iv in enumerate(vectors):
            own = parts[starts[i] : starts[i + 1]]
            yield (k, i, iv.hex(), len(own), sum(c for c, _ in own), sum(p for _, p in own), starts[i])

    return _by_row(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), read, "id long, sample long, iv string, parts long, clear long, protected long, first_part long")


@_query(_with(PLAN_SQL + MEDIA_SQL + SEGMENT_LINES_SQL, f"SELECT asset_id, track_id, sha256(body) AS body_sha256, true AS smaller FROM ({MEDIA_PLAYLIST_SQL})"))
def compressed_playlists(spark, sf_dir: str) -> DataFrame:
    """Media playlists compressed and read again; each is smaller compressed."""

    def read(x):
        raw = x["body"].encode()
        packed = gzip.compress(raw, mtime=0)
        yield (x["asset_id"], x["track_id"], hashlib.sha256(gzip.decompress(packed)).hexdigest(), len(packed) < len(raw))

    return _by_row(media_playlist(spark, sf_dir), read, "asset_id long, track_id long, body_sha256 string, smaller boolean")
