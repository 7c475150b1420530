"""Bytes, caption files, tokens, manifests, texts of the status pages and streams, each with its SQL.

Queries that write a format and read it again have the rows they began with as their SQL.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.captions import srt_cues, ttml_files
from tickloom.functions.ciphers import ctr, pattern_decrypt, pattern_encrypt
from tickloom.functions.text import cue_time, xml_escape
from tickloom.functions.tokens import sign, verify
from tickloom.operators.ranges import CHUNK, GAP_BUDGET, MAX_GAP, gap_budget_reads
from tickloom.operators.series import TRACK
from tickloom.plans.catalog import _CUE_SQL, BOUNDS_SQL, PLAN_SQL, _cues, _with, asset_rollup, requests_by_route
from tickloom.plans.catalog import SQL as CATALOG_SQL
from tickloom.plans.segments import TARGET_MS, segment_plan
from tickloom.sources.boxes import box, box_walk, decode_tables, fragment_rows, write_fragment, write_sample_tables
from tickloom.sources.views import SAMPLES_SQL, samples, table
from tickloom.streaming.ingest import counted, in_parts, ordered_fragments, shared_folder, stream_cuts

#: Samples of a fragment.
PER_FRAGMENT = 8
#: Test key of the tokens, and the time at which they are checked.
KEY, WRONG_KEY, NOW = b"a key for the test tables", b"another key", 1_000

Q: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_FIELDS = ("sample_index", "offset", "size", "decode_time", "duration", "composition_offset", "is_sync")


def _columns(group: pa.Table) -> dict[str, np.ndarray]:
    group = group.sort_by("sample_index")
    return {k: group.column(k).to_numpy() for k in _FIELDS}


def _files(spark, sf_dir: str) -> DataFrame:
    """(asset_id, track_id, content): a movie box with the sample tables of each track."""

    def write(group):
        c = _columns(group)
        stbl = write_sample_tables(c["offset"], c["size"], c["duration"], c["composition_offset"], c["is_sync"])
        moov = box("moov", box("trak", box("mdia", box("minf", stbl))))
        return pa.table({k: group.column(k).slice(0, 1) for k in TRACK} | {"content": pa.array([moov], pa.binary())})

    return samples(spark, sf_dir).select(*TRACK, *_FIELDS).groupBy(*TRACK).applyInArrow(write, "asset_id long, track_id long, content binary")


@_query(_with(SAMPLES_SQL, """SELECT asset_id, track_id, sample_index, s."offset", size, decode_time - min(decode_time) OVER (PARTITION BY asset_id, track_id) AS decode_time, duration, composition_offset, is_sync FROM s"""))
def sample_table_round_trip(spark, sf_dir: str) -> DataFrame:
    """The series of each track, through the bytes of its sample tables."""
    return decode_tables(_files(spark, sf_dir))


_ISLANDS = "coalesce({0} <> lag({0}) OVER w, true)"


@_query(_with(SAMPLES_SQL, f"""SELECT asset_id, track_id, path, box_size FROM (
  SELECT asset_id, track_id, 16 + 8 * count(*) FILTER (nd) AS stts, CASE WHEN bool_or(composition_offset <> 0) THEN 16 + 8 * count(*) FILTER (nc) END AS ctts,
    CASE WHEN NOT bool_and(is_sync) THEN 16 + 4 * count(*) FILTER (is_sync) END AS stss, 20 + 4 * count(*) AS stsz, 16 + 4 * count(*) FILTER (no) AS stco
  FROM (SELECT *, {_ISLANDS.format('duration')} AS nd, {_ISLANDS.format('composition_offset')} AS nc, coalesce(s."offset" <> lag(s."offset" + size) OVER w, true) AS no
    FROM s WINDOW w AS (PARTITION BY asset_id, track_id ORDER BY sample_index)) GROUP BY asset_id, track_id)
  UNPIVOT (box_size FOR path IN (stts, ctts, stss, stsz, stco))"""))
def box_sizes(spark, sf_dir: str) -> DataFrame:
    """The tables that the box walk finds, with their sizes; what a table leaves out costs no bytes."""
    found = box_walk(_files(spark, sf_dir)).select(*TRACK, F.substring_index("path", "/", -1).alias("path"), "box_size")
    return found.where(F.col("path").isin("stts", "ctts", "stss", "stsz", "stco"))


@_query(_with(SAMPLES_SQL, "SELECT asset_id, track_id, sample_index, size, decode_time, duration, composition_offset, is_sync FROM s"))
def fragment_round_trip(spark, sf_dir: str) -> DataFrame:
    """The series of each track, through fragments whose times carry on from one to the next."""
    schema = "asset_id long, track_id long, sample_index long, size long, decode_time long, duration long, composition_offset long, is_sync boolean"

    def through(group):
        c, track = _columns(group), group.column("track_id")[0].as_py()
        out, at, due = [], 0, 0
        for k in range(0, len(c["size"]), PER_FRAGMENT):
            one = {f: v[k : k + PER_FRAGMENT] for f, v in c.items()}
            moof = write_fragment(track, int(one["decode_time"][0]), one["duration"], one["size"], one["composition_offset"], one["is_sync"])
            rows, due = fragment_rows(moof, at, track, due)
            out += rows
            at += len(moof) + 8 + int(one["size"].sum())
        columns = list(zip(*out, strict=True))
        return pa.table({k: pa.array([group.column(k)[0].as_py()] * len(out), pa.int64()) for k in TRACK} | {"sample_index": np.arange(len(out))} | dict(zip(("size", "decode_time", "duration", "composition_offset", "is_sync"), map(pa.array, columns[1:]), strict=True)))

    return samples(spark, sf_dir).select(*TRACK, *_FIELDS).groupBy(*TRACK).applyInArrow(through, schema)


_TIDY = "trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ')"
_ESCAPED = f"replace(replace(replace({_TIDY}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _tidy():
    return F.trim(F.regexp_replace("text", "[ \t\r\n]+", " "))


def _documents(cues: DataFrame, cue, head: str, tail: str) -> DataFrame:
    """(conv_id, body): each conversation's cues by time, as one file."""
    per = cues.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "turn", "text", cue.alias("x")))).alias("l"))
    return per.select("conv_id", F.concat(F.lit(head), F.array_join(F.transform("l", lambda c: c["x"]), "\n"), F.lit(tail)).alias("body"))


_PLACED = "row_number() OVER (PARTITION BY conv_id ORDER BY start_ms, turn, text) - 1"


@_query(f"WITH {_CUE_SQL} SELECT conv_id, {_PLACED} AS cue, start_ms, end_ms, {_ESCAPED} AS text FROM cu WHERE {_TIDY} <> ''")
def srt_round_trip(spark, sf_dir: str) -> DataFrame:
    """Conversations as SRT files, read back into cues."""
    times = [F.replace(cue_time(F.col(c)), F.lit("."), F.lit(",")) for c in ("start_ms", "end_ms")]
    cues = _cues(spark, sf_dir)
    text = F.concat(F.col("turn").cast("string"), F.lit("\n"), times[0], F.lit(" --> "), times[1], F.lit(" X1:0\n"), F.replace(F.replace(F.replace(_tidy(), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\n"))
    return srt_cues(_documents(cues.where(_tidy() != ""), text, "", ""), "conv_id", "body")


@_query(f"WITH {_CUE_SQL} SELECT conv_id, {_PLACED} AS cue, start_ms + 1500 AS start_ms, end_ms + 1500 AS end_ms, {_ESCAPED} AS text FROM cu WHERE {_TIDY} <> ''")
def ttml_round_trip(spark, sf_dir: str) -> DataFrame:
    """Conversations as TTML whose cues count from a division's start, by begin and duration, read back into cues."""
    p = F.concat(F.lit('<p begin="'), cue_time(F.col("start_ms")), F.lit('" dur="'), (F.col("end_ms") - F.col("start_ms")).cast("string"), F.lit('ms">'), xml_escape(_tidy()), F.lit("</p>"))
    files = _documents(_cues(spark, sf_dir).where(_tidy() != ""), p, '<tt xmlns="http://www.w3.org/ns/ttml"><body begin="1s"><div begin="0.5s">', "</div></body></tt>")
    return ttml_files(files, "conv_id", "body")


@_query(f"""SELECT id, outcome, CASE WHEN outcome = 'ok' THEN [id::VARCHAR] END AS assets FROM (SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 7 = 0 THEN 'malformed' WHEN o_orderkey % 7 = 1 THEN 'wrong algorithm' WHEN o_orderkey % 7 = 2 THEN 'bad signature' WHEN o_orderkey % 2000 <= {NOW} THEN 'expired' ELSE 'ok' END AS outcome FROM orders)""")
def token_verify(spark, sf_dir: str) -> DataFrame:
    """A signed token an order: cut, of another algorithm, signed with another key, expired, or good."""
    claims = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("asset"), (F.col("o_orderkey") % 2000).alias("exp")))
    k = F.col("o_orderkey") % 7
    good = sign(claims, KEY)
    token = F.when(k == 0, F.substring_index(good, ".", 2)).when(k == 1, sign(claims, KEY, '{"alg":"none"}')).when(k == 2, sign(claims, WRONG_KEY)).otherwise(good)
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), token.alias("token"))
    return made.select("id", verify(F.col("token"), KEY, NOW).alias("v")).select("id", "v.*")


@_query(_with(PLAN_SQL, """SELECT asset_id, track_id, string_agg(concat('<S', CASE WHEN k = 1 THEN concat(' t="', decode_time, '"') ELSE '' END, ' d="', duration, '" />'), chr(10) ORDER BY segment_index) AS timeline
  FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, track_id ORDER BY segment_index) AS k FROM plan) GROUP BY asset_id, track_id"""))
def dash_timeline(spark, sf_dir: str) -> DataFrame:
    """The segment timeline of each track in a DASH manifest: only the first entry states its start."""
    per = segment_plan(samples(spark, sf_dir, reuse=True)).groupBy(*TRACK).agg(F.array_sort(F.collect_list(F.struct("segment_index", "decode_time", "duration"))).alias("l"))

    def entry(x, i):
        start = F.when(i == 0, F.concat(F.lit(' t="'), x["decode_time"].cast("string"), F.lit('"'))).otherwise(F.lit(""))
        return F.concat(F.lit("<S"), start, F.lit(' d="'), x["duration"].cast("string"), F.lit('" />'))

    return per.select(*TRACK, F.array_join(F.transform("l", entry), "\n").alias("timeline"))


@_query(f"""SELECT row_number() OVER (ORDER BY route, status) AS line, concat('requests_total{{route="', route, '",status="', status, '"}} ', n) AS text FROM ({CATALOG_SQL['requests_by_route']})""")
def metrics_text(spark, sf_dir: str) -> DataFrame:
    """Counters as lines of metrics text.  Routes and states are closed lists, so one task may number them."""
    line = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("route", "status")).cast("bigint")
    text = F.concat(F.lit('requests_total{route="'), F.col("route"), F.lit('",status="'), F.col("status").cast("string"), F.lit('"} '), F.col("n").cast("string"))
    return requests_by_route(spark, sf_dir).select(line.alias("line"), text.alias("text"))


@_query(f"""SELECT asset_id, concat('{{"asset":', asset_id, ',"tracks":', tracks, ',"segments":', segments, ',"bytes":', bytes, '}}') AS status FROM ({CATALOG_SQL['asset_rollup']})""")
def status_json(spark, sf_dir: str) -> DataFrame:
    return asset_rollup(spark, sf_dir).select("asset_id", F.to_json(F.struct(F.col("asset_id").alias("asset"), "tracks", "segments", "bytes")).alias("status"))


@_query("SELECT page_id, (octet_length(encode(html)) // 16 + 1) * 16 AS cipher_bytes, sha256(html) AS plain_sha256 FROM pages WHERE html IS NOT NULL")
def segment_cipher(spark, sf_dir: str) -> DataFrame:
    """AES-128-CBC of whole segments, the number as the IV, and back."""
    key = F.lit(bytes(range(16)))
    iv = F.unhex(F.lpad(F.hex("page_id"), 32, "0"))
    # the engine writes the IV before the cipher text; a player has it from the number
    cipher = F.aes_encrypt(F.col("html").cast("binary"), key, F.lit("CBC"), F.lit("PKCS"), iv)
    bare = F.substring(cipher, 17, 2_000_000_000)
    pages = table(spark, sf_dir, "pages").where("html is not null").select("page_id", iv.alias("iv"), bare.alias("cipher"))
    plain = F.aes_decrypt(F.concat("iv", "cipher"), key, F.lit("CBC"), F.lit("PKCS"))
    return pages.select("page_id", F.octet_length("cipher").cast("bigint").alias("cipher_bytes"), F.sha2(plain, 256).alias("plain_sha256"))


@_query("SELECT page_id, sha256(html) AS plain_sha256, octet_length(encode(html)) >= 16 AS changed, sha256(html) AS ctr_sha256 FROM pages WHERE html IS NOT NULL")
def sample_ciphers(spark, sf_dir: str) -> DataFrame:
    """Pattern CBC (one block of ten) and CTR of whole samples, and back."""
    data, key, iv = F.col("html").cast("binary"), F.lit(bytes(range(16))), F.unhex(F.lpad(F.hex("page_id"), 32, "F"))
    # each step is a column of its own: the next one names it many times
    pages = table(spark, sf_dir, "pages").where("html is not null").select("page_id", data.alias("data"), key.alias("key"), iv.alias("iv"))
    sealed = pages.select("*", pattern_encrypt(F.col("data"), F.col("key"), F.col("iv")).alias("sealed"), ctr(F.col("data"), F.col("key"), F.col("iv")).alias("counted"))
    plain = pattern_decrypt(F.col("sealed"), F.col("key"), F.col("iv"))
    return sealed.select("page_id", F.sha2(plain, 256).alias("plain_sha256"), (F.col("sealed") != F.col("data")).alias("changed"), F.sha2(ctr(F.col("counted"), F.col("key"), F.col("iv")), 256).alias("ctr_sha256"))


#: Limits of reading interleaved runs together: runs, and chunks that are held back.
MAX_RUNS, HELD_CHUNKS = 4, 4


def _reads_sql(name: str, order: str) -> str:
    """One gap-and-budget scan of pieces (asset_id, i, a, b), as recursion."""
    return f""",
{name}p AS (SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY {order}) AS k, a, b FROM pc),
{name}r AS (SELECT asset_id, k, a AS x, b AS y, 0::BIGINT AS spent, 0::BIGINT AS read, b - a <= {CHUNK} AS open FROM {name}p WHERE k = 1
  UNION ALL SELECT asset_id, k, CASE WHEN fits THEN x ELSE a END, b, CASE WHEN fits THEN spent + a - y ELSE spent END, CASE WHEN fits THEN read ELSE read + 1 END, fits OR b - a <= {CHUNK}
  FROM (SELECT p.*, r.x, r.y, r.spent, r.read, r.open AND p.a >= r.y AND p.a - r.y <= {MAX_GAP} AND r.spent + p.a - r.y <= {GAP_BUDGET} AND p.b - r.x <= {CHUNK} AS fits FROM {name}r r JOIN {name}p p ON p.asset_id = r.asset_id AND p.k = r.k + 1)),
{name}c AS (SELECT asset_id, count(*) AS reads, sum(n)::BIGINT AS bytes FROM (SELECT asset_id, read, max(y) - min(x) AS n FROM {name}r GROUP BY asset_id, read) GROUP BY asset_id)"""


@_query(_with(SAMPLES_SQL + """,
pc AS (SELECT asset_id, track_id * 10000000000 + sample_index AS i, "offset" AS a, "offset" + size AS b FROM s),
bk AS (SELECT *, sum(back::INT) OVER (PARTITION BY asset_id ORDER BY i) AS run FROM (SELECT *, a < coalesce(lag(b) OVER (PARTITION BY asset_id ORDER BY i), 0) AS back FROM pc)),
""" + f"""lm AS (SELECT asset_id, max(run) BETWEEN 1 AND {MAX_RUNS - 1} AND max(b - a) <= {CHUNK} AND sum(CASE WHEN run > 0 THEN b - a ELSE 0 END) <= {CHUNK * HELD_CHUNKS} AS may FROM bk GROUP BY asset_id)""" + _reads_sql("ap", "i") + _reads_sql("mg", "a, i"),
    "SELECT lm.asset_id, may AND m.bytes < t.bytes AS together, CASE WHEN may AND m.bytes < t.bytes THEN m.reads ELSE t.reads END AS reads, CASE WHEN may AND m.bytes < t.bytes THEN m.bytes ELSE t.bytes END AS bytes FROM lm JOIN apc t USING (asset_id) JOIN mgc m USING (asset_id)"))
def interleaved_reads(spark, sf_dir: str) -> DataFrame:
    """Reads of each asset's samples, track after track: by offset through all tracks where that reads fewer bytes.

    A new run starts where a piece lies before the end of the last one.  Too many runs, a piece longer than a chunk, or
    too much to hold back keep the runs apart.
    """
    return read_interleaved(samples(spark, sf_dir, reuse=True).select("asset_id", (F.col("track_id") * 10_000_000_000 + F.col("sample_index")).alias("i"), "offset", F.col("size").alias("length")), ["asset_id"], "i")


def read_interleaved(pieces: DataFrame, key: list[str], order: str, chunk: int = CHUNK) -> DataFrame:
    """(key, together, reads, bytes)"""
    w = Window.partitionBy(*key).orderBy(order)
    back = F.col("offset") < F.coalesce(F.lag(F.col("offset") + F.col("length")).over(w), F.lit(0))
    runs = pieces.withColumn("_back", back.cast("bigint")).withColumn("_run", F.sum("_back").over(w))
    limits = runs.groupBy(*key).agg(F.max("_run").alias("_last"), F.max("length").alias("_long"), F.sum(F.when(F.col("_run") > 0, F.col("length")).otherwise(0)).alias("_held"))
    may = F.col("_last").between(1, MAX_RUNS - 1) & (F.col("_long") <= chunk) & (F.col("_held") <= chunk * HELD_CHUNKS)
    cost = lambda df, by, name: gap_budget_reads(df, key, by, chunk=chunk).groupBy(*key).agg(F.count(F.lit(1)).alias(f"{name}_reads"), F.sum(F.col("end") - F.col("start")).alias(f"{name}_bytes"))
    apart = cost(pieces, order, "a")
    merged = cost(pieces.withColumn("_o", F.struct("offset", order)), "_o", "m")
    both = limits.join(apart, key).join(merged, key).withColumn("together", may & (F.col("m_bytes") < F.col("a_bytes")))
    return both.select(*key, "together", *[F.when(F.col("together"), F.col(f"m_{n}")).otherwise(F.col(f"a_{n}")).alias(n) for n in ("reads", "bytes")])


@_query(CATALOG_SQL["requests_by_route"])
def stream_requests(spark, sf_dir: str) -> DataFrame:
    """Requests a route and status, counted by a stream."""
    folder = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    e.write.parquet(f"{folder}/in")
    status = F.when(F.col("event_id") % 7 == 0, 404).when(F.col("event_id") % 7 == 1, 503).otherwise(200)
    stream = spark.readStream.schema(e.schema).parquet(f"{folder}/in").select(F.col("event_type").alias("route"), status.cast("bigint").alias("status"))
    counted(stream, ["route", "status"], folder)
    return spark.read.schema("route string, status long, n long").parquet(f"{folder}/out")


@_query(_with(SAMPLES_SQL + f""",
fr AS (SELECT asset_id, track_id, k, CASE WHEN k % 9 = 6 THEN t - 40000 WHEN k % 3 = 0 THEN t END AS st, du FROM (SELECT asset_id, track_id, sample_index // {PER_FRAGMENT} AS k, min(decode_time) AS t, sum(duration)::BIGINT AS du FROM s GROUP BY ALL)),
fo AS (SELECT asset_id, track_id, k, coalesce(st, 0) AS a, coalesce(st, 0) < 0 AS late, CASE WHEN coalesce(st, 0) < 0 THEN 0 ELSE coalesce(st, 0) + du END AS due, du FROM fr WHERE k = 0
  UNION ALL SELECT f.asset_id, f.track_id, f.k, coalesce(f.st, o.due), coalesce(f.st, o.due) < o.due, CASE WHEN coalesce(f.st, o.due) < o.due THEN o.due ELSE coalesce(f.st, o.due) + f.du END, f.du FROM fo o JOIN fr f ON f.asset_id = o.asset_id AND f.track_id = o.track_id AND f.k = o.k + 1)""",
    """SELECT asset_id, track_id, k AS fragment, a AS start, a + du AS "end", late FROM fo"""))
def stream_fragments(spark, sf_dir: str) -> DataFrame:
    """Fragments by a stream that stops once; of each three, two don't say when they start, and of each nine one starts before the one before has ended."""
    k = F.expr(f"sample_index div {PER_FRAGMENT}")
    parts = samples(spark, sf_dir).groupBy(*TRACK, k.alias("fragment")).agg(F.min("decode_time").alias("start"), F.sum("duration").alias("duration"))
    start = F.when(F.col("fragment") % 9 == 6, F.col("start") - 40_000).when(F.col("fragment") % 3 == 0, F.col("start"))
    parts = parts.withColumn("start", start)
    return in_parts([parts.where("fragment < 2"), parts.where("fragment >= 2")], ordered_fragments)


@_query(_with(BOUNDS_SQL, "SELECT asset_id, track_id, segment_index, first_sample, decode_time FROM cuts"))
def stream_boundaries(spark, sf_dir: str) -> DataFrame:
    """The greedy cuts, by a stream that stops once."""
    s = samples(spark, sf_dir).where("is_sync or sample_index = 0").select(*TRACK, "timescale", "sample_index", "decode_time", "is_sync")
    return in_parts([s.where("sample_index < 10"), s.where("sample_index >= 10")], lambda x: stream_cuts(x, TARGET_MS))
