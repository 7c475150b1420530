"""Bytes, captions, tokens, read plans and streams against hand-made cases and plain Python."""

import random
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.captions import CaptionError, caption_kind, srt_cues, srt_time, ttml_cues, ttml_time
from tickloom.functions.ciphers import ctr, pattern_decrypt, pattern_encrypt
from tickloom.functions.tokens import hmac_sha256, sign, verify
from tickloom.plans.formats import read_interleaved
from tickloom.sources import boxes as b
from tickloom.streaming.ingest import in_parts, ordered_fragments


def series(rng, n):
    size, duration = rng.integers(0, 50, n), rng.choice([0, 512, 1024], n)
    gap = np.where(rng.random(n) < 0.2, 100, 0)
    return np.cumsum(size + gap) - size, size, duration, rng.integers(-1024, 1024, n), rng.random(n) < 0.4


@pytest.mark.parametrize("seed", range(30))
def test_sample_tables_round_trip(seed):
    rng = np.random.default_rng(seed)
    offset, size, duration, composition, sync = series(rng, int(rng.integers(0, 40)))
    stbl = b.write_sample_tables(offset, size, duration, composition, sync)
    got = b.sample_rows(b.sample_tables(stbl, 8))
    want = {"offset": offset, "size": size, "decode_time": np.cumsum(duration) - duration, "duration": duration, "composition_offset": composition, "is_sync": sync}
    for k, v in want.items():
        assert got[k].tolist() == v.tolist(), k
    if len(size):
        with pytest.raises(b.BoxError):
            b.sample_rows(b.sample_tables(stbl, 8), source_len=int((offset + size).max()) - 1)


def test_packed_sizes():
    def sizes(bits, data, n):
        parts = [b.full_box("stts", struct.pack(">III", 1, n, 1)), b.full_box("stsc", struct.pack(">IIII", 1, 1, n, 1)), b.full_box("stco", struct.pack(">II", 1, 0)), b.full_box("stz2", struct.pack(">II", bits, n), data)]
        return b.sample_tables(b"".join(parts))["sizes"].tolist()

    assert sizes(4, bytes.fromhex("123450"), 5) == [1, 2, 3, 4, 5]
    assert sizes(8, b"\x07\x09", 2) == [7, 9] and sizes(16, b"\x01\x00\x00\x02", 2) == [256, 2]
    with pytest.raises(b.BoxError):
        sizes(16, b"\x01", 1)


def test_box_lengths():
    wide = struct.pack(">I4sQ", 1, b"free", 20) + b"abcd"
    open_end = struct.pack(">I4s", 0, b"mdat") + b"rest"
    assert [(n, s, e) for n, s, _, e in b.boxes(wide + open_end)] == [("free", 0, 20), ("mdat", 20, 32)]
    for bad in (b"\0\0\0", struct.pack(">I4s", 7, b"free"), struct.pack(">I4s", 99, b"free"), struct.pack(">I4s", 1, b"free")):
        with pytest.raises(b.BoxError):
            list(b.boxes(bad))
    moof = b.write_fragment(1, 0, *(np.array([1]),) * 2, np.array([0]), np.array([True]))
    data = b.box("moov") + moof + b.box("mdat", b"x") + moof + b.box("mdat", b"xyz")
    assert len(b.keep_header(data)[1]) == 2 and len(b.keep_header(data[:-1])[1]) == 1


def test_fragment_rules():
    run = b.full_box("trun", struct.pack(">IiI", 3, 100, 0), flags=b.DATA_OFFSET | b.FIRST_FLAGS)
    head = b.full_box("tfhd", struct.pack(">III", 1, 10, 60), flags=b.BASE_IS_MOOF | b.DEFAULT_DURATION | b.DEFAULT_SIZE)
    moof = b.box("moof", b.box("traf", head, b.full_box("tfdt", struct.pack(">I", 50)), run))
    rows, due = b.fragment_rows(moof, 1000, 1, 0, (0, 0, b.NON_SYNC_FLAGS))
    assert rows == [(1100, 60, 50, 10, 0, True), (1160, 60, 60, 10, 0, False), (1220, 60, 70, 10, 0, False)] and due == 80
    with pytest.raises(b.BoxError):
        b.fragment_rows(moof, 1000, 1, 51)
    assert b.fragment_rows(moof, 1000, 2, 7) == ([], 7)


def test_srt(spark):
    body = "﻿1\r\n00:00:01,5 --> 00:00:02.750 X1:0\r\n<B>Hi</B> <font color='x'>{\\an8}a < b & c &amp; d\r\nmore\r\n\r\n\r\n2\r\n0:0:0,100 --> 00:00:00,200\r\nfirst\r\n\r\n3\r\n00:00:05,000 --> 00:00:05,000\r\nempty\r\n"
    df = spark.createDataFrame([(1, body), (2, "1\n00:99:00,0 --> 00:00:01,0\nx"), (3, ""), (4, None)], "id long, body string")
    got = [tuple(r) for r in srt_cues(df, "id", "body").orderBy("id", "cue").collect()]
    assert got == [(1, 0, 100, 200, "first"), (1, 1, 1500, 2750, "<b>Hi</b> a &lt; b &amp; c &amp; d\nmore"), (2, 0, None, None, None), (3, 0, None, None, None)]
    times = spark.createDataFrame([("1:02:03,04",), ("1:2",), ("00:00:60,0",), (None,)], "t string")
    assert [r[0] for r in times.select(srt_time(F.col("t"))).collect()] == [3_723_040, None, None, None]
    kinds = spark.createDataFrame([("WEBVTT\n\n",), ("<?xml version='1.0'?><tt xmlns='x'>",), (body,), ("hello",)], "t string")
    assert [r[0] for r in kinds.select(caption_kind(F.col("t"))).collect()] == ["webvtt", "ttml", "srt", None]


def test_ttml():
    assert [ttml_time(t, Fraction(30000, 1001), 10) for t in ("00:00:01.5", "00:00:01:15", "1.5h", "2m", ".5s", "7ms", "30f", "5t")] == [1500, 1501, 5_400_000, 120_000, 500, 7, 1001, 500]
    with pytest.raises(CaptionError):
        ttml_time("1:2:3")
    head = '<tt xmlns="http://www.w3.org/ns/ttml" xmlns:tts="http://www.w3.org/ns/ttml#styling" xmlns:ttp="http://www.w3.org/ns/ttml#parameter" {}><head><styling><style xml:id="s" tts:fontStyle="italic"/></styling></head>{}</tt>'
    body = '<body begin="10s" dur="10s"><div><p begin="1s">a <span style="s">b</span>\n <br/> c &lt;</p><p begin="0s" end="0.5s">first</p><p begin="20s">late</p></div></body>'
    assert ttml_cues(head.format("", body)) == [(10_000, 10_500, "first"), (11_000, 20_000, "a <i>b</i>\nc &lt;")]
    for bad in ("<tt/>", "<x", head.format('ttp:timeBase="smpte"', ""), "<!DOCTYPE x>" + head.format("", "")):
        with pytest.raises(CaptionError):
            ttml_cues(bad)


def test_tokens(spark):
    import hashlib
    import hmac

    key = b"k" * 20
    df = spark.createDataFrame([('{"asset":["a","b"],"exp":100}',), ('{"asset":"a","exp":100,"nbf":99}',), ('{"asset":"a","exp":5}',), ('{"asset":[],"exp":100}',), ('{"asset":"a"}',)], "c string")
    got = df.select(verify(sign(F.col("c"), key), key, 50).alias("v"), hmac_sha256(F.col("c"), key).alias("h"), "c").collect()
    assert [r.v.outcome for r in got] == ["ok", "not yet valid", "expired", "malformed", "malformed"] and got[0].v.assets == ["a", "b"]
    assert all(bytes(r.h) == hmac.new(key, r.c.encode(), hashlib.sha256).digest() for r in got)
    bad = spark.createDataFrame([("a.b",), ("a..c",), ("!.b.c",), ("",), ("x" * 9000,)], "t string").select(verify(F.col("t"), key, 0).alias("v")).collect()
    assert [r.v.outcome for r in bad] == ["malformed"] * 4 + ["too large"]


def _plain_reads(pieces, chunk, max_gap=65_536, budget=262_144):
    reads, spent = [], 0
    for a, n in pieces:
        if reads and reads[-1][2]:
            gap = a - reads[-1][1]
            if 0 <= gap <= max_gap and spent + gap <= budget and a + n - reads[-1][0] <= chunk:
                reads[-1][1], spent = a + n, spent + gap
                continue
        reads.append([a, a + n, n <= chunk])
    return reads


def test_interleaved(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(12):
        tracks = rng.randrange(1, 6)
        at, placed = 0, [[] for _ in range(tracks)]
        for _ in range(rng.randrange(1, 15)):
            for t in placed:
                n = rng.randrange(1, 40_000)
                t.append((at, n))
                at += n + rng.choice([0, 0, 30_000])
        flat = [p for t in placed for p in t]
        rows += [(k, i, *p) for i, p in enumerate(flat)]
        chunk = 200_000
        cost = [(len(r), sum(e - s for s, e, _ in r)) for r in (_plain_reads(flat, chunk), _plain_reads(sorted(flat), chunk))]
        runs = 1 + sum(b[0] < a[0] + a[1] for a, b in zip(flat, flat[1:], strict=False))
        first = next((i for i in range(1, len(flat)) if flat[i][0] < sum(flat[i - 1])), len(flat))
        together = 2 <= runs <= 4 and sum(n for _, n in flat[first:]) <= 4 * chunk and cost[1][1] < cost[0][1]
        want[k] = (together, *cost[together])
    df = spark.createDataFrame(rows, "k long, i long, offset long, length long")
    got = {r.k: (r.together, r.reads, r.bytes) for r in read_interleaved(df, ["k"], "i", chunk=200_000).collect()}
    assert got == want and any(w[0] for w in want.values()) and not all(w[0] for w in want.values())


def test_late_fragments(spark):
    schema = "asset_id long, track_id long, fragment long, start long, duration long"
    parts = [[(1, 1, 0, 0, 10), (1, 1, 1, None, 10)], [(1, 1, 2, 15, 10), (1, 1, 3, None, 5), (1, 1, 4, 40, 1)]]
    got = in_parts([spark.createDataFrame(p, schema) for p in parts], ordered_fragments)
    assert [tuple(r)[2:] for r in got.orderBy("fragment").collect()] == [(0, 0, 10, False), (1, 10, 20, False), (2, 15, 25, True), (3, 20, 25, False), (4, 40, 41, False)]


def test_ciphers(spark):
    # fixed values: the public AES-128 examples of NIST SP 800-38A, F.2.1 and F.5.1
    key, iv, counter = (bytes.fromhex(x) for x in ("2b7e151628aed2a6abf7158809cf4f3c", "000102030405060708090a0b0c0d0e0f", "f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff"))
    plain = bytes.fromhex("6bc1bee22e409f96e93d7e117393172a" "ae2d8a571e03ac9c9eb76fac45af8e51")
    cbc = bytes.fromhex("7649abac8119b246cee98e9b12e9197d" "5086cb9b507219ee95db113a917678b2")
    counted = bytes.fromhex("874d6191b620e3261bef6864990db6ce" "9806f66b7970fdff8617187bb9fffdff")

    def run(f, *texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d binary")
        return [bytes(r[0]) for r in df.orderBy("i").select(f(F.col("d"))).collect()]

    k, v, c = F.lit(key), F.lit(iv), F.lit(counter)
    assert run(lambda d: pattern_encrypt(d, k, v, 1, 0), plain, plain + b"tail", b"", b"short") == [cbc, cbc + b"tail", b"", b"short"]
    spaced = plain[:16] + b"n" * 144 + plain[16:] + b"x"
    assert run(lambda d: pattern_encrypt(d, k, v), spaced) == [cbc[:16] + b"n" * 144 + cbc[16:] + b"x"]
    assert run(lambda d: pattern_decrypt(d, k, v), cbc[:16] + b"n" * 144 + cbc[16:] + b"x") == [spaced]
    assert run(lambda d: ctr(d, k, c), plain, plain[:21], b"", counted) == [counted, counted[:21], b"", plain]
