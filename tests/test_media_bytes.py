"""Bytes written out by hand from the formats' descriptions, and operators against plain Python."""

import random
import struct
from collections import OrderedDict

import pytest

from tickloom.operators.ordered import exact_quantiles, running_before
from tickloom.plans import status
from tickloom.sources.boxes import BoxError, box, boxes
from tickloom.sources.entries import (
    Bits, Cursor, aac_object_type, audio_entry, entry_codec, escaped, index_box, index_ranges, plain_audio, read_edits, read_protection, read_tracks, start_of_stream, subsegment_fragments, unescaped, units_tile, video_entry,
)


def test_bit_codes():
    bits = Bits(bytes.fromhex("a64280"))  # 1 010 011 00100 00101 and zeros
    assert [bits.unsigned() for _ in range(5)] == [0, 1, 2, 3, 4]
    signed = Bits(bytes.fromhex("a64280"))
    assert [signed.signed() for _ in range(5)] == [0, 1, -1, 2, -2]
    with pytest.raises(BoxError):
        Bits(b"\0").unsigned()
    assert unescaped(bytes.fromhex("000003010000030000030203")) == bytes.fromhex("00000100000000" + "0203")
    rng = random.Random(1)
    for _ in range(200):
        raw = bytes(rng.choices([0, 1, 2, 3, 255], k=rng.randint(0, 40)))
        assert unescaped(escaped(raw)) == raw and b"\0\0\1" not in escaped(raw) and b"\0\0\0" not in escaped(raw)


def test_esds():
    lc = "00000000" "0319000100" "041140150000000000000000000000" "05021190" "060102"
    assert aac_object_type(bytes.fromhex(lc)) == 2
    long_lengths = "00000000" "0380808022000100" "0480808014401500000000000000000000" "00" "0580808002" "2b11" "0680808001" "02"
    assert aac_object_type(bytes.fromhex(long_lengths)) == 5
    with pytest.raises(BoxError):
        aac_object_type(bytes.fromhex(lc.replace("041140", "041169")))


@pytest.mark.parametrize("name, config, codec", [
    ("avc1", box("avcC", bytes.fromhex("014d401effe1000100")), "avc1.4d401e"),
    ("hvc1", box("hvcC", bytes.fromhex("010160000000900000000000" "5d")), "hvc1.1.6.L93.90"),
    ("hev1", box("hvcC", bytes.fromhex("012220000000b00000000000" "78")), "hev1.2.4.H120.B0"),
    ("av01", box("av1C", bytes.fromhex("81080c00")), "av01.0.08M.08"),
    ("av01", box("av1C", bytes.fromhex("812de000")), "av01.1.13H.12"),
    ("vp09", box("vpcC", bytes.fromhex("01000000" "021fa0")), "vp09.02.31.10"),
])
def test_video_entries(name, config, codec):
    data = video_entry(name, 1920, 1080, config)
    assert len(data) == 8 + 78 + len(config)
    _, _, a, b = next(boxes(data))
    assert entry_codec(name, data[a:b]) == {"codec": codec, "width": 1920, "height": 1080, "rate": None, "channels": None}
    with pytest.raises(BoxError):
        entry_codec(name, data[a : a + 40])


def test_quicktime_audio_becomes_plain():
    esds = box("esds", bytes.fromhex("00000000" "0319000100" "041140150000000000000000000000" "05021190" "060102"))
    head = bytes(6) + b"\0\1"
    old = head + struct.pack(">HHIHHHHI", 1, 0, 0, 2, 16, 0xFFFE, 0, 48_000 << 16) + bytes(16) + box("wave", box("frma", b"mp4a"), esds) + box("chan", bytes(12))
    want = {"codec": "mp4a.40.2", "width": None, "height": None, "rate": 48_000, "channels": 2}
    assert entry_codec("mp4a", old) == want
    plain = plain_audio(old)
    assert entry_codec("mp4a", plain) == want and plain_audio(plain) == plain and plain == audio_entry("mp4a", 48_000, 2, esds)[8:]


def test_edit_list_bytes():
    v0 = bytes.fromhex("00000000" "00000002" "000001f4ffffffff00010000" "0000000000000400" "00010000")
    assert read_edits(v0) == (0, [(500, 0xFFFFFFFF, 1, 0), (0, 1024, 1, 0)])
    v1 = bytes.fromhex("01000000" "00000001" "00000000000003e8" "ffffffffffffffff" "00010000")
    assert read_edits(v1) == (1, [(1000, -1, 1, 0)])
    with pytest.raises(BoxError):
        read_edits(v1[:-1])


def test_movie_rules():
    from tickloom.sources.entries import movie_box, track_box

    entry = video_entry("avc1", 64, 36, box("avcC", bytes.fromhex("0164001fffe1000100")))
    one = lambda n: track_box(n, "vide", 90_000, 5, "eng", entry)
    inner = lambda moov: moov[8:]
    rows = list(read_tracks(inner(movie_box(1000, 9, one(1), one(2)))))
    assert [(r["track"], r["language"], r["codec"], r["extended"]) for r in rows] == [(1, "eng", "avc1.64001f", False), (2, "eng", "avc1.64001f", False)]
    for bad in (movie_box(1000, 9, one(1), one(1)), movie_box(0, 9, one(1))):
        with pytest.raises(BoxError):
            list(read_tracks(inner(bad)))
    start = start_of_stream(inner(movie_box(1000, 9, one(1), one(2))), [2])
    assert [n for n, *_ in boxes(start)] == ["ftyp", "moov"] and [(r["track"], r["duration"], r["extended"]) for r in read_tracks(start[start.index(b"moov") + 4 :])] == [(2, 0, True)]
    with pytest.raises(BoxError):
        start_of_stream(inner(movie_box(1000, 9, one(1))), [7])


def test_indexes():
    for version in (0, 1):
        data = index_box(10, [5, 6, 7, 8], version)
        _, _, a, b = next(boxes(data))
        assert index_ranges(data[a:b], b) == [(b + 10, b + 15), (b + 15, b + 21), (b + 21, b + 28), (b + 28, b + 36)]
    for sizes in ([5, 6, 7], [5, 6, 7, 0], [5, 6, 7, 1 << 31 | 8]):
        data = index_box(0, sizes)
        _, _, a, b = next(boxes(data))
        assert index_ranges(data[a:b], b) is None
    media = box("moof", b"x") + box("mdat", b"yy")
    assert subsegment_fragments(media * 2, 0, len(media)) == [0] and subsegment_fragments(media, 0, len(media) + 1) is None
    assert subsegment_fragments(media, 0, len(media) - 1) is None and subsegment_fragments(box("free"), 0, 8) is None


def test_units_and_cursor():
    assert units_tile(b"\0\1a\0\2bc", 2) and not units_tile(b"\0\1a\0\3bc", 2) and not units_tile(b"\0\0", 2) and units_tile(b"", 4)
    with pytest.raises(BoxError):
        Cursor(b"ab").take(3)


def test_lru_caches(spark):
    rng = random.Random(3)
    asked = [(c, i, rng.randrange(12), 0) for i in range(600) for c in [rng.randrange(3)]]
    asked = [(c, i, a, 10 + a * 7 + (200 if a == 11 else 0)) for c, i, a, _ in asked]
    df = spark.createDataFrame(asked, "cache long, event_id long, asset long, weight long").repartition(5)
    got = sorted(tuple(r) for r in status.lru(df, 120).select("event_id", "outcome", "evicted", "bytes").collect())
    used: dict[int, OrderedDict] = {}
    want = []
    for c, i, a, w in asked:
        own = used.setdefault(c, OrderedDict())
        if a in own:
            own.move_to_end(a)
            want.append((i, "hit", 0, sum(own.values())))
        elif w > 120:
            want.append((i, "too heavy", 0, sum(own.values())))
        else:
            n = 0
            while sum(own.values()) + w > 120:
                own.popitem(last=False)
                n += 1
            own[a] = w
            want.append((i, "miss", n, sum(own.values())))
    assert got == want


def test_running_sums_and_quantiles_by_ranges(spark):
    """Ties, one value that a third of the rows have, nulls and an empty table."""
    rng = random.Random(4)
    rows = [(i, rng.choice([7, rng.randrange(100)]), rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, x long, n long")
    got = {r.i: r.before for r in running_before(df, ["x", "i"], "n", "before").collect()}
    total = 0
    for i, _, n in sorted(rows, key=lambda r: (r[1], r[0])):
        assert got[i] == total
        total += n
    assert running_before(df.limit(0), ["x", "i"], "n", "before").count() == 0
    q = exact_quantiles(spark.createDataFrame([("a", float(x)) for _, x, _ in rows] + [("b", 1.0), ("a", None)], "k string, v double"), ["k"], "v", {"p50": 0.5, "p100": 1.0}).orderBy("k").collect()
    xs = sorted(x for _, x, _ in rows)
    assert [tuple(r) for r in q] == [("a", float(xs[249]), float(xs[-1])), ("b", 1.0, 1.0)]


def test_sample_protection_bytes():
    two = bytes.fromhex("00000002" "00000002" "0102030405060708" "0002" "0010" "00000020" "0001" "00000003" "1112131415161718" "0000")
    assert read_protection(two, 8, 2) == ([bytes.fromhex("0102030405060708"), bytes.fromhex("1112131415161718")], [0, 2, 2], [(16, 32), (1, 3)])
    assert read_protection(bytes.fromhex("00000000" "00000003"), 0, 3) == ([b""] * 3, [0] * 4, [])
    for bad, size, n in ((two, 8, 3), (two[:-1], 8, 2), (two + b"x", 8, 2), (two, 12, 2)):
        with pytest.raises(BoxError):
            read_protection(bad, size, n)
