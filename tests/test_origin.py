"""Rules of an origin on cases worked out by hand, and addresses against the standard library."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import origin as f

CASES = {
    "validator": (f.validator, [('"a"', "Mon", '"a"'), ('W/"a"', "Mon", "Mon"), (None, "Tue", "Tue"), ('W/"a"', None, None), ('"b"', None, '"b"')]),
    "content_range": (f.content_range_total, [
        ("bytes 0-9/100", 0, 9, 100), ("bytes 0-9/10", 0, 9, 10), ("bytes 0-9/9", 0, 9, None), ("bytes 1-9/100", 0, 9, None), ("bytes 0-9/*", 0, 9, None), ("items 0-9/100", 0, 9, None), (None, 0, 9, None), ("bytes 0-9/99999999999999999999", 0, 9, None),
    ]),
    "encoding": (f.negotiated, [
        ("gzip, br", "br"), ("gzip;q=1, br;q=0", "gzip"), ("x-gzip", "gzip"), ("*", "br"), ("*, br;q=0", "gzip"), ("*;q=0", "identity"), ("BR ; Q = 0.1", "br"), ("br;q=x", "identity"), ("br;q=0;q=1", "br"), ("br, br;q=0", "identity"), ("", "identity"), (None, "identity"),
    ]),
    "resource": (lambda p: F.to_json(f.resource(p)), [
        ("/hls/a/master.m3u8", '{"asset":"a"}'), ("/dash/b/video-hd/x", '{"asset":"b","rendition":"hd"}'), ("/hls/c/subtitles/en/index.m3u8", '{"asset":"c","subtitle":"en"}'), ("/hls//x", None), ("/other/a", None), ("hls/a", None), ("/hls/d", '{"asset":"d"}'),
    ]),
    "token": (f.carried_token, [("Bearer  t1 ", "token=t2", "token=t3", "t1"), ("Basic x", "a=1; token=t2", "token=t3", "t2"), (None, "tokens=1", "a=b&token=t3", "t3"), (None, None, None, None), ("bearer t4", None, None, "t4"), (None, "token=a=b", None, "a=b")]),
    "status": (f.error_status, [("not found", 404), ("upstream", 502), ("location rejected", 502), ("unavailable", 503), ("invalid media", 500), (None, 500)]),
    "language": (f.known_language, [("eng", "eng"), ("und", None), ("EN", None), ("deu", "deu"), ("en1", None), (None, None)]),
    "fourcc": (f.printable, [("avc1", "avc1"), ("a\x01b\x7f", "a?b?"), ("mp4é", "mp4?"), (None, None)]),
    "avc": (f.avc_codec, [(100, 0, 31, "avc1.64001f"), (66, 192, 30, "avc1.42c01e"), (77, 64, 10, "avc1.4d400a")]),
    "hevc": (f.hevc_codec, [
        ("hvc1", 1, 0x60000000, "900000000000", 60, "hvc1.1.6.L60.90"), ("hev1", 0x22, 0x20000000, "b00000000000", 120, "hev1.2.4.H120.B0"), ("hvc1", 0x41, 1, "000000000000", 93, "hvc1.A1.80000000.L93"), ("hvc1", 1, 6, "900100000000", 90, "hvc1.1.60000000.L90.90.1"),
    ]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases_by_hand(spark, name):
    rule, cases = CASES[name]
    lit = lambda x: F.lit(x).cast("string") if x is None else F.lit(x)
    got = spark.range(1).select(*[rule(*map(lit, c[:-1])).alias(f"c{i}") for i, c in enumerate(cases)]).first()
    assert list(got) == [c[-1] for c in cases]


def public(text):
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    if a.version == 6 and a.ipv4_mapped:
        a = a.ipv4_mapped
    nets = [f"{n}/{b}" for n, b in f.CLOSED_V4] if a.version == 4 else ["::/128", "::1/128", "ff00::/8", "fc00::/7", "fe80::/10", "2001:db8::/32"]
    return not any(a in ipaddress.ip_network(n) for n in nets)


def test_addresses(spark):
    rng = random.Random(5)
    texts = ["::", "::1", "::2", "1::", "1:2:3:4:5:6:7::", "1::2::3", ":::", ":1", "1:", "::ffff:10.0.0.1", "::FFFF:8.8.8.8", "64:ff9b::1.2.3.4", "::1.2.3.256", "1.2.3", "1.2.3.4.5", "256.1.1.1", "x", "12345::"]
    for _ in range(400):
        v6 = ipaddress.IPv6Address(rng.getrandbits(128) if rng.random() < 0.5 else rng.choice([0xFE80, 0xFEC0, 0xFC00, 0x20010DB8 >> 16, 0xFF02, 0x2606]) << 112 | rng.getrandbits(20))
        v4 = ipaddress.IPv4Address(rng.getrandbits(32))
        texts += [str(v6), v6.exploded, str(v4), f"::ffff:{v4}", str(v6).upper()]
    got = {r.t: r.is_public for r in f.public_addresses(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "is_public").collect()}
    assert got == {t: public(t) for t in texts}
