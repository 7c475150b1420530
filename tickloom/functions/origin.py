"""Column expressions of an origin server: validators, ranges, addresses, encodings, paths, tokens, codec strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: IPv4 networks that aren't public, as first address and prefix length
CLOSED_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def validator(etag: Column, last_modified: Column) -> Column:
    """What a range request is tied to: a strong tag, else the date, else nothing."""
    return F.coalesce(F.when(~etag.startswith("W/"), etag), last_modified)


def content_range_total(header: Column, first: Column, last: Column) -> Column:
    """The object's length if the header echoes the bytes that were asked for, else null."""
    a, b, n = (F.regexp_extract(header, "^bytes ([0-9]+)-([0-9]+)/([0-9]+)$", i).try_cast("bigint") for i in (1, 2, 3))
    return F.when((a == first) & (b == last) & (n > last), n)


def v4_number(address: Column) -> Column:
    part = [F.regexp_extract(address, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$", i).try_cast("bigint") for i in range(1, 5)]
    number = part[0] * 16_777_216 + part[1] * 65_536 + part[2] * 256 + part[3]
    return F.when(F.greatest(*part) <= 255, number)


def public_v4(address: Column) -> Column:
    """Whether an address in dotted form may be fetched from; null for what is no address."""
    n = v4_number(address)
    closed = F.lit(False)
    for start, bits in CLOSED_V4:
        a = 0
        for octet in start.split("."):
            a = a * 256 + int(octet)
        closed = closed | n.between(a, a + 2 ** (32 - bits) - 1)
    return ~closed


def public_addresses(df: DataFrame, address: str, name: str) -> DataFrame:
    """df with whether an address of either kind may be fetched from (null for what is none); one that is mapped from the other kind goes by that kind's rules.

    Each step is a column of its own: the next one names it many times.
    """
    a = F.col(address)
    step = df.withColumn("_dotted", F.regexp_extract(a, r":([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)).withColumn("_n", v4_number(F.col("_dotted")))
    n, dotted = F.col("_n"), F.col("_dotted")
    tail = F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(F.lit(65_535))))
    text = F.lower(F.when(dotted != "", F.concat(F.left(a, F.length(a) - F.length(dotted)), tail)).otherwise(a))
    step = step.withColumn("_text", text).withColumn("_sides", F.split("_text", "::", -1))
    side = lambda i: F.when(F.get("_sides", F.lit(i)) == "", F.array().cast("array<string>")).otherwise(F.split(F.get("_sides", F.lit(i)), ":"))
    step = step.withColumn("_l", side(0)).withColumn("_r", side(1)).withColumn("_missing", 8 - F.size("_l") - F.size("_r"))
    filled = F.concat("_l", F.array_repeat(F.lit("0"), F.greatest("_missing", F.lit(0))), "_r")
    groups = F.when(F.size("_sides") == 1, F.split("_text", ":")).when((F.size("_sides") == 2) & (F.col("_missing") >= 1), filled)
    step = step.withColumn("_w", groups)
    ok = (F.size("_w") == 8) & F.forall("_w", lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    step = step.withColumn("_g", F.when(ok, F.transform("_w", lambda g: F.conv(g, 16, 10).cast("bigint"))))
    g = [F.get("_g", F.lit(i)) for i in range(8)]
    zeros = lambda k: F.forall(F.slice("_g", 1, k), lambda x: x == 0)
    mapped = zeros(5) & (g[5] == 0xFFFF)
    octets = F.concat_ws(".", *[F.shiftright(g[6] * 65_536 + g[7], k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)])
    step = step.withColumn("_v4", F.when(~a.contains(":"), a).when(mapped, octets)).withColumn("_v4_open", public_v4(F.col("_v4")))
    within = lambda mask, value: g[0].bitwiseAND(F.lit(mask)) == value
    closed = (zeros(7) & (g[7] <= 1)) | within(0xFF00, 0xFF00) | within(0xFE00, 0xFC00) | within(0xFFC0, 0xFE80) | ((g[0] == 0x2001) & (g[1] == 0x0DB8))
    verdict = F.when(F.col("_v4").isNotNull(), F.col("_v4_open")).when(F.col("_g").isNotNull(), ~closed)
    return step.select(*df.columns, verdict.alias(name))


def negotiated(header: Column) -> Column:
    """br, gzip or identity.  Weights only say whether a coding is acceptable; the last word on a coding counts."""

    def item(x):
        parts = F.transform(F.split(x, ";"), lambda p: F.trim(p))
        weights = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: p.rlike(r"(?i)^q\s*="))
        q = F.try_element_at(weights, F.lit(-1))
        ok = q.isNull() | F.coalesce(F.regexp_replace(q, r"^[^=]*=\s*", "").try_cast("double") > 0, F.lit(False))
        return F.struct(F.lower(F.get(parts, F.lit(0))).alias("coding"), ok.alias("ok"))

    items = F.transform(F.split(F.coalesce(header, F.lit("")), ","), item)

    def said(*codings):
        return F.try_element_at(F.transform(F.filter(items, lambda x: x["coding"].isin(*codings)), lambda x: x["ok"]), F.lit(-1))

    other = F.coalesce(said("*"), F.lit(False))
    return F.when(F.coalesce(said("br"), other), "br").when(F.coalesce(said("gzip", "x-gzip"), other), "gzip").otherwise("identity")


def resource(path: Column) -> Column:
    """struct<asset, rendition, subtitle> that a playlist path names; null for other paths."""
    part = F.split(path, "/")
    at = [F.get(part, F.lit(i)) for i in range(5)]
    named = (at[0] == "") & at[1].isin("hls", "dash") & (at[2] != "")
    rendition = F.when(at[3].startswith("video-"), F.regexp_replace(at[3], "^video-", ""))
    return F.when(named, F.struct(at[2].alias("asset"), rendition.alias("rendition"), F.when(at[3] == "subtitles", at[4]).alias("subtitle")))


def carried_token(authorization: Column, cookie: Column, query: Column, name: str = "token") -> Column:
    """The first transport that has a token decides: bearer header, cookie, query."""
    bearer = F.when(authorization.rlike("(?i)^bearer "), F.trim(F.regexp_replace(authorization, "^[^ ]* ", "")))

    def among(c, sep):
        pairs = F.filter(F.transform(F.split(c, sep), lambda p: F.trim(p)), lambda p: p.startswith(f"{name}="))
        return F.trim(F.regexp_replace(F.get(pairs, F.lit(0)), "^[^=]*=", ""))

    return F.coalesce(bearer, among(cookie, ";"), among(query, "&"))


def known_language(c: Column) -> Column:
    return F.when(c.rlike("^[a-z]{3}$") & (c != "und"), c)


def packed_language(c: Column) -> Column:
    """Three letters of five bits each."""
    return F.concat(*[F.char(F.shiftright(c, k).bitwiseAND(F.lit(31)) + 96) for k in (10, 5, 0)])


def error_status(kind: Column) -> Column:
    """Status of an error's class; what isn't the origin's fault is the server's."""
    return F.when(kind == "not found", 404).when(kind.isin("upstream", "location rejected"), 502).when(kind == "unavailable", 503).otherwise(500).cast("bigint")


def printable(fourcc: Column) -> Column:
    return F.regexp_replace(fourcc, "[^ -~]", "?")


def avc_codec(profile: Column, compatibility: Column, level: Column) -> Column:
    return F.format_string("avc1.%02x%02x%02x", profile, compatibility, level)


def hevc_codec(tag: Column, profile: Column, compatibility: Column, constraints: Column, level: Column) -> Column:
    """profile: the byte with space, tier and number; constraints: six bytes in hex; compatibility: 32 bits, written in reverse."""
    space = F.get(F.array(*map(F.lit, ("", "A", "B", "C"))), F.shiftright(profile, 6).cast("int"))
    bits = F.reverse(F.lpad(F.bin(compatibility), 32, "0"))
    used = F.regexp_replace(F.upper(constraints), "(00)+$", "")
    used = F.when(F.length(used) % 2 == 1, F.concat(used, F.lit("0"))).otherwise(used)
    dotted = F.regexp_replace(F.regexp_replace(used, "(..)", ".$1"), r"\.0(.)", ".$1")
    tier = F.when(profile.bitwiseAND(F.lit(32)) == 0, "L").otherwise("H")
    return F.concat(tag, F.lit("."), space, profile.bitwiseAND(F.lit(31)).cast("string"), F.lit("."), F.conv(bits, 2, 16), F.lit("."), tier, level.cast("string"), dotted)
