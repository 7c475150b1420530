"""Signed access tokens (HS256), made and checked by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TOKEN, MAX_ASSETS = 8192, 256


def base64url(c: Column) -> Column:
    """Of binary, without padding."""
    return F.translate(F.regexp_replace(F.base64(c), "[=\r\n]", ""), "+/", "-_")


def unbase64url(c: Column) -> Column:
    """Binary, or null for what base64url wouldn't write."""
    padded = F.concat(F.translate(c, "-_", "+/"), F.repeat(F.lit("="), (F.lit(4) - F.length(c) % 4) % 4))
    return F.when(c.rlike("^[A-Za-z0-9_-]+$") & (F.length(c) % 4 != 1), F.unbase64(padded))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Binary.  The two padded keys are constants of the plan."""
    if len(key) > 64:
        raise ValueError("keys have 64 bytes at most")
    inner, outer = (F.lit(bytes(b ^ pad for b in key.ljust(64, b"\0"))) for pad in (0x36, 0x5C))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256))


def sign(claims: Column, key: bytes, header: str = '{"alg":"HS256"}') -> Column:
    signed = F.concat_ws(".", base64url(F.lit(header).cast("binary")), base64url(claims.cast("binary")))
    return F.concat_ws(".", signed, base64url(hmac_sha256(signed, key)))


def verify(token: Column, key: bytes, now: float, skew: float = 0) -> Column:
    """struct<outcome, assets>: ok, or the first rule that the token breaks.  The signature is checked before any claim is read."""
    part = F.split(token, r"\.", -1)
    piece = [F.get(part, F.lit(i)) for i in range(3)]
    header, claims = (F.decode(unbase64url(p), "UTF-8") for p in piece[:2])
    own = hmac_sha256(F.concat_ws(".", piece[0], piece[1]), key)
    json = lambda c, k: F.get_json_object(c, f"$.{k}")
    expires, after = (json(claims, k).try_cast("double") for k in ("exp", "nbf"))
    asset = json(claims, "asset")
    assets = F.when(asset.startswith("["), F.from_json(asset, "array<string>")).otherwise(F.array(asset))
    outcome = (
        F.when(F.length(token) > MAX_TOKEN, "too large")
        .when((F.size(part) != 3) | F.exists(part, lambda p: p == "") | header.isNull() | claims.isNull() | unbase64url(piece[2]).isNull(), "malformed")
        .when((F.coalesce(json(header, "alg"), F.lit("")) != "HS256") | json(header, "crit").isNotNull(), "wrong algorithm")
        .when(own != unbase64url(piece[2]), "bad signature")
        .when(expires.isNull(), "malformed")
        .when(expires + skew <= now, "expired")
        .when(after > now + skew, "not yet valid")
        .when(asset.isNull() | F.coalesce(F.size(assets) == 0, F.lit(True)) | (F.size(assets) > MAX_ASSETS), "malformed")
        .otherwise("ok")
    )
    return F.struct(outcome.alias("outcome"), F.when(outcome == "ok", assets).alias("assets"))
