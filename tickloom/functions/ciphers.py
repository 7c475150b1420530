"""AES-128 of media samples by column expressions: pattern CBC and CTR, and back.

The engine's cipher pads and writes its IV; the expressions here take that off again.  What is
joined block by block is joined as hex, which is linear in the sample's length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _aes(data: Column, key: Column, iv: Column) -> Column:
    """CBC of whole blocks, without IV and padding."""
    return _let(data, lambda d: F.when(F.octet_length(d) == 0, d).otherwise(F.substring(F.aes_encrypt(d, key, F.lit("CBC"), F.lit("PKCS"), iv), F.lit(17), F.octet_length(d))))


def _aes_back(cipher: Column, key: Column, iv: Column) -> Column:
    """CBC of whole blocks undone.  The engine expects padding: the block that it would have is the cipher of nothing after the last one."""

    def undone(c):
        last = F.substring(c, F.octet_length(c) - 15, F.lit(16))
        padding = F.substring(F.aes_encrypt(F.lit(b""), key, F.lit("CBC"), F.lit("PKCS"), last), 17, 16)
        return F.when(F.octet_length(c) == 0, c).otherwise(F.aes_decrypt(F.concat(iv, c, padding), key, F.lit("CBC"), F.lit("PKCS")))

    return _let(cipher, undone)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside a lambda it would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _block(data: Column, i: Column) -> Column:
    return F.hex(F.substring(data, (i * 16 + 1).cast("int"), F.lit(16)))


def _numbers(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def _pattern(data: Column, key: Column, iv: Column, crypt: int, skip: int, cipher) -> Column:
    blocks = F.floor(F.octet_length(data) / 16).cast("bigint")
    own = F.filter(_numbers(blocks), lambda i: i % (crypt + skip) < crypt)
    text = cipher(F.unhex(F.array_join(F.transform(own, lambda i: _block(data, i)), "")), key, iv)

    def scattered(done):
        def each(i):
            rank = F.floor(i / (crypt + skip)) * crypt + i % (crypt + skip)
            return F.when(i % (crypt + skip) < crypt, _block(done, rank)).otherwise(_block(data, i))

        return F.array_join(F.transform(_numbers(blocks), each), "")

    tail = F.substring(data, (blocks * 16 + 1).cast("int"), F.lit(16))
    return F.concat(F.unhex(_let(text, scattered)), tail)


def pattern_encrypt(data: Column, key: Column, iv: Column, crypt: int = 1, skip: int = 9) -> Column:
    """CBC over crypt blocks of each crypt + skip, chained over what lies between; a partial block at the end stays clear."""
    return _pattern(data, key, iv, crypt, skip, _aes)


def pattern_decrypt(data: Column, key: Column, iv: Column, crypt: int = 1, skip: int = 9) -> Column:
    return _pattern(data, key, iv, crypt, skip, _aes_back)


def ctr(data: Column, key: Column, iv: Column) -> Column:
    """CTR with a 16-byte counter whose last eight bytes count, wrapping; the same in both directions."""
    blocks = F.ceil(F.octet_length(data) / 16).cast("bigint")
    high = F.hex(F.substring(iv, 1, 8))
    # the low half in two parts of 32 bits, so that nothing leaves BIGINT
    upper, lower = (F.conv(F.hex(F.substring(iv, p, 4)), 16, 10).cast("bigint") for p in (9, 13))

    def counter(i):
        total = lower + i
        carry = (upper + F.shiftright(total, 32)) % 4_294_967_296
        return F.concat(high, F.lpad(F.hex(carry), 8, "0"), F.lpad(F.hex(total % 4_294_967_296), 8, "0"))

    stream = F.aes_encrypt(F.unhex(F.array_join(F.transform(_numbers(blocks), counter), "")), key, F.lit("ECB"), F.lit("PKCS"))

    def word(b, i):
        return F.conv(F.rpad(F.hex(F.substring(b, (i * 4 + 1).cast("int"), F.lit(4))), 8, "0"), 16, 10).cast("bigint")

    def words(keys):
        return F.array_join(F.transform(_numbers(blocks * 4), lambda i: F.lpad(F.hex(word(data, i).bitwiseXOR(word(keys, i))), 8, "0")), "")

    return F.substring(F.unhex(_let(stream, words)), F.lit(1), F.octet_length(data))
