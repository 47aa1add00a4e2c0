"""Content hashes: MD5, SHA-1, SHA-256 and length of the bytes, 76 bytes in all, as binary or lower-case hex."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of the parts and of the whole.
PARTS = {"md5": (1, 16), "sha1": (17, 20), "sha256": (37, 32), "length": (69, 8)}
SIZE = 76
#: All bytes and their places in signed order, as characters; places count from 1, as translate drops what is turned into 0.
_BYTES, _RANKS = "".join(map(chr, range(256))), "".join(chr((b ^ 128) + 1) for b in range(256))


def content_hash(data: Column, padding: Column | None = None) -> Column:
    """Hex content hash of a string's UTF-8 bytes or of binary; padding is appended first and counts in the length."""
    data = data.cast("binary")
    if padding is not None:
        data = F.concat(data, padding.cast("binary"))
    length = F.lpad(F.lower(F.hex(F.octet_length(data).cast("long"))), 16, "0")
    return F.concat(F.md5(data), F.sha1(data), F.sha2(data, 256), length)


def order_key(hash_hex: Column) -> Column:
    """A string that sorts hex hashes as signed bytes do: 80 is the lowest byte, 7f the highest. One character a byte, from 1 to 256."""
    return F.translate(F.decode(F.unhex(hash_hex), "ISO-8859-1"), _BYTES, _RANKS)


def part(hash_hex: Column, name: str) -> Column:
    """One part of a hex hash; the length as a number."""
    at, size = PARTS[name]
    text = F.substring(hash_hex, at * 2 - 1, size * 2)
    return F.conv(text, 16, 10).cast("long") if name == "length" else text


def to_base64(hash_hex: Column) -> Column:
    """104 characters without line breaks, whatever the session's chunking."""
    return F.regexp_replace(F.base64(F.unhex(hash_hex)), r"[\r\n]", "")


def parse_hash(text: Column) -> Column:
    """Hex of a hash written in base 16 (152 characters) or base 64 (104), spaces around it dropped; else null."""
    t = F.trim(text)
    hexed = F.when(F.length(t) == 2 * SIZE, F.when(t.rlike("^[0-9a-fA-F]+$"), F.lower(t)))
    in64 = F.when((F.length(t) == 104) & t.rlike("^[0-9a-zA-Z+/]+={0,2}$"), F.lower(F.hex(F.unbase64(t))))
    return F.coalesce(hexed, in64)


def parses_as_hash(text: Column) -> Column:
    return parse_hash(text).isNotNull()


@F.pandas_udf(T.StringType())
def hash_add(hash_hex: pd.Series, step: pd.Series) -> pd.Series:
    """The hash as a 608-bit number plus step, modulo its range. Signed order has the same successor."""
    top = 1 << (8 * SIZE)
    return pd.Series([None if h is None or s is None else f"{(int(h, 16) + int(s)) % top:0{2 * SIZE}x}" for h, s in zip(hash_hex, step, strict=True)])


def _carried(hash_hex: Column, full: str, empty: str, digits: str, moved: str) -> Column:
    """The digits at the end that carry change over, and the one before them moves by one; a hash of nothing else wraps round."""
    head = F.rtrim(hash_hex, F.lit(full))
    n = F.length(head)
    return F.when(n == 0, F.repeat(F.lit(empty), F.length(hash_hex))).otherwise(
        F.concat(F.substring(head, F.lit(1), n - 1), F.translate(F.substring(head, n, F.lit(1)), digits, moved), F.repeat(F.lit(empty), F.length(hash_hex) - n))
    )


def next_hash(hash_hex: Column) -> Column:
    return _carried(hash_hex, "f", "0", "0123456789abcde", "123456789abcdef")


def previous_hash(hash_hex: Column) -> Column:
    return _carried(hash_hex, "0", "f", "123456789abcdef", "0123456789abcde")


def prefix(hash_hex: Column) -> Column:
    """Place of the hash's first byte in signed order: 0 (byte 80) to 255 (byte 7f). Buckets of interval joins."""
    return F.conv(F.substring(hash_hex, 1, 2), 16, 10).cast("int").bitwiseXOR(F.lit(128))


#: Whole-number coordinates of spans run from 0 to this.
COORDINATES = 65536


def coordinate_hash(place: Column) -> Column:
    """The hash at a whole-number coordinate: the lowest hash for 0, else the last one of the place-th of 65,536 equal parts; null beyond them."""
    digits = place.cast("int") - 1
    byte = lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(255)).bitwiseXOR(F.lit(128)))), 2, "0")
    inside = F.concat(byte(F.shiftright(digits, 8)), byte(digits), F.lit("7f" * (SIZE - 2)))
    return F.when(place == 0, F.lit("80" * SIZE)).when(place.between(1, COORDINATES), inside)


def bound(first_byte: int, upper: bool = False) -> str:
    """The lowest or highest hash (hex) with a first byte."""
    return f"{first_byte:02x}" + ("7f" if upper else "80") * (SIZE - 1)
