"""Compression and encryption of binary columns, and the chain of encodings that stored files go through."""

from __future__ import annotations

import bz2
import gzip
import lzma
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PACK = {"gzip": lambda x: gzip.compress(x, mtime=0), "bzip2": bz2.compress, "lzma": lzma.compress}
_UNPACK = {"gzip": gzip.decompress, "bzip2": bz2.decompress, "lzma": lzma.decompress}


def compress(data: Column, kind: str) -> Column:
    pack = _PACK[kind]

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else pack(bytes(v)))

    return run(data.cast("binary"))


def decompress(data: Column, kind: str) -> Column:
    """Null where the bytes are damaged."""
    unpack = _UNPACK[kind]

    def one(v):
        try:
            return None if v is None else unpack(bytes(v))
        except (OSError, EOFError, ValueError, lzma.LZMAError, zlib.error):
            return None

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(one)

    return run(data.cast("binary"))


def _key(passphrase: Column) -> Column:
    return F.unhex(F.sha2(passphrase, 256))


def encrypt(data: Column, passphrase: Column) -> Column:
    """AES-256 in GCM mode, key by SHA-256 of the passphrase."""
    return F.aes_encrypt(data.cast("binary"), _key(passphrase), F.lit("GCM"))


def decrypt(data: Column, passphrase: Column) -> Column:
    """Null for a wrong passphrase."""
    return F.try_aes_decrypt(data, _key(passphrase), F.lit("GCM"))


def encode_chain(data: Column, gzipped: bool, passphrase: Column | None = None) -> Column:
    """None, then GZIP, then AES, as asked."""
    data = compress(data, "gzip") if gzipped else data.cast("binary")
    return encrypt(data, passphrase) if passphrase is not None else data


def decode_chain(data: Column, gzipped: bool, passphrase: Column | None = None) -> Column:
    data = decrypt(data, passphrase) if passphrase is not None else data
    return decompress(data, "gzip") if gzipped else data
