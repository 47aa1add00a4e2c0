"""File sources: directory trees, archives, and the binary request log."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import tarfile
import zipfile
from collections.abc import Iterator
from functools import reduce
from operator import xor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of packed files.
_SINGLE = {(".gz", ".gzip"): gzip.decompress, (".bz", ".bz2", ".bzip", ".bzip2"): bz2.decompress, (".lzma", ".lz"): lzma.decompress}
_TAR = (".tar", ".tgz", ".tbz", ".tbz2", ".tar.gz", ".tar.bz2")

# Kinds of requests; 128 is added for IPv4 clients.
REQUESTS = {1: "SetData", 2: "SetMeta", 3: "SetConfig", 4: "GetData", 5: "GetMeta", 6: "GetConfig", 7: "GetNonce"}
WITH_HASH = {1, 2, 4, 5}
WITH_SIGNATURE = {1, 2, 3}


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """name (below path), content and size of every file under a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.split("://")[-1].rstrip("/") + "/"
    return found.select(F.regexp_replace("path", r"^.*?" + _quoted(root), "").alias("name"), "content", F.col("length").alias("size"))


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in text)


def members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """The files of an archive, one by one; any other file is itself."""
    low = name.lower()
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for m in z.infolist():
                if not m.is_dir():
                    yield f"{name}/{m.filename}", z.read(m)
    elif low.endswith(_TAR):
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for m in t:
                if m.isfile():
                    yield f"{name}/{m.name}", t.extractfile(m).read()
    else:
        for ends, unpack in _SINGLE.items():
            if low.endswith(ends):
                yield name[: name.rindex(".")], unpack(content)
                return
        yield name, content


def explode_archives(files: DataFrame) -> DataFrame:
    """name, content and error: archives (name, content) by member; a damaged one is one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                try:
                    for n, c in members(name, bytes(content)):
                        yield pd.DataFrame({"name": [n], "content": [c], "error": [None]})
                except Exception as e:  # noqa: BLE001  whatever a damaged archive raises is its row's error
                    yield pd.DataFrame({"name": [name], "content": [None], "error": [type(e).__name__]})

    return files.select("name", "content").mapInPandas(run, "name string, content binary, error string")


def _entries(content: bytes) -> Iterator[tuple]:
    at = 0
    while at + 9 <= len(content):
        size = struct.unpack_from(">q", content, at)[0]
        checksum, body = content[at + 8], content[at + 9 : at + 8 + size]
        if size < 1 or at + 8 + size > len(content):
            return
        at += 8 + size
        if reduce(xor, body, 0) != checksum:
            continue
        ts, action = struct.unpack_from(">qB", body)
        kind, v4 = action & 127, action >= 128
        n = 4 if v4 else 16
        ip, rest = body[9 : 9 + n], body[9 + n :]
        own = ".".join(map(str, ip)) if v4 else ":".join(f"{ip[i]:02x}{ip[i + 1]:02x}" for i in range(0, 16, 2))
        hash_ = rest[:76].hex() if kind in WITH_HASH else None
        sig = rest[76 if kind in WITH_HASH else 0 :][:16].hex() if kind in WITH_SIGNATURE else None
        yield ts, REQUESTS.get(kind, str(kind)), own, hash_, sig


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    """ts, action, ip, hash and signature of each entry; entries with a wrong checksum are skipped. Files are size-rolled."""
    columns = ["ts", "action", "ip", "hash", "signature"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame(list(_entries(bytes(content))), columns=columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "ts long, action string, ip string, hash string, signature string")


def pack_entry(ts: int, kind: int, ip: str, hash_hex: str | None = None, signature: bytes = b"") -> bytes:
    """One entry as it is logged, for IPv4 clients."""
    body = struct.pack(">qB", ts, kind + 128) + bytes(map(int, ip.split("."))) + bytes.fromhex(hash_hex or "") + signature
    return struct.pack(">qB", len(body) + 1, reduce(xor, body, 0)) + body
