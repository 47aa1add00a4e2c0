"""URL filters: prefix rules first, else a list of canonical URLs behind a blocked Bloom filter.

A URL's host and path are judged by the longest fitting rule. The rest are looked up in the list: every listed
entry is a canonical host with its path, and a page is listed if its canonical URL, or its host or a parent
domain (as an entry "host/"), is. The list may be large: Spark builds a blocked Bloom filter of it (each key
sets its bits in one 512-bit block), whose size is fixed by a parameter and so may be broadcast. It passes possible hits
to a hash join with the list, which removes false positives; only those few rows are shuffled.

Edge cases: a null url, or one without ://, has empty host and path, fits no rule and is on no list;
repeated rows are judged each; an empty list blocks nothing; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Fixed values: (verdict, host with path prefix).
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
#: Hosts of known junk, as canonical listed entries.
LISTED = [f"{name}.example.{top}/" for name in ("casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]
BITS_PER_KEY = 16
#: Longest list that one filter is sized for (64 MiB of bits); a longer one only lets more rows through to the join.
MAX_BLOCKS = 1 << 20


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits host and path, as a struct of rule and verdict; null if none does."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = rule.partition("/")
        own = (F.col("host") == host) | F.col("host").endswith("." + host)
        text = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(own & F.col("path").startswith(slash + path), text).otherwise(fits)
    return fits


def canonical(url: Column | str) -> Column:
    """A listed entry or host and path in one form: no scheme, www. or default page, one closing slash for hosts."""
    x = F.lower(F.col(url) if isinstance(url, str) else url)
    x = F.regexp_replace(F.regexp_replace(x, r"^[a-z][a-z0-9+.-]*://", ""), r"^www\.", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[?#].*$", ""), r"/index\.html?$", "/")
    return F.when(F.instr(x, "/") > 0, F.regexp_replace(x, r"([^/])/+$", "$1/")).otherwise(F.concat(x, F.lit("/")))


class BlockedBloom:
    """Bits of a blocked Bloom filter: rows of 8 words, one row per block."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """The block of each hash, and one bit (0-63) for each of its 8 words."""
        h = hashes.astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = h * np.uint64(0x9E3779B97F4A7C15)
        bits = (mixed[:, None] >> np.arange(10, 58, 6, dtype=np.uint64)) & np.uint64(63)
        return (h % np.uint64(blocks)).astype(np.int64), bits

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        block, bits = self.places(hashes, len(self.words))
        return ((self.words[block] >> bits) & np.uint64(1)).all(axis=1)


def build_bloom(keys: DataFrame, bits_per_key: int = BITS_PER_KEY, max_blocks: int = MAX_BLOCKS) -> BlockedBloom:
    """The filter of the key column. Bits are or-ed by Spark; at most max_blocks x 64 bytes come to the driver."""
    n = keys.count()
    blocks = int(min(max_blocks, max(1, -(-n * bits_per_key // 512))))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            block, places = BlockedBloom.places(pdf["h"].to_numpy(np.int64).view(np.uint64), blocks)
            words = (np.uint64(1) << places).view(np.int64)
            yield pd.DataFrame({"block": block} | {f"w{i}": words[:, i] for i in range(8)})

    schema = "block long, " + ", ".join(f"w{i} long" for i in range(8))
    rows = (
        keys.select(F.xxhash64("key").alias("h")).mapInPandas(bits, schema)
        .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])
    )
    words = np.zeros((blocks, 8), np.uint64)
    for r in rows.toLocalIterator():
        words[r[0]] = np.array(r[1:], np.int64).view(np.uint64)
    return BlockedBloom(words)


def url_filters(pages: DataFrame, rules=RULES, listed: DataFrame | None = None, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages. listed: a column url; LISTED by default."""
    spark = pages.sparkSession
    if listed is None:
        listed = spark.createDataFrame([(x,) for x in LISTED], "url string")
    keys = listed.where(F.col("url").isNotNull()).select(canonical("url").alias("key")).distinct()
    bloom = spark.sparkContext.broadcast(build_bloom(keys, bits_per_key))

    page = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("u"))
    host, path = split_url(F.col("u"))
    page = page.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", rule_of(rules))
    parents = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> concat(array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'), '/'))")
    asked = F.array_distinct(F.array_append(F.transform(parents, canonical), canonical(F.concat("host", "path"))))
    asked = F.when(F.col("fit").isNull() & (F.col("host") != ""), asked).otherwise(F.array().cast("array<string>"))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["hashes"].map(len).to_numpy(np.int64)
            h = np.concatenate([np.zeros(0, np.int64), *pdf["hashes"]]).astype(np.int64).view(np.uint64)
            row = np.repeat(np.arange(len(pdf)), sizes)
            hit = bloom.value.may_have(h) if len(h) else np.zeros(0, bool)
            at = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keys_ = [pdf["keys"].iat[r][k] for r, k in zip(row[hit].tolist(), at[hit].tolist(), strict=True)]
            yield pd.DataFrame({"row": pdf["row"].to_numpy()[row[hit]], "key": pd.Series(keys_, dtype=object)})

    # Pages with their keys in a written table; the filter hands on only possible hits.
    page = page.select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", "fit.rule", "fit.verdict", asked.alias("keys"))
    page = written(page.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k))), "pages")
    possible = page.where(F.size("hashes") > 0).select("row", "keys", "hashes").mapInPandas(probe, "row long, key string")
    blocked = possible.join(keys.hint("shuffle_hash"), "key", "left_semi").select("row").distinct().withColumn("listed", F.lit(True))
    listed_ = F.when(F.col("listed"), "block").otherwise("allow")
    return page.drop("keys", "hashes").join(blocked, "row", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", listed_).alias("verdict"))
