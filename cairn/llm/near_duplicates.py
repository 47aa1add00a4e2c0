"""Near duplicates: BagMinHash signatures of word-shingle multisets, bands, and exact verification.

A document is the multiset of its five-word shingles; two are near duplicates if their weighted Jaccard
similarity (sum of smaller counts over sum of larger) is 0.8 or more. Classes are the connected components.

BagMinHash: every shingle has Poisson processes over the plane of time and weight. The weight axis is
discretised to whole counts and cut into octaves [0,1) [1,2) [2,4) [4,8) ...; each octave's process is drawn from
the shingle's hash alone, its points fall on levels of the octave by bisection, and a document sees the points
below its own count. Each point hits one of the registers; a register keeps its earliest time. So two documents
agree in a register with probability equal to their weighted Jaccard similarity, and work stays near
m log m points per document, because points later than a document's likely last register are not drawn
(and drawn later for the few documents where that was too early).

Steps:

1. Texts are signed once (a written table of rows with digests and bands); exact copies fold into one row by digest.
2. Every two rows that share a band are candidates. Each row is compared exactly with a few leaders (the first rows of the bands it shares
   most), so a group of copies is settled by about STARS comparisons a row. A leader of many is dealt out in parts.
3. What then shares a band and is not yet in one class is compared in full: such rows, with those they may reach, are dealt
   into blocks of at most BLOCK texts, and blocks meet in pairs. A class of more than BLOCK rows has blocks of its own, which do not
   meet each other, so a large class costs as often as there are blocks of other rows beside it, not its square.

Tasks return a spanning forest of the links they find; no pairs are shuffled. The chance to miss a link at similarity 0.8 is
that of sharing no band, 5e-8.

Edge cases: texts without words have no shingles and are nobody's near duplicate (each is a class of its own,
also when they are equal); texts of one to four words are one shingle; each row is judged by its own text, also where rows share a
doc_id; a class that has no doc_id has a null class_id; an empty table gives an empty result; further columns are not
read, but row names one that is handed on.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, exact_ids, mix64, runs, slices, texts, tidy, written
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
REGISTERS = 128
BAND_ROWS = 4
STARS = 2  # leaders that each row is compared with first
BLOCK = 512  # texts that are compared with each other, or with another block's, at once
BLOCK_SHINGLES = 1 << 20  # and their shingles, unless one text alone has more
GROUP_SHINGLES = 1 << 21  # shingles of the blocks that go to a task together, about
COMMON = 16  # shingles of so many documents are counted by matrix products
SLICE_CHARS = 2 << 20  # text that is signed at once

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted 64-bit hashes and counts of each text's shingles (words between ASCII white space, A-Z lower-cased)."""
    import xxhash

    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = []
    for text in texts:
        w = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
        ids.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    out = []
    for i in ids:
        if not len(i):
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        w = hashes[i]
        k = min(size, len(w))
        acc = w[: len(w) - k + 1]
        for j in range(1, k):
            acc = mix64(acc * _STEP + w[j : len(w) - k + 1 + j])
        acc = np.sort(acc)
        first = np.flatnonzero(np.r_[True, acc[1:] != acc[:-1]])
        out.append((acc[first], np.diff(np.r_[first, len(acc)])))
    return out


def bag_minhash(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """Earliest point times, a row of registers for each bag (inf for an empty one)."""
    m = registers
    sizes = np.array([len(e) for e, _ in bags], np.int64)
    doc = np.repeat(np.arange(len(bags)), sizes)
    elem = np.concatenate([np.zeros(0, np.uint64), *(e for e, _ in bags)])
    count = np.concatenate([np.zeros(0, np.int64), *(c for _, c in bags)])
    weight = np.bincount(doc, count, len(bags))
    # Octave 0 is [0,1), octave o is [2**(o-1), 2**o); a count c reaches those that start below c.
    octaves = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    which = np.repeat(np.arange(len(elem)), octaves)
    octave = runs(octaves)
    doc, count = doc[which], count[which]
    seed = mix64(elem[which] + octave.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    rate = m * np.where(octave == 0, 1.0, np.exp2(octave - 1.0))
    out = np.full((len(bags), m), np.inf)
    horizon = (np.log(m) + 6) / np.maximum(weight, 1)
    todo = np.ones(len(bags), bool)
    while True:
        own = np.flatnonzero(todo[doc])
        d, s, r, o, c = doc[own], seed[own], rate[own], octave[own], count[own]
        t = np.zeros(len(own))
        k = 0
        while len(d):
            k += 1
            h = mix64(s + np.uint64(k * int(_STEP) % 2**64))
            t = t - np.log(((h >> np.uint64(24)).astype(np.float64) + 0.5) / 2.0**40) / r
            live = t <= horizon[d]
            d, s, r, o, c, t, h = (x[live] for x in (d, s, r, o, c, t, h))
            below = np.ones(len(d), bool)
            if len(deep := np.flatnonzero(o >= 2)):
                level = mix64(h[deep] ^ _STEP) >> (np.uint64(65) - o[deep].astype(np.uint64))
                below[deep] = (np.int64(1) << (o[deep] - 1)) + level.astype(np.int64) < c[deep]
            np.minimum.at(out, (d[below], (h[below] & np.uint64(m - 1)).astype(np.int64)), t[below])
        todo = np.isinf(out).any(axis=1) & (weight > 0)
        if not todo.any():
            return out
        horizon = np.where(todo, horizon * 2, horizon)


def _signed(size: int, registers: int, band_rows: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import blake2b

        first = TaskContext.get().partitionId() << 40
        for pdf in (x for batch in batches for x in slices(batch, SLICE_CHARS)):
            text = pdf["text"].tolist()
            bags = shingles(text, size)
            times = bag_minhash(bags, registers)
            h = mix64(times.view(np.uint64) + np.arange(registers, dtype=np.uint64) * _STEP)
            keys = h[:, ::band_rows].copy()
            for j in range(1, band_rows):
                keys = mix64(keys * _STEP + h[:, j::band_rows])
            yield pd.DataFrame(
                {
                    "row": pdf["row"] if "row" in pdf else np.arange(first, first + len(pdf)),
                    "doc_id": pdf["doc_id"],
                    "missing": pdf["missing"],
                    "digest": [blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in text],
                    "size": [int(c.sum()) for _, c in bags],
                    "bands": [k.view(np.int64) if len(b[0]) else [] for k, b in zip(keys, bags, strict=True)],
                    "text": text,
                }
            )
            first += len(pdf)

    return make


def overlaps(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sums of smaller counts for all pairs of bags."""
    n = len(bags)
    # The k-th occurrence of a shingle is an element of its own, so multisets become sets.
    sizes = [int(c.sum()) for _, c in bags]
    counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in bags)])
    elem = np.repeat(np.concatenate([np.zeros(0, np.uint64), *(e for e, _ in bags)]), counts)
    elem = mix64(elem + runs(counts).astype(np.uint64) * _STEP)
    doc = np.repeat(np.arange(n), sizes)
    order = np.argsort(elem, kind="stable")
    elem, doc = elem[order], doc[order]
    first = np.flatnonzero(np.r_[True, elem[1:] != elem[:-1]]) if len(elem) else np.zeros(0, np.int64)
    often = np.diff(np.r_[first, len(elem)])
    out = np.zeros((n, n), np.float32)
    for k in np.unique(often[(often > 1) & (often < COMMON)]).tolist():
        rows = doc[first[often == k][:, None] + np.arange(k)]
        for i in range(k):
            for j in range(i + 1, k):
                np.add.at(out, (rows[:, i], rows[:, j]), 1)
    out += out.T
    many = np.flatnonzero(often >= COMMON)
    for part in np.array_split(many, len(many) // 4096 + 1):
        has = np.zeros((n, len(part)), np.float32)
        column = np.repeat(np.arange(len(part)), often[part])
        has[doc[np.repeat(first[part], often[part]) + runs(often[part])], column] = 1
        out += has @ has.T
    np.fill_diagonal(out, sizes)
    return out


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of near that connect what near connects."""
    root = np.arange(len(near))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in np.argwhere(near).tolist():
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def _units(pdf: pd.DataFrame, size: int) -> Iterator[tuple[tuple, np.ndarray, list]]:
    """(unit, rows, bags) of each unit of a task's rows."""
    for unit, own in pdf.groupby(["x", "y", "z"], sort=False):
        own = own.sort_values("row")
        yield unit, own["row"].to_numpy(np.int64), shingles(own["text"].tolist(), size)


def _with_leader(size: int, similarity: float):
    """Links of the rows of a star (x) to its leader, the row x."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (leader, _, _), rows, bags in _units(pdf, size):
            e, c = bags[int(np.flatnonzero(rows == leader)[0])]
            for row, (f, d) in zip(rows.tolist(), bags, strict=True):
                at = np.minimum(np.searchsorted(e, f), len(e) - 1)
                both = int(np.minimum(c[at], d)[e[at] == f].sum())
                if row != leader and both >= similarity * (int(c.sum()) + int(d.sum()) - both) - 1e-4:
                    out.append((int(leader), row))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return make


def _with_all(size: int, similarity: float):
    """Links among the rows of a pair of blocks that connect what they connect."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows, bags in _units(pdf, size):
            both = overlaps(bags)
            own = np.diag(both)
            near = np.triu(both >= similarity * (own[:, None] + own[None, :] - both) - 1e-4, 1)
            out += [(rows[i], rows[j]) for i, j in _forest(near)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return make


def _parts(many: Column, shingles_: Column) -> Column:
    return F.ceil(F.greatest(many / BLOCK, shingles_ / BLOCK_SHINGLES, F.lit(1))).cast("int")


def _compared(units: DataFrame, text: DataFrame, how) -> DataFrame:
    """Links that how finds in units (rows named by row, with their size, in the units x, y, z), as a written table."""
    units = written(units, "units")
    total = units.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = total // GROUP_SHINGLES + 1
    # Candidates grow with the corpus, so they are never broadcast, also where they happen to be small: one plan at every size.
    there = text.join(units.drop("size").hint("merge"), "row").withColumn("task", F.pmod(F.xxhash64("x", "y", "z"), F.lit(groups)))
    return written(there.groupBy("task").applyInPandas(how, "a long, b long"), "links")


def near_duplicate_links(
    docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, registers: int = REGISTERS, band_rows: int = BAND_ROWS, row: str | None = None
):
    """(signed table, links): near duplicates among different texts, named by row, that connect all classes. With row, docs should be a written table."""
    key = [F.col(row).cast("long").alias("row")] if row else []
    schema = "row long, doc_id long, missing boolean, digest binary, size long, bands array<long>, text string"
    signed = exact_ids(texts(docs, *key)).mapInPandas(_signed(size, registers, band_rows), schema)
    # Texts stay in the signed table where only that numbers the rows.
    signed = written(signed.drop("text") if row else signed, "signed")
    with tidy(docs.sparkSession):
        text = texts(docs, *key).select("row", "text") if row else signed.select("row", "text")
        return signed.drop("text"), written(_links(signed, text, size, similarity), "links", keep=True)


def _links(signed: DataFrame, texts_: DataFrame, size: int, similarity: float) -> DataFrame:
    reps = signed.where("size > 0").groupBy("digest").agg(F.min("row").alias("row")).select("row")
    met = signed.select("row", "size", "bands").join(reps, "row", "left_semi").select("row", "size", F.explode("bands").alias("band"))
    first = met.groupBy("band").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = written(met.join(first, "band"), "met")
    text = written(texts_.join(met.select("row").distinct().hint("merge"), "row", "left_semi"), "candidates")

    # Stars: each row with the leaders of most of its bands.
    shared = met.where("first < row").groupBy("row", "first").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first"))), 1, STARS)  # at most one for each band
    star = shared.groupBy("row").agg(F.first("size").alias("size"), ranked.alias("s"))
    star = star.select("row", "size", F.explode("s.first").alias("x"))
    parts = star.groupBy("x").agg(_parts(F.count("*"), F.sum("size")).alias("parts"))
    member = star.join(parts, "x").select("row", "size", "x", F.pmod(F.xxhash64("row"), "parts").cast("long").alias("y"))
    leader = parts.select(F.col("x").alias("row"), F.lit(0).cast("long").alias("size"), "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("y"))
    near = _compared(member.unionByName(leader).withColumn("z", F.lit(0).cast("long")), text, _with_leader(size, similarity))

    # The rest: bands whose rows are not all in one class yet.
    class_ = components(near).select(F.col("node").alias("row"), "component")
    known = met.join(class_, "row", "left").withColumn("class", F.coalesce("component", "row")).select("row", "size", "band", "first", "class")
    open_ = known.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("band")
    open_ = written(known.join(open_, "band", "left_semi"), "open")
    family = components(open_.where("first < row").select(F.col("first").alias("a"), F.col("row").alias("b"))).select(F.col("node").alias("row"), F.col("component").alias("z"))
    own = written(open_.select("row", "size", "class").distinct().join(family, "row"), "families")
    # A class with more than a block of rows in a family has blocks of its own; the others share blocks (class -1).
    sums = own.groupBy("z", "class").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    large = sums.where(_parts(F.col("n"), F.col("s")) > 1).select("z", "class", F.lit(True).alias("large"))
    own = own.join(large, ["z", "class"], "left").withColumn("side", F.when(F.col("large"), F.col("class")).otherwise(-1)).select("row", "size", "z", "side")
    sides = own.groupBy("z", "side").agg(_parts(F.count("*"), F.sum("size")).alias("parts"))
    # Blocks of a family, numbered side by side; there is one for every BLOCK rows or BLOCK_SHINGLES shingles, or less.
    laid = sides.groupBy("z").agg(F.array_sort(F.collect_list(F.struct("side", "parts"))).alias("all"))
    before = F.aggregate(F.filter("all", lambda s: s["side"] < F.col("side")), F.lit(0), lambda n, s: n + s["parts"])
    total = F.aggregate("all", F.lit(0), lambda n, s: n + s["parts"])
    dealt = own.join(sides, ["z", "side"]).join(laid, "z").select("row", "size", "z", "side", "parts", before.alias("before"), total.alias("total"))
    dealt = dealt.withColumn("block", F.col("before") + F.pmod(F.xxhash64("row"), "parts").cast("int"))
    # Every block of another side, and for shared blocks each other and themselves. Where one side is all, nothing is open.
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda k: (F.col("side") < 0) | (k < F.col("before")) | (k >= F.col("before") + F.col("parts")))
    meets = dealt.withColumn("other", F.explode(others))
    meets = meets.select("row", "size", "z", F.least("block", "other").cast("long").alias("x"), F.greatest("block", "other").cast("long").alias("y"))
    return near.unionByName(_compared(meets, text, _with_all(size, similarity)))


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, registers: int = REGISTERS, band_rows: int = BAND_ROWS, row: str | None = None
) -> DataFrame:
    """doc_id and class_id (the class's smallest doc_id) of each row; with row: also row and first, true for one row of each class."""
    signed, links = near_duplicate_links(docs, size, similarity, registers, band_rows, row)
    ids = signed.select("row", F.expr("IF(missing, NULL, doc_id)").alias("doc_id"), "digest", "size")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    copies = ids.where("size > 0").groupBy("digest").agg(F.min("row").alias("node"), best.alias("best"))
    copies = copies.join(components(links), "node", "left").withColumn("class", F.coalesce("component", "node"))
    named = copies.join(copies.groupBy("class").agg(F.min("best").alias("leader")), "class").select("digest", "leader")
    words = F.col("size") > 0
    out = ids.join(named, "digest", "left").select(
        "row",
        "doc_id",
        F.when(words, F.col("leader.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(words, F.col("leader.row") == F.col("row")).otherwise(True).alias("first"),
    )
    return out if row else out.select("doc_id", "class_id")
