"""Benchmark decontamination by Wu-Manber search over words.

The patterns are windows of 10 consecutive words of a benchmark item (an item of fewer words is one window).
Words are the symbols and blocks are pairs of neighbouring words. For patterns of one length m:

- a shift table says, for the block that ends a position, how far the search may skip;
- where the shift is 0, a table from the last block's hash to the windows that end so selects test strings;
- those are compared with the document word for word.

The texts of a batch are laid end to end and cut into lanes; all lanes advance at once, each by its own shift.
Patterns of fewer words than 2 are looked up word by word.

The benchmark is measured first. Up to BROADCAST_BYTES of text the tables are made on the driver and go to every worker. A larger one stays
in Spark: its windows are a written table, and only shift tables of a fixed number of slots (a slot is a block's hash; the least shift
of the blocks in it) are sent out. What they do not skip is hash-joined with the windows, word for word. Both ways give the same rows.

Edge cases: null texts and items have no words and no hits; items without words are no windows; windows that
several items share count for each; an item without item_id is listed as the empty string; repeated rows are judged
each; empty tables give empty results (an empty benchmark leaves all documents clean); further columns are not read, but row names
one that is handed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact_ids, mix64, texts, written

WINDOW = 10
BROADCAST_BYTES = 4 << 20
SLOTS = 1 << 22  # of a shift table
PART = 1 << 12  # slots that travel together
LANE = 2048

#: Bytes to word bytes: A-Z lower-cased, all else of \x00-\x2F \x3A-\x60 \x7B-\x7F a space.
_WORD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


def unskipped(n: int, m: int, shift) -> np.ndarray:
    """Ends of places of m words that shift (a function of ends) does not skip; lanes advance side by side."""
    ends = np.arange(m - 1, n, LANE)
    stop = np.minimum(ends + LANE, n)
    out = [ends[:0]]
    while len(ends):
        s = shift(ends)
        out.append(ends[s == 0])
        ends = ends + np.maximum(s, 1)
        live = ends < stop
        ends, stop = ends[live], stop[live]
    return np.concatenate(out)


class Patterns:
    """The windows of some items: word numbers, and shift and bucket tables for each length."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.words: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)]
            for k in range(max(1, len(ids) - window + 1)) if ids else ():
                owners.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.owners = [sorted(x) for x in owners.values()]
        self.tables = []
        keys = list(owners)
        for m in sorted({len(k) for k in keys}):
            at = np.array([i for i, k in enumerate(keys) if len(k) == m])
            self.tables.append((m, *self._tables(np.array([keys[i] for i in at], np.int64), m), at))

    @staticmethod
    def block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A number for two neighbouring words, exact up to 2**32 words."""
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def _tables(self, windows: np.ndarray, m: int):
        if m == 1:
            order = np.argsort(windows[:, 0])
            return None, None, windows[order], order
        shift: dict[int, int] = {}
        for j in range(1, m):
            for x in self.block(windows[:, j - 1], windows[:, j]).tolist():
                shift[x] = min(shift.get(x, m - 1), m - 1 - j)
        known = np.array(sorted(shift), np.uint64)
        last = self.block(windows[:, -2], windows[:, -1])
        order = np.argsort(last, kind="stable")
        return (known, np.array([shift[int(x)] for x in known], np.int64)), last[order], windows[order], order

    def search(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and window numbers of all occurrences in ids (0: not a word of any window).

        doc: the document of each word; occurrences never cross documents.
        """
        out = []
        n = len(ids)
        for m, shifts, last, windows, order, at in self.tables:
            if n < m:
                continue
            if m == 1:
                lo = np.searchsorted(windows[:, 0], ids)
                hit = np.flatnonzero((lo < len(windows)) & (windows[np.minimum(lo, len(windows) - 1), 0] == ids))
                out.append((hit, np.ones(len(hit), np.int64), at[order[lo[hit]]]))
                continue
            known, skip = shifts

            def shift(ends, known=known, skip=skip, m=m):
                b = self.block(ids[ends - 1], ids[ends])
                k = np.minimum(np.searchsorted(known, b), len(known) - 1)
                return np.where(known[k] == b, skip[k], m - 1)

            end = unskipped(n, m, shift)
            end = end[doc[end] == doc[end - m + 1]]
            b = self.block(ids[end - 1], ids[end])
            lo, hi = np.searchsorted(last, b, "left"), np.searchsorted(last, b, "right")
            rows = np.repeat(np.arange(len(end)), hi - lo)
            test = np.repeat(lo, hi - lo) + (np.arange(len(rows)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo))
            for j in range(m):  # direct comparison, word by word
                same = ids[end[rows] - m + 1 + j] == windows[test, j]
                rows, test = rows[same], test[same]
            out.append((end[rows] - m + 1, np.full(len(rows), m), at[order[test]]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _searcher(patterns):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p: Patterns = patterns.value
        known = p.words.get
        for pdf in batches:
            parts, sizes = [], []
            for text in pdf["text"]:
                w = words_of(text)
                sizes.append(len(w))
                parts.append(np.fromiter((known(x, 0) for x in w), np.int64, len(w)))
            ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            first = np.cumsum(sizes) - sizes if sizes else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            start, length, window = p.search(ids, doc)
            flags = np.zeros(len(ids) + 1, np.int64)
            np.add.at(flags, start, 1)
            np.add.at(flags, start + length, -1)
            hit = np.cumsum(flags)[:-1] > 0
            spans: list[list[int]] = [[] for _ in sizes]
            items: list[set[str]] = [set() for _ in sizes]
            for s, w in zip(start.tolist(), window.tolist(), strict=True):
                items[doc[s]].update(p.owners[w])
            for s in np.flatnonzero(hit).tolist():
                spans[doc[s]].append(s - int(first[doc[s]]))
            yield pdf.drop(columns="text").assign(**{"n_words": sizes, "hits": spans, "items": [sorted(x) for x in items]})

    return make


def _windows(window: int):
    """item and key (a window's words with spaces between) of each window, and m, the number of words."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, text in zip(pdf["item_id"], pdf["text"], strict=True):
                w = words_of(text)
                if w:
                    m = min(window, len(w))
                    keys = list({b" ".join(w[k : k + m]) for k in range(len(w) - m + 1)})
                    yield pd.DataFrame({"item": [item] * len(keys), "m": m, "key": keys})

    return make


def _slots(h: np.ndarray, m: int, slots: int) -> np.ndarray:
    """The slot of each word with the one before it (for m = 1: of the word) in a row of word hashes."""
    both = h if m == 1 else mix64(h[..., :-1] * np.uint64(0x9E3779B97F4A7C15) + h[..., 1:])
    return (both % np.uint64(slots)).astype(np.int64)


def _shifts(slots: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            for m, own in pdf.groupby("m"):
                h = np.array([[xxhash.xxh3_64_intdigest(w) for w in bytes(k).split(b" ")] for k in own["key"]], np.uint64)
                slot = _slots(h, m, slots)
                shift = np.broadcast_to(np.arange(slot.shape[1])[::-1], slot.shape)
                order = np.lexsort((shift.ravel(), slot.ravel()))
                slot, shift = slot.ravel()[order], shift.ravel()[order]
                first = np.r_[True, slot[1:] != slot[:-1]]
                yield pd.DataFrame({"m": m, "slot": slot[first], "shift": shift[first]})

    return make


def _part(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    out = np.full(PART, key[0], np.uint16)
    np.minimum.at(out, pdf["slot"].to_numpy() % PART, pdf["shift"].to_numpy().astype(np.uint16))
    return pd.DataFrame({"m": [key[0]], "part": [key[1]], "data": [out.tobytes()]})


def _candidates(tables, slots: int):
    """Of each document: n_words and the places that the shift tables do not skip, with their words."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        first = TaskContext.get().partitionId() << 40
        for pdf in batches:
            parts = [words_of(text) for text in pdf["text"]]
            sizes = np.array([len(w) for w in parts], np.int64)
            words = [w for part in parts for w in part]
            hashes = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
            h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            begin = np.cumsum(sizes) - sizes
            found: list[list[dict]] = [[] for _ in parts]
            for m, table in tables.value.items():
                if len(h) < m:
                    continue
                slot = _slots(h, m, slots)
                end = unskipped(len(h), m, lambda ends, t=table, s=slot, m=m: t[s[ends - (m > 1)]].astype(np.int64))
                end = end[doc[end] == doc[end - m + 1]]
                for d, s in zip(doc[end].tolist(), (end - m + 1).tolist(), strict=True):
                    found[d].append({"start": s - int(begin[d]), "key": b" ".join(words[s : s + m])})
            yield pdf.drop(columns="text").assign(key_=np.arange(first, first + len(pdf)), n_words=sizes, places=found)
            first += len(pdf)

    return make


def _joined(rows: DataFrame, items: DataFrame, window: int, slots: int, row: bool) -> DataFrame:
    """benchmark_hits by a join of what shift tables of fixed size do not skip with the windows."""
    spark = rows.sparkSession
    windows = written(items.mapInPandas(_windows(window), "item string, m int, key binary"), "windows")
    shifts = windows.select("m", "key").mapInPandas(_shifts(slots), "m int, slot int, shift int").groupBy("m", "slot").agg(F.min("shift").alias("shift"))
    parts = shifts.withColumn("part", F.expr(f"slot div {PART}").cast("int")).groupBy("m", "part").applyInPandas(_part, "m int, part int, data binary")
    tables: dict[int, np.ndarray] = {}
    for r in parts.toLocalIterator():  # window x slots x 2 bytes at most
        table = tables.setdefault(r.m, np.full(slots, max(1, r.m - 1), np.uint16))
        table[r.part * PART : (r.part + 1) * PART] = np.minimum(np.frombuffer(r.data, np.uint16), max(1, r.m - 1))[: len(table) - r.part * PART]
    schema = ("row long, " if row else "") + "doc_id long, missing boolean, key_ long, n_words long, places array<struct<start:int,key:binary>>"
    found = written(rows.mapInPandas(_candidates(spark.sparkContext.broadcast(tables), slots), schema), "candidates")
    place = found.select("key_", F.explode("places").alias("p")).select("key_", "p.start", "p.key")
    own = windows.groupBy("key", "m").agg(F.collect_set("item").alias("items"))
    occurs = written(place.join(own, "key").select("key_", "start", "m", "items"), "occurrences")
    hits = occurs.select("key_", F.explode(F.sequence("start", F.col("start") + F.col("m") - 1)).alias("x")).distinct().groupBy("key_").agg(F.array_sort(F.collect_list("x")).alias("hits"))
    names = occurs.select("key_", F.explode("items").alias("x")).distinct().groupBy("key_").agg(F.array_sort(F.collect_list("x")).alias("items"))
    out = found.drop("places").join(hits, "key_", "left").join(names, "key_", "left")
    return out.withColumns({"hits": F.coalesce("hits", F.array().cast("array<int>")), "items": F.coalesce("items", F.array().cast("array<string>"))})


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, row: str | None = None, slots: int = SLOTS) -> DataFrame:
    """doc_id, n_words, hits (places of hit words) and items (ids as strings, sorted) of each row; with row: also row."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).collect()[0][0]
    rows = exact_ids(texts(docs, *([F.col(row).cast("long").alias("row")] if row else [])))
    if size > broadcast_bytes:
        found = _joined(rows, items, window, slots, row is not None)
    else:
        patterns = spark.sparkContext.broadcast(Patterns([tuple(r) for r in items.collect()], window))
        schema = "doc_id long, " + ("row long, " if row else "") + "missing boolean, n_words long, hits array<int>, items array<string>"
        found = rows.mapInPandas(_searcher(patterns), schema)
    return found.select(F.expr("IF(missing, NULL, doc_id)").alias("doc_id"), "n_words", "hits", "items", *(["row"] if row else []))


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, slots: int = SLOTS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs."""
    found = benchmark_hits(docs, benchmark, window, broadcast_bytes, slots=slots)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
