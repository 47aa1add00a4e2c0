"""Removal of long repeated byte strings with a run-length suffix index.

A byte goes if a string of LENGTH bytes around it also starts earlier: in a document with a smaller doc_id, or
in the same one. Passes over blocks of compressed texts (a written table):

1. Every window of LENGTH bytes picks its least hashed k-gram (a minimizer), so equal windows pick equal ones
   at equal offsets. Neighbouring windows with the same pick form a segment. Picks are dealt to shards. Segments that
   are alike byte for byte (by two 64-bit hashes) fold into their first copy, and all windows of the other copies
   are repeats; this only spares the index copies (fold=False sends it every segment). The shard also says whether other
   segments have the same pick; if none has, no window of the segment occurs elsewhere.
2. Segments that share their pick are sent as bytes, and their shard builds run-length Burrows-Wheeler transforms of
   them, whole picks in each. The sorted suffixes are dropped; what stays are runs: a character, where the run
   begins, where its first row leads, text positions sampled at both of its ends, and the place where its LENGTH bytes begin
   first. The segments then stream through it from right to left by backward steps, all side by side: each keeps the
   length of its longest match (the matching statistic) and a row that has it. Where the match cannot be extended, it moves to the nearest
   run of the wanted character, whichever shares more bytes. Matches of LENGTH or more that begin earlier are
   marked. No hash decides here.
3. A pick with more than HOT_SEGMENTS different segments (a much-used line in ever different texts) would make one index too
   large, so its windows are dealt out by their own bytes (by two 64-bit hashes), each distinct one once per block.
4. Blocks take all answers, remove the marked bytes and hash what is left.

Edge cases: null texts are empty; texts shorter than LENGTH lose nothing; rows that share a doc_id are not repeats
of each other (neither has the smaller one) but each keeps its own marks; rows without doc_id come after all others, in
the order they are read; an empty table gives an empty result; further columns are not read, but row names one
that is handed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact_ids, mix64, packed, runs, texts, unpacked, written

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 2 << 20  # bytes that are hashed at once
SHARD_KEYS = 1 << 19
INDEX_BYTES = 1 << 20  # bytes of one index, about; segments with one pick stay together
HOT_SEGMENTS = 4096  # different segments of a pick that is indexed
NO_ID = np.int64(1) << np.int64(62)  # order of rows without doc_id: from here on

_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _ODD, np.uint64), np.full(size, _ODD_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Segments of the texts that lie end to end in data: document, first and last window start, hashes of pick and bytes.

    Places are in data. Windows never cross ends.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    size = max(CHUNK_BYTES, n) + 1
    up, down = _powers(1 << (size - 1).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    x = mix64((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    # Least hash with its place: 40 bits of hash over 24 or more of place, so the leftmost of equals wins.
    bits = np.uint64(max(24, int(n).bit_length()))
    least = (x >> bits << bits) | np.arange(len(x), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    doc_of = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    starts = np.flatnonzero(np.arange(n - length + 1) + length <= ends[doc_of[: n - length + 1]])
    pick = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(starts) else empty
    last = np.r_[new[1:], len(starts)] - 1 if len(new) else empty
    lo, hi, p = starts[new], starts[last], pick[new]
    digest = mix64((sums[hi + length] - sums[lo]) * down[lo] + ((p - lo).astype(np.uint64) << np.uint64(32)) + (hi - lo).astype(np.uint64))
    return doc_of[lo], lo, hi, x[p], digest


def window_digests(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows that start at lo..hi: which segment, start, digest."""
    many = hi - lo + 1
    which, start = np.repeat(np.arange(len(lo)), many), np.repeat(lo, many) + runs(many)
    out = np.zeros(len(start), np.uint64)
    for j in range(length):
        out = out * np.uint64(_ODD) + _BYTE[data[start + j]]
    return which, start, mix64(out)


class RunIndex:
    """A run-length Burrows-Wheeler transform of texts that lie end to end, with samples at run ends.

    Each text is closed by a terminator; terminators sort before all bytes, in text order. A run is cut also where the
    first `length` bytes of the sorted suffixes change, so each run knows where these bytes begin first.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, length: int = LENGTH):
        close = np.cumsum(sizes + 1) - 1
        total = len(data) + len(sizes)
        self.text = np.zeros(total + length + 1, np.uint16)
        self.text[np.flatnonzero(~np.isin(np.arange(total), close))] = data.astype(np.uint16) + np.uint16(1)
        to_close = np.repeat(close, sizes + 1) - np.arange(total)
        rows, same = self._sorted(total, to_close, length)
        short = to_close[rows] < length  # too short to be asked for, so they need no cut
        same[1:] |= short[1:] & short[:-1]
        rank = np.empty(total, np.int64)
        rank[rows] = np.arange(total)
        char = np.where(rows > 0, self.text[rows - 1], 0)
        new = np.r_[True, (char[1:] != char[:-1]) | ~same[1:]][:total]
        head = np.flatnonzero(new)
        self.runs, self.char = len(head), char[head]
        self.size = np.diff(np.r_[head, total])
        # Where the first row of each run leads: the row of the suffix that is one longer, as run and distance.
        there = np.where(self.char > 0, rank[np.maximum(rows[head] - 1, 0)], 0)
        self.to = (np.cumsum(new) - 1)[there]
        self.past = there - head[self.to]
        self.first_sample, self.last_sample = rows[head], rows[head + self.size - 1]
        self.earliest = np.minimum.reduceat(rows, np.flatnonzero(~same))[(np.cumsum(~same) - 1)[head]] if total else head
        self.by_char = np.sort((self.char.astype(np.int64) << 32) | np.arange(self.runs))

    def _sorted(self, total: int, to_close: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all suffixes, sorted, and whether each has the same first `length` bytes as the one before.

        Prefix doubling from 4 characters; a suffix that is alone with its prefix is not sorted again.
        """
        bits = np.uint64(max(1, total.bit_length()))
        if 3 * int(bits) > 64:
            raise ValueError("index too large")
        low = np.uint64((1 << int(bits)) - 1)
        key = np.zeros(total, np.uint64)
        for j in range(4):
            key = (key << np.uint64(9)) | np.where(to_close >= j, self.text[j : total + j], 0).astype(np.uint64)
        key = np.sort((key << bits) | np.arange(total, dtype=np.uint64))
        order = (key & low).astype(np.int64)
        key >>= bits
        new = np.r_[True, key[1:] != key[:-1]][:total] | (to_close[order] < 4)
        rank = np.empty(total, np.uint64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(total), 0))
        have, same = 4, None
        while len(slots := np.flatnonzero(~new | np.r_[~new[1:], False][:total])):
            if have == length:
                same = ~new
            step = have if have >= length else min(have, length - have)
            own = order[slots].astype(np.uint64)
            key = np.sort((((rank[own] << bits) | rank[own + np.uint64(step)]) << bits) | own)
            order[slots] = key & low
            key >>= bits
            new[slots] = np.r_[True, key[1:] != key[:-1]]
            rank[order[slots]] = np.maximum.accumulate(np.where(new[slots], slots, 0))
            have += step
        return order, np.zeros(total, bool) if same is None else same

    def _shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many characters from a on equal those from b on, up to most."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        wide = np.arange(16)
        while len(live):
            at = out[live, None] + wide
            x = self.text[np.minimum(a[live, None] + at, len(self.text) - 1)]
            y = self.text[np.minimum(b[live, None] + at, len(self.text) - 1)]
            differ = (x != y) | (at >= most[live, None])
            out[live] += np.where(differ.any(1), differ.argmax(1), 16)
            live = live[~differ.any(1)]
        return out

    def statistics(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position of texts that lie end to end: its longest match, and the run of a row that has it."""
        ends = np.cumsum(sizes)
        lane = np.argsort(-sizes, kind="stable")
        last, sizes = ends[lane] - 1, sizes[lane]
        many = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes.max()) if len(sizes) else 0), "right")
        lengths, found = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        run, past, place, length = (np.zeros(len(sizes), np.int64) for _ in range(4))
        if self.runs:
            place[:] = self.first_sample[0]
        for t, n in enumerate(many.tolist()):
            c = data[last[:n] - t].astype(np.int64) + 1
            gone = np.zeros(0, np.int64)
            if len(miss := np.flatnonzero(self.char[run[:n]] != c)):
                # The nearest run of the character on either side; the one whose sample shares more is taken.
                at = np.searchsorted(self.by_char, (c[miss] << 32) | run[miss])
                options = []
                for k, samples in ((at, self.first_sample), (at - 1, self.last_sample)):
                    there = self.by_char[np.clip(k, 0, self.runs - 1)]
                    fits = (k >= 0) & (k < self.runs) & (there >> 32 == c[miss])
                    r = there & 0xFFFFFFFF
                    options.append((r, samples[r], np.where(fits, self._shared(samples[r], place[miss], np.where(fits, length[miss], 0)), -1)))
                (r0, p0, s0), (r1, p1, s1) = options
                down = s0 >= s1
                run[miss], place[miss], length[miss] = np.where(down, r0, r1), np.where(down, p0, p1), np.maximum(s0, s1)
                past[miss] = np.where(down, 0, self.size[r1] - 1)
                gone = miss[np.maximum(s0, s1) < 0]
            # The backward step.
            r = self.to[run[:n]]
            o = self.past[run[:n]] + past[:n]
            over = np.flatnonzero(o >= self.size[r])
            while len(over):
                o[over] -= self.size[r[over]]
                r[over] += 1
                over = over[o[over] >= self.size[r[over]]]
            run[:n], past[:n] = r, o
            place[:n] -= 1
            length[:n] += 1
            if len(gone):  # a character that the index does not have
                run[gone], past[gone], place[gone], length[gone] = 0, 0, self.first_sample[0], 0
            lengths[last[:n] - t], found[last[:n] - t] = length[:n], run[:n]
        return lengths, found


def repeated(data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, rows: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each position of segments in text order, whether its length bytes begin earlier: with a smaller id, or in the same row."""
    index = RunIndex(data, sizes, length)
    match, run = index.statistics(data, sizes)
    segment = np.repeat(np.arange(len(sizes)), sizes)
    hit = np.flatnonzero(match >= length)
    first = index.earliest[run[hit]]
    own = hit + segment[hit]  # terminators lie between
    there = np.searchsorted(np.cumsum(sizes + 1), first, "right")
    out = np.zeros(len(data), bool)
    earlier = first < own
    out[hit] = earlier & ((ids[there] < ids[segment[hit]]) | (rows[there] == rows[segment[hit]]))
    # First in another row of the same doc_id: look in the row itself.
    left = hit[earlier & ~out[hit]]
    if len(left):
        starts = np.cumsum(sizes) - sizes
        seen: set[tuple[int, bytes]] = set()
        asked = set(left.tolist())
        for s in np.flatnonzero(np.isin(rows, rows[segment[left]])).tolist():
            for i in range(int(starts[s]), int(starts[s] + sizes[s]) - length + 1):
                w = (int(rows[s]), data[i : i + length].tobytes())
                if w in seen and i in asked:
                    out[i] = True
                seen.add(w)
    return out


def _blocks(row: bool):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        part, seq = TaskContext.get().partitionId(), 0
        for pdf in batches:
            for _, own in pdf.groupby(pdf["text"].str.len().cumsum().to_numpy() // BLOCK_BYTES, sort=False):
                raw = [t.encode("utf-8", "surrogatepass") for t in own["text"]]
                yield pd.DataFrame(
                    {
                        "block": [(part << 32) + seq],
                        "doc_ids": [own["missing"].to_numpy(bool).tobytes() + own["doc_id"].to_numpy(np.int64).tobytes()],
                        "keys": [own["row"].to_numpy(np.int64).tobytes() if row else None],
                        "sizes": [np.array([len(x) for x in raw], np.int64).tobytes()],
                        "data": [zstandard.ZstdCompressor(level=3).compress(b"".join(raw))],
                        "n_bytes": [sum(map(len, raw))],
                    }
                )
                seq += 1

    return make


_BLOCK = "block long, doc_ids binary, keys binary, sizes binary, data binary, n_bytes long"
_REPLY = "kind string, shard int, block long, picks binary, digests binary, ids binary, places binary, sizes binary, data binary, hot long"
_COLUMNS = ["kind", "shard", "block", "picks", "digests", "ids", "places", "sizes", "data", "hot"]


def _firsts(h: np.ndarray, g: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of places in text order: those that no equal (h, g) of a smaller id, or earlier in the same row, precedes; sorted by h and g."""
    order = np.lexsort((ids, g, h))
    h, g, ids, rows = h[order], g[order], ids[order], rows[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])][: len(h)]
    least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order[new | ((ids == least) & np.r_[False, rows[1:] != rows[:-1]][: len(h)])]


class _Block:
    """The texts of a block and their segments."""

    def __init__(self, row, length: int, fold: bool):
        import zstandard

        self.length = length
        self.sizes = np.frombuffer(row.sizes, np.int64)
        n = len(self.sizes)
        self.null = np.frombuffer(row.doc_ids[:n], bool)
        self.doc_ids = np.frombuffer(row.doc_ids[n:], np.int64)
        # Order of rows: by doc_id, those without one behind all others. Block numbers are parts of 2**32 blocks; rows are below 2**24.
        self.rank = np.where(self.null, NO_ID + (np.int64(row.block >> 32) << np.int64(40)) + (np.int64(row.block & 0xFFFF) << np.int64(24)) + np.arange(n), np.minimum(self.doc_ids, NO_ID - 1))
        raw = zstandard.ZstdDecompressor().decompress(row.data) if row.n_bytes else b""
        self.data = np.frombuffer(raw, np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.firsts = self.ends - self.sizes
        found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2]
        for chunk in np.split(np.arange(n), np.flatnonzero(np.diff(self.firsts // CHUNK_BYTES)) + 1):
            if len(chunk):
                a, b = self.firsts[chunk[0]], self.ends[chunk[-1]]
                doc, lo, hi, h, g = segments(self.data[a:b], self.ends[chunk] - a, length)
                found.append((doc + chunk[0], lo + a, hi + a, h, g))
        self.doc, self.lo, self.hi, self.h, self.g = (np.concatenate(x) for x in zip(*found, strict=True))
        self.id = self.rank[self.doc]
        self.asked = _firsts(self.h, self.g, self.id, self.doc) if fold else np.argsort(self.h, kind="stable")

    def by_shard(self, shards: int) -> list[np.ndarray]:
        """Places in asked, shard by shard."""
        return _dealt(self.h[self.asked], shards)

    def status(self, replies: pd.DataFrame, shards: int) -> np.ndarray:
        """What the shards say of the asked segments: 0 nobody else has the pick, 1 a copy, 2 to be indexed, 3 of a hot pick."""
        out = np.zeros(len(self.asked), np.uint8)
        parts = self.by_shard(shards)
        for r in replies[replies["kind"] == "status"].itertuples():
            out[parts[r.shard]] = unpacked(r.data, np.uint8)
        return out

    def indexed(self, status: np.ndarray, shards: int) -> list[np.ndarray]:
        """Segments whose bytes go to each shard."""
        return [self.asked[i[status[i] == 2]] for i in self.by_shard(shards)]

    def hot(self, status: np.ndarray):
        """Windows of segments of hot picks: start, pick, digest, id, and which of them are asked for."""
        f = np.sort(self.asked[status == 3])
        which, start, digest = window_digests(self.data, self.lo[f], self.hi[f], self.length)
        h, ids = self.h[f][which], self.id[f][which]
        return start, h, digest, ids, _firsts(h, digest, ids, self.doc[f][which])


def _dealt(keys: np.ndarray, shards: int) -> list[np.ndarray]:
    own = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    return np.split(order, np.searchsorted(own[order], np.arange(1, shards)))


def _question(kind: str, shard: int, block: int, h: np.ndarray, g: np.ndarray, ids: np.ndarray) -> tuple:
    return (kind, shard, block, packed(h), packed(g), packed(ids), None, None, None, 0)


def _ask(shards: int, length: int, fold: bool):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                b = _Block(row, length, fold)
                rows = [_question("ask", s, row.block, b.h[f], b.g[f], b.id[f]) for s, i in enumerate(b.by_shard(shards)) if len(f := b.asked[i])]
                yield pd.DataFrame(rows, columns=_COLUMNS)

    return make


def _copies(kind: str, fold: bool, hot: int):
    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        h, g, ids = ([unpacked(x, k) for x in pdf[c]] for c, k in (("picks", np.uint64), ("digests", np.uint64), ("ids", np.int64)))
        sizes = [len(x) for x in h]
        h, g, ids = (np.concatenate(x) for x in (h, g, ids))
        order = np.lexsort((ids, g, h))
        h, g, ids = h[order], g[order], ids[order]
        new_h = np.r_[True, h[1:] != h[:-1]]
        new_g = new_h | np.r_[True, g[1:] != g[:-1]]
        copy = (ids > ids[np.flatnonzero(new_g)[np.cumsum(new_g) - 1]]) & fold
        group = np.cumsum(new_h) - 1
        others = np.bincount(group, ~copy)[group]
        status = np.empty(len(h), np.uint8)
        status[order] = np.where(copy, 1, np.where(others > hot, 3, np.where(others > 1, 2, 0)))
        rows = []
        for block, part in zip(pdf["block"], np.split(status, np.cumsum(sizes)[:-1]), strict=True):
            rows.append((kind, pdf["shard"].iat[0], block, None, None, None, None, None, packed(part), int((part == 3).sum())))
        return pd.DataFrame(rows, columns=_COLUMNS)

    return make


def _send(shards: int, hot_shards: int, length: int, fold: bool):
    def make(_, rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples():
            b = _Block(row, length, fold)
            status = b.status(replies, shards)
            for s, f in enumerate(b.indexed(status, shards)):
                if len(f):
                    size = b.hi[f] - b.lo[f] + length
                    data = packed(b.data[np.repeat(b.lo[f], size) + runs(size)])
                    out.append(("bytes", s, row.block, packed(b.h[f]), packed(b.doc[f]), packed(b.id[f]), packed(b.lo[f]), packed(size), data, 0))
            if hot_shards:
                _, h, g, ids, asked = b.hot(status)
                for s, i in enumerate(_dealt(mix64(h[asked] ^ g[asked]), hot_shards)):
                    if len(i):
                        out.append(_question("windows", s, row.block, h[asked[i]], g[asked[i]], ids[asked[i]]))
        return pd.DataFrame(out, columns=_COLUMNS)

    return make


def _index(length: int):
    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["kind"].iat[0] == "windows":
            return _copies("windows", True, np.iinfo(np.int64).max)(pdf)
        h, doc, ids, place, size = ([unpacked(x, k) for x in pdf[c]] for c, k in (("picks", np.uint64), ("digests", np.int64), ("ids", np.int64), ("places", np.int64), ("sizes", np.int64)))
        many = [len(x) for x in h]
        block = np.repeat(np.arange(len(h)), many)
        data = np.concatenate([unpacked(x, np.uint8) for x in pdf["data"]])
        h, doc, ids, place, size = (np.concatenate(x) for x in (h, doc, ids, place, size))
        row = block.astype(np.int64) << 32 | doc
        offset = np.cumsum(size) - size
        order = np.lexsort((h,))
        # Index by index: whole picks, about INDEX_BYTES each.
        group = np.cumsum(np.r_[True, h[order[1:]] != h[order[:-1]]])
        upto = np.cumsum(size[order])[np.searchsorted(group, group, "right") - 1] // INDEX_BYTES
        # A bit for each window of each segment, in the order they were sent.
        windows = size - length + 1
        first_bit = np.cumsum(windows) - windows
        bits = np.zeros(int(windows.sum()), bool)
        for own in np.split(order, np.flatnonzero(np.diff(upto)) + 1):
            # Text order: ids, rows, places, whatever the pick.
            own = own[np.lexsort((place[own], row[own], ids[own]))]
            n = size[own]
            hit = repeated(data[np.repeat(offset[own], n) + runs(n)], n, ids[own], row[own], length)
            w = windows[own]
            bits[np.repeat(first_bit[own], w) + runs(w)] = hit[np.repeat(np.cumsum(n) - n, w) + runs(w)]
        rows = []
        for b, part in zip(pdf["block"], np.split(bits, np.cumsum(np.bincount(block, windows, len(many)).astype(np.int64))[:-1]), strict=True):
            if part.any():
                rows.append(("marks", pdf["shard"].iat[0], b, None, None, None, None, None, packed(np.packbits(part)), 0))
        return pd.DataFrame(rows, columns=_COLUMNS)

    return make


def _removed(shards: int, hot_shards: int, length: int, fold: bool, row_key: bool, with_text: bool):
    def make(_, rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples():
            b = _Block(row, length, fold)
            status = b.status(replies, shards)
            gone = np.full(len(b.lo), fold)
            gone[b.asked] = status == 1
            flags = np.zeros(len(b.data) + 1, np.int32)
            np.add.at(flags, b.lo[gone], 1)
            np.add.at(flags, b.hi[gone] + length, -1)
            sent = b.indexed(status, shards)
            single = []
            for r in replies[replies["kind"] == "marks"].itertuples():
                f = sent[r.shard]
                w = b.hi[f] - b.lo[f] + 1
                hit = np.unpackbits(unpacked(r.data, np.uint8), count=int(w.sum())).astype(bool)
                single.append((np.repeat(b.lo[f], w) + runs(w))[hit])
            if hot_shards:
                start, h, g, _, asked = b.hot(status)
                again = np.ones(len(start), bool)
                parts = _dealt(mix64(h[asked] ^ g[asked]), hot_shards)
                again[asked] = False
                for r in replies[replies["kind"] == "windows"].itertuples():
                    again[asked[parts[r.shard]]] = unpacked(r.data, np.uint8) == 1
                single.append(start[again])
            for s in single:
                np.add.at(flags, s, 1)
                np.add.at(flags, s + length, -1)
            bad = np.cumsum(flags[:-1]) > 0
            keys = np.frombuffer(row.keys, np.int64) if row_key else None
            for d, (x, y) in enumerate(zip(b.firsts.tolist(), b.ends.tolist(), strict=True)):
                own = bad[x:y]
                kept = b.data[x:y][~own].tobytes()
                spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(len(own) > 0 and own[0])
                more = ([int(keys[d])] if row_key else []) + ([kept.decode("utf-8", "ignore")] if with_text else [])
                out.append((None if b.null[d] else int(b.doc_ids[d]), y - x, int(own.sum()), spans, hashlib.sha256(kept).hexdigest(), *more))
        columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["row"] if row_key else []), *(["kept_text"] if with_text else [])]
        # A column of Python numbers with None would become floats.
        table = pd.DataFrame(out, columns=columns, dtype=object)
        return table.astype({"doc_id": "Int64"})

    return make


def suffix_dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = False, row: str | None = None, fold: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row; with_text: also kept_text. length: more than GRAM.

    kept_text is what is left, without the bytes of characters that a cut went through. row names a long column
    without nulls that is handed on as "row".
    """
    key = [F.col(row).cast("long").alias("row")] if row else []
    blocks = written(exact_ids(texts(docs, *key)).mapInPandas(_blocks(row is not None), _BLOCK), "texts")
    size = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    shards = int(size * 2 / (length - GRAM + 2)) // SHARD_KEYS + 1
    asked = blocks.mapInPandas(_ask(shards, length, fold), _REPLY)
    # A pick's segments and those that begin its index stay within the 21 bits of a place that sorting has room for.
    most = min(HOT_SEGMENTS, INDEX_BYTES * 3 // 4 // (2 * length))
    status = written(asked.groupBy("shard").applyInPandas(_copies("status", fold, most), _REPLY), "status")
    hot = status.agg(F.coalesce(F.sum("hot"), F.lit(0))).first()[0]
    hot_shards = -(-hot * (length - GRAM + 1) // SHARD_KEYS)
    sent = blocks.groupBy("block").cogroup(status.groupBy("block")).applyInPandas(_send(shards, hot_shards, length, fold), _REPLY)
    marks = written(sent.groupBy("kind", "shard").applyInPandas(_index(length), _REPLY), "marks")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", row long" if row else "") + (", kept_text string" if with_text else "")
    replies = status.unionByName(marks)
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(_removed(shards, hot_shards, length, fold, row is not None, with_text), schema)
