"""Language-model scores: an interpolated modified Kneser-Ney bigram model, counted and looked up in Spark.

Nothing of the model is broadcast or collected but a dozen totals; it lies in shards, each a sorted array of 64-bit
keys with counts. Texts are turned into blocks (rows of token arrays) once, in a written table. Then, three times over,
blocks send the distinct keys they hold to the shards that own them, a shard merges what training texts counted,
memory-maps its sorted arrays, and answers each block's keys by binary search:

1. words: 64-bit hashes; the answer is a word's number and count. Numbers rise as words get rarer, so that most are small;
2. bigrams: the numbers of both words (of any size: keys hold 32 bits of each, the rest is a page that the shard belongs to); the answer is the
   count. Shards also add up what contexts and words
   need: tokens after a context, how many of its continuations came once, twice, more often, and after how many
   different words a word came;
3. words again, for these sums; what blocks ask is what they were answered in 1.

A block sends a key once however often it has it, and bigrams of one word lie in many shards, so no word is hot.
Sorted keys are sent as differences, and a bigram's words apart. Questions are not written, and shuffle files are deleted as
soon as their answers are.
At most one row per key crosses a shuffle, usually one per block and shard.

The order is two: a third order would shuffle about as much again as the bigrams (README).

Edge cases: null and empty texts are one end token; the first token's context is the beginning of the text; words
not in the training texts share one unknown word's probability; with nothing to learn from all tokens are unknown; repeated
rows count and are scored each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, exact_ids, mix64, packed, shuffles_dropped, texts, unpacked, written

BLOCK_BYTES = 12 << 20  # text of a block
SHARD_KEYS = 1 << 20  # distinct keys that blocks send to one shard, about
END, BEGIN = b"\n", b" "  # no word has white space
UNKNOWN_ID, BEGIN_ID, FIRST_ID = 0, 1, 2
PAGE_BITS = 32  # a bigram's key has so many bits of each word's number; what is above them names a page, which is counted apart
PAGE_HALF = 20  # bits of a page for the second word


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    part, seq = TaskContext.get().partitionId(), 0
    for pdf in batches:
        ends = pdf["text"].str.len().cumsum().to_numpy() // BLOCK_BYTES
        for _, own in pdf.groupby(ends, sort=False):
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            ids, sizes = [], []
            for text in own["text"]:
                w = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
                w.append(END)
                sizes.append(len(w))
                ids.append(np.fromiter(map(number.__getitem__, w), np.uint32, len(w)))
            tokens = np.concatenate(ids)
            train = own["train"].to_numpy(bool)
            sizes = np.array(sizes, np.int64)
            # Local numbers by falling frequency, so that most are small, then by hash, so that differences are.
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
            often = np.lexsort((hashes, -np.bincount(tokens, minlength=len(number))))
            tokens, hashes = _ranks(often)[tokens].astype(np.uint32), hashes[often]
            yield pd.DataFrame(
                {
                    "block": [(part << 32) + seq],
                    "doc_ids": [own["missing"].to_numpy(bool).tobytes() + own["doc_id"].to_numpy(np.int64).tobytes()],
                    "train": [train.tobytes()],
                    "sizes": [packed(sizes)],
                    "tokens": [packed(tokens)],
                    "hashes": [_rising(hashes)],
                    "counts": [packed(np.bincount(tokens, np.repeat(train, sizes), len(hashes)).astype(np.uint32))],
                    "n_words": [len(hashes)],
                    "n_tokens": [len(tokens)],
                }
            )
            seq += 1


def _ranks(order: np.ndarray) -> np.ndarray:
    """The place of each element in an order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _rising(x: np.ndarray) -> bytes:
    """Numbers that mostly rise, packed as differences (modulo 2**64)."""
    return packed(np.diff(x, prepend=np.uint64(0)))


def _risen(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def _pairs(keys: np.ndarray) -> bytes:
    """Sorted keys of bigrams: differences of the first words' bits, then the second words' bits."""
    first, second = (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32)
    return packed(np.r_[np.diff(first, prepend=np.uint32(0)), second])


def _unpaired(data: bytes) -> np.ndarray:
    first, second = np.split(unpacked(data, np.uint32).astype(np.uint64), 2)
    return np.cumsum(first, dtype=np.uint64) << np.uint64(32) | second


_BLOCK = "block long, doc_ids binary, train binary, sizes binary, tokens binary, hashes binary, counts binary, n_words long, n_tokens long"
_ASK = "shard int, block long, x binary, y binary"
_REPLY = "kind string, shard int, block long, x binary, y binary, z array<long>"


def _by_shard(keys: np.ndarray, shards: int, plain: bool) -> list[np.ndarray]:
    """Positions of the keys of each shard (their remainder if plain); keys are sorted, so each shard's are too."""
    own = (keys if plain else mix64(keys)) % np.uint64(shards)
    order = np.argsort(own.astype(np.uint32), kind="stable")
    return np.split(order, np.searchsorted(own[order], np.arange(1, shards, dtype=np.uint64)))


def _mapped(x: np.ndarray) -> np.ndarray:
    """The array in a memory-mapped file that has no name, so nothing of it outlives the worker."""
    if not len(x):
        return x
    f = tempfile.TemporaryFile()
    x.tofile(f)
    f.flush()
    return np.memmap(f, x.dtype, "r", shape=x.shape)


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their rows of values."""
    k = np.concatenate([np.zeros(0, np.uint64), *keys])
    v = np.concatenate(values) if values else np.zeros((0, 1), np.int64)
    order = np.argsort(k, kind="stable")
    k, v = k[order], v[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(v, first, axis=0) if len(k) else v


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _histogram(x: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4."""
    return np.bincount(np.minimum(x, 5), minlength=6)[1:5].tolist()


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "shard", "block", "x", "y", "z"])


def _ask_words(shards: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                hashes, counts = _risen(row.hashes), unpacked(row.counts, np.uint32)
                order = np.argsort(hashes)
                yield pd.DataFrame(
                    [(s, row.block, _rising(hashes[order[i]] // np.uint64(shards)), packed(counts[order[i]])) for s, i in enumerate(_by_shard(hashes[order], shards, True)) if len(i)],
                    columns=["shard", "block", "x", "y"],
                )

    return make


def _word_shard(shards: int):
    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iat[0])
        keys = [_risen(x) * np.uint64(shards) + np.uint64(shard) for x in pdf["x"]]
        counts = [unpacked(y, np.uint32).astype(np.int64) for y in pdf["y"]]
        k, c = _summed([k[c > 0] for k, c in zip(keys, counts, strict=True)], [c[c > 0, None] for c in counts])
        k, c = _mapped(k), _mapped(c[:, 0])
        number = _mapped(_ranks(np.argsort(-c, kind="stable")))
        rows = [("sums", shard, None, None, None, [int(c.sum()), len(k)])]
        for block, own in zip(pdf["block"], keys, strict=True):
            at, hit = _find(k, own)
            ids = (np.where(hit, (number[at] + FIRST_ID) * shards + shard, UNKNOWN_ID) if len(k) else np.zeros(len(own))).astype(np.uint64)
            found = np.where(hit, c[at], 0) if len(k) else np.zeros(len(own))
            rows.append(("words", shard, block, packed(ids), packed(found.astype(np.uint64)), None))
        return _table(rows)

    return answer


def _known(ids: np.ndarray) -> np.ndarray:
    own = np.unique(ids)
    return own[own != UNKNOWN_ID]


class _Block:
    """A block with its words' numbers and, if replies have them, counts."""

    def __init__(self, row, replies: pd.DataFrame, shards: int):
        self.sizes, self.tokens = unpacked(row.sizes, np.int64), unpacked(row.tokens, np.uint32)
        hashes = _risen(row.hashes)
        self.ids, self.counts = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.uint64)
        order = np.argsort(hashes)
        parts = _by_shard(hashes[order], shards, True)
        for r in replies[replies["kind"] == "words"].itertuples():
            at = order[parts[r.shard]]
            self.ids[at] = unpacked(r.x, np.uint64)
            if r.y is not None:
                self.counts[at] = unpacked(r.y, np.uint64)

    def bigrams(self, page_bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Page by page: the tokens that are known as well as the word before them, and the key of both."""
        w = self.ids[self.tokens]
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[np.cumsum(self.sizes) - self.sizes] = BEGIN_ID
        known = np.flatnonzero((w > 0) & (v > 0))
        v, w = v[known], w[known]
        bits = np.uint64(page_bits)
        low = (np.uint64(1) << bits) - np.uint64(1)
        page = (v >> bits) << np.uint64(PAGE_HALF) | w >> bits
        key = (v & low) << np.uint64(32) | w & low
        for p in np.unique(page).tolist():
            own = page == p
            yield (p, known, key) if own.all() else (p, known[own], key[own])


def _ask_bigrams(shards: int, word_shards: int, page_bits: int):
    def make(_, rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples():
            block = _Block(row, replies, word_shards)
            train = np.repeat(np.frombuffer(row.train, bool), block.sizes)
            for page, at, keys in block.bigrams(page_bits):
                both = np.sort(keys)
                own = both[np.r_[True, both[1:] != both[:-1]]]
                learned = np.sort(keys[train[at]])
                counts = (np.searchsorted(learned, own, "right") - np.searchsorted(learned, own, "left")).astype(np.uint32)
                out += [("bigrams", s, row.block, _pairs(own[i]), packed(counts[i]), [page]) for s, i in enumerate(_by_shard(own, shards, False)) if len(i)]
        return _table(out)

    return make


def _bigram_shard(word_shards: int, page_bits: int):
    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, page = int(pdf["shard"].iat[0]), int(pdf["z"].iat[0][0])
        keys = [_unpaired(x) for x in pdf["x"]]
        counts = [unpacked(y, np.uint32).astype(np.int64) for y in pdf["y"]]
        k, c = _summed([k[c > 0] for k, c in zip(keys, counts, strict=True)], [c[c > 0, None] for c in counts])
        k, c = _mapped(k), _mapped(c[:, 0])
        rows = [("sums", shard, None, None, None, _histogram(c))]
        for block, own in zip(pdf["block"], keys, strict=True):
            at, hit = _find(k, own)
            rows.append(("bigrams", shard, block, packed((np.where(hit, c[at], 0) if len(k) else np.zeros(len(own))).astype(np.uint32)), None, [page]))
        # As contexts: tokens after it, continuations seen once, twice, more. As words: contexts before it.
        context = k >> np.uint64(32) | np.uint64((page >> PAGE_HALF) << page_bits)
        word = k & np.uint64(0xFFFFFFFF) | np.uint64((page & (1 << PAGE_HALF) - 1) << page_bits)
        zero = np.zeros(len(k), np.int64)
        as_context = np.stack([c, c == 1, c == 2, c > 2, zero], 1).astype(np.int64)
        as_word = np.stack([zero, zero, zero, zero, zero + 1], 1)
        ids, sums = _summed([context, word], [as_context, as_word])
        for s, i in enumerate(_by_shard(ids, word_shards, True)):
            if len(i):
                rows.append(("parts", s, None, _rising(ids[i]), _columns(sums[i]), None))
        return _table(rows)

    return answer


def _columns(sums: np.ndarray) -> bytes:
    """Five numbers of each word, column by column."""
    return packed(sums.T.ravel().astype(np.uint64))


def _rows(data: bytes) -> np.ndarray:
    return unpacked(data, np.uint64).reshape(5, -1).T.astype(np.int64)


def _context_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    shard = int(pdf["shard"].iat[0])
    parts = pdf[pdf["kind"] == "parts"]
    ids, sums = _summed([_risen(x) for x in parts["x"]], [_rows(y) for y in parts["y"]])
    begin = sums[ids == BEGIN_ID].sum(axis=0).tolist() if len(ids) else [0] * 5
    ids, sums = _mapped(ids), _mapped(sums)
    before = sums[:, 4] if len(ids) else np.zeros(0, np.int64)
    rows = [("sums", shard, None, None, None, [*_histogram(before[before > 0]), int((before > 2).sum()), int(before.sum()), *begin])]
    for r in pdf[pdf["kind"] == "words"].itertuples():
        own = _known(unpacked(r.x, np.uint64))
        if len(own):
            at, hit = _find(ids, own)
            rows.append(("contexts", shard, r.block, _columns(np.where(hit[:, None], sums[at], 0) if len(ids) else np.zeros((len(own), 5))), None, None))
    return _table(rows)


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2, 3 and more from how many keys have counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if n1 == 0 or n2 == 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    return np.array([0.0, *np.clip(d, 0.01, [0.99, 1.99, 2.99])])


class Totals:
    def __init__(self, tokens: int, words: int, bigrams: list[int], continued: list[int], more: int, total: int, begin: list[int]):
        self.tokens, self.words, self.total, self.begin = tokens, words, total, begin
        self.d2, self.d1 = discounts(bigrams), discounts(continued)
        self.rest = float(self.d1[1] * continued[0] + self.d1[2] * continued[1] + self.d1[3] * more)


def _scores(totals: Totals, shards: int, word_shards: int, page_bits: int):
    def make(_, rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"doc_id": pd.array([], "Int64"), "n_tokens": [], "n_known": [], "base_score": [], "score": []})]
        for row in rows.itertuples():
            b = _Block(row, replies, word_shards)
            ids = _known(b.ids)
            about = np.zeros((len(ids), 5))
            parts = _by_shard(ids, word_shards, True)
            for r in replies[replies["kind"] == "contexts"].itertuples():
                about[parts[r.shard]] = _rows(r.x)
            c = np.zeros(len(b.tokens))
            counted = replies[replies["kind"] == "bigrams"]
            for page, at, keys in b.bigrams(page_bits):
                own = np.unique(keys)
                count = np.zeros(len(own))
                parts = _by_shard(own, shards, False)
                for r in counted[[z[0] == page for z in counted["z"]]].itertuples():
                    count[parts[r.shard]] = unpacked(r.x, np.uint32)
                c[at] = count[np.searchsorted(own, keys)]
            # Word and context of each token as rows of about; row 0 is the beginning, unknown words get an empty row.
            about = np.vstack([totals.begin, about, np.zeros(5)])
            place = np.where(b.ids > 0, np.searchsorted(ids, b.ids), len(ids)) + 1
            w = place[b.tokens]
            v = np.empty_like(w)
            v[1:] = w[:-1]
            v[np.cumsum(b.sizes) - b.sizes] = 0
            t = totals
            cont = about[:, 4]
            lower = (np.maximum(cont - t.d1[np.minimum(cont, 3).astype(np.int64)], 0) + t.rest / (t.words + 1)) / t.total if t.total else np.full(len(cont), 1.0 / (t.words + 1))
            after = about[:, 0]
            spread = about[:, 1] * t.d2[1] + about[:, 2] * t.d2[2] + about[:, 3] * t.d2[3]
            seen = after > 0
            scale = np.divide(1.0, after, out=np.zeros(len(after)), where=seen)
            share = np.where(seen, spread * scale, 1.0)
            p = np.maximum(c - t.d2[np.minimum(c, 3).astype(np.int64)], 0) * scale[v] + share[v] * lower[w]
            base = np.log10((b.counts.astype(float) + 1) / (t.tokens + t.words + 1.0))[b.tokens]
            doc = np.repeat(np.arange(len(b.sizes)), b.sizes)
            add = lambda x, doc=doc, n=len(b.sizes): np.bincount(doc, x, n)
            doc_id = pd.array(np.frombuffer(row.doc_ids[len(b.sizes) :], np.int64), "Int64")
            doc_id[np.frombuffer(row.doc_ids[: len(b.sizes)], bool)] = pd.NA
            out.append(pd.DataFrame({"doc_id": doc_id, "n_tokens": b.sizes, "n_known": add((b.counts > 0)[b.tokens]).astype(np.int64), "base_score": add(base), "score": add(np.log10(p))}))
        return pd.concat(out[1:] or out)

    return make


def language_model(docs: DataFrame, train: Column, page_bits: int = PAGE_BITS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row, learning from rows where train holds."""
    blocks = written(exact_ids(texts(docs, F.coalesce(train, F.lit(True)).alias("train"))).mapInPandas(_blocks, _BLOCK), "blocks")
    with shuffles_dropped(docs.sparkSession):
        size = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
        word_shards = int(size["words"]) // SHARD_KEYS + 1
        shards = int(size["tokens"]) // SHARD_KEYS + 1
        asked = blocks.select("block", "hashes", "counts").mapInPandas(_ask_words(word_shards), _ASK)
        words = written(asked.groupBy("shard").applyInPandas(_word_shard(word_shards), _REPLY), "words")
        known = words.where("kind = 'words'")
        numbers = known.withColumn("y", F.lit(None).cast("binary"))
        pairs = blocks.select("block", "train", "sizes", "tokens", "hashes").groupBy("block").cogroup(numbers.groupBy("block"))
        asked = pairs.applyInPandas(_ask_bigrams(shards, word_shards, page_bits), _REPLY)
        bigrams = written(asked.groupBy("shard", "z").applyInPandas(_bigram_shard(word_shards, page_bits), _REPLY), "bigrams")
        parts = bigrams.where("kind = 'parts'").unionByName(numbers)
        contexts = written(parts.groupBy("shard").applyInPandas(_context_shard, _REPLY), "contexts")

        def sums(df: DataFrame, n: int) -> list[int]:
            row = df.where("kind = 'sums'").agg(*[F.coalesce(F.sum(F.col("z")[i]), F.lit(0)) for i in range(n)]).first()
            return [int(x) for x in row]

        tokens, vocabulary = sums(words, 2)
        n1, n2, n3, n4, more, total, *begin = sums(contexts, 11)
        totals = Totals(tokens, vocabulary, sums(bigrams, 4), [n1, n2, n3, n4], more, total, begin)
    replies = known.unionByName(bigrams.where("kind = 'bigrams'")).unionByName(contexts.where("kind = 'contexts'"))
    scored = blocks.drop("counts").groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(
        _scores(totals, shards, word_shards, page_bits), "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
