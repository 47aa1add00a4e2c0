"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

1. Documents are read in batches. A batch becomes one row of a written table: its documents with the
   frequencies of their pre-tokens (a sparse matrix over batch-local numbers) and its distinct pre-tokens.
2. The pre-tokens of all batches are dealt out and sorted by pre-token; each distinct one is encoded once,
   and its count goes to every batch that has it.
3. The counts are joined to the batches' frequencies and summed per document. No ids are kept.

A frequent pre-token comes once per batch at most, so no key is hot.

The split is that of the tokenizer's file: by the published pattern where the file has the plain byte-level pre-tokenizer, else by the
library itself; a file that rewrites texts before the split (a normalizer) is refused.

Edge cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; special strings
inside texts are one token, as the library's default has it; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact_ids, packed, texts, unpacked, written

LIMIT = 512

# The published pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Code points that the installed regex and tokenizers libraries are known to class alike; texts with others
# (newer scripts) are split by the library itself.
KNOWN = "\\u0000-\\u0557\\u0cdd-\\u208e\\u20a0-\\ua7cd\\uab6e-\\ud7ff\\ue000-\\uffff"


@lru_cache(maxsize=2)
def _library(path: str):
    """The tokenizer, its special strings, and whether it splits by PATTERN."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    if file.get("normalizer"):
        raise ValueError("tokenizers that rewrite texts are not supported")
    split = file.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    return tokenizer, [x["content"] for x in file["added_tokens"]], plain


def splitter(path: str):
    """A function from a text to its pre-tokens; special strings are pre-tokens of their own."""
    import regex

    tokenizer, special, by_pattern = _library(path)
    find = regex.compile(PATTERN).findall
    unknown = regex.compile(f"[^{KNOWN}]").search
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None

    def plain(text: str) -> list[str]:
        if by_pattern and not unknown(text):
            return find(text)
        return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)] if tokenizer.pre_tokenizer else [text]

    def split(text: str) -> list[str]:
        if not any(x in text for x in special):
            return plain(text)
        return [y for k, x in enumerate(cut(text)) for y in ([x] if k % 2 else plain(x))]

    return split


def _frequencies(path: str):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = splitter(path)
        part = TaskContext.get().partitionId()
        for seq, pdf in enumerate(batches):
            local: defaultdict[str, int] = defaultdict()
            local.default_factory = local.__len__
            n_bytes, sizes, ids, counts = [], [], [], []
            for text in pdf["text"]:
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                tokens = split(text)
                i, c = np.unique(np.fromiter(map(local.__getitem__, tokens), np.uint32, len(tokens)), return_counts=True)
                sizes.append(len(i))
                ids.append(i)
                counts.append(c.astype(np.uint32))
            # Neighbours in order share beginnings, which the shuffles compress; ids are kept as steps within a document.
            pieces = sorted(local)
            place = np.empty(len(pieces), np.uint32)
            place[[local[p] for p in pieces]] = np.arange(len(pieces), dtype=np.uint32)
            order = [np.sort(place[i]) for i in ids]
            counts = [c[np.argsort(place[i])] for i, c in zip(ids, counts, strict=True)]
            steps = [np.diff(i, prepend=np.uint32(0)) for i in order]
            join = lambda x: packed(np.concatenate([np.zeros(0, np.uint32), *x]))
            yield pd.DataFrame(
                {
                    "batch": [(part << 32) + seq],
                    "doc_ids": [pdf["missing"].to_numpy(bool).tobytes() + pdf["doc_id"].to_numpy(np.int64).tobytes()],
                    "n_bytes": [np.array(n_bytes, np.int64).tobytes()],
                    "sizes": [np.array(sizes, np.int64).tobytes()],
                    "ids": [join(steps)],
                    "counts": [join(counts)],
                    "pieces": [pieces],
                }
            )

    return make


def _encode(path: str):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = _library(path)[0]
        last, n = None, 0
        for pdf in batches:  # sorted by piece: each piece is encoded where its run begins
            which, pieces = pd.factorize(pdf["piece"])
            fresh = [p for p in pieces if p != last]
            known = {last: n} | {p: len(x.ids) for p, x in zip(fresh, tokenizer.encode_batch(fresh, add_special_tokens=False), strict=True)}
            counts = np.array([known[p] for p in pieces], np.int32)
            last, n = pieces[-1], int(counts[-1])
            yield pd.DataFrame({"batch": pdf["batch"], "at": pdf["at"], "n": counts[which]})

    return make


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples():
            n_bytes, sizes = (np.frombuffer(x, np.int64) for x in (row.n_bytes, row.sizes))
            doc_ids = pd.array(np.frombuffer(row.doc_ids[len(sizes) :], np.int64), "Int64")
            doc_ids[np.frombuffer(row.doc_ids[: len(sizes)], bool)] = pd.NA
            steps, counts = unpacked(row.ids, np.uint32), unpacked(row.counts, np.uint32)
            ends = np.cumsum(steps, dtype=np.int64)
            before = np.r_[0, ends][np.cumsum(sizes) - sizes]
            ids = ends - np.repeat(before, sizes)
            n = np.zeros(len(ids) and int(ids.max()) + 1, np.int64)
            if row.at is not None:
                n[np.asarray(row.at)] = np.asarray(row.n)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            total = np.bincount(doc, n[ids] * counts if len(ids) else None, len(sizes)).astype(np.int64)
            yield pd.DataFrame({"doc_id": doc_ids, "n_bytes": n_bytes, "n_tokens": total})


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row, for a byte-level BPE file of the tokenizers library."""
    table = written(
        exact_ids(texts(docs)).mapInPandas(
            _frequencies(tokenizer),
            "batch long, doc_ids binary, n_bytes binary, sizes binary, ids binary, counts binary, pieces array<string>",
        ),
        "frequencies",
    )
    met = table.select("batch", F.posexplode("pieces").alias("at", "piece"))
    # All rows of a piece, one per batch at most, meet sorted in one partition: counted once, joined by run.
    counted = met.repartition("piece").sortWithinPartitions("piece").mapInPandas(_encode(tokenizer), "batch long, at int, n int")
    back = counted.groupBy("batch").agg(F.collect_list(F.struct("at", "n")).alias("x")).select("batch", "x.at", "x.n")
    return (
        table.drop("pieces").join(back, "batch", "left")
        .mapInPandas(_sums, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
