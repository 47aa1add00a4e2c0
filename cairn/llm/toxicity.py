"""Toxicity: a linear-chain conditional random field tags toxic words; marginals add up to a document score.

Labels are given per document, so token labels come first: over a bounded sample of labelled rows, Spark counts in how many toxic and
clean documents each word is; a word whose toxic share is far above the base rate (more than chance allows for
the size of the vocabulary) is a toxic token where a toxic document has it.

The field has two states (clean, toxic), emission weights of hashed features (the word, its beginnings
and endings) and transition weights; it is fitted by full-batch gradient steps with forward-backward
in one task over a bounded sample. All documents are then tagged whole: forward and backward ratios of a
batch advance in step over its texts, longest first. A document's score is a logistic function of its largest
marginal and of the expected number of toxic tokens, fitted on the same sample.

Edge cases: null and empty texts have no tokens and get the score of a text without toxic tokens; repeated
rows are scored each; without a usable label (none, or one class only) every score is 0; further columns
are not read; lang and source are never inputs.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts, written

LABELLED_ROWS = 20_000  # bound of the labelled sample for word counts
FIELD_ROWS = 3_000  # bound of the labelled sample for the field and the logistic function
FIELD_CHARS = 64 << 20  # and of its texts together (one text of each class is taken whatever its length)
FEATURES = 1 << 18
TRAIN_CUT = 256  # tokens per training chain; scoring chains are whole texts
STEPS = 60
SLICE_CHARS = 8 << 20  # text that is tagged at once

#: Bytes of words: ASCII letters (lower-cased) and all non-ASCII bytes; the rest separates.
_LETTER = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LETTER).split()


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) pairs of distinct words."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    which, feats = [], []
    for i, word in enumerate(words):
        w = word.decode("utf-8", "replace").lower().encode()
        own = [h(b"=" + w)] + [h(b"<" + w[:k]) for k in range(4, min(len(w), 9))] + [h(b">" + w[-k:]) for k in (3, 4, 5) if len(w) > k]
        feats.extend(own)
        which.extend([i] * len(own))
    return np.array(which, np.int64), (np.array(feats, np.uint64) % np.uint64(FEATURES)).astype(np.int64)


class Layout:
    """Chains laid out by time: the elements of step t are the t-th tokens of all chains that long, longest first."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(sizes), np.int64)
        rank[self.order] = np.arange(len(sizes))
        longest = int(sizes.max()) if len(sizes) else 0
        self.live = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest), "right")
        self.start = np.cumsum(self.live) - self.live
        chain = np.repeat(np.arange(len(sizes)), sizes)
        step = np.arange(len(chain)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.place = self.start[step] + rank[chain]


def ratios(e: np.ndarray, a: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of the toxic state. e: exp of emissions, by time; a: exp of transitions."""
    f, b = np.empty_like(e), np.ones_like(e)
    live, start = layout.live, layout.start
    if len(live):
        f[: live[0]] = e[: live[0]]
        for t in range(1, len(live)):
            n, s, r = live[t], start[t], f[start[t - 1] : start[t - 1] + live[t]]
            f[s : s + n] = np.minimum(e[s : s + n] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0]), 1e30)
        for t in range(len(live) - 1, 0, -1):
            n, s = live[t], start[t]
            x = e[s : s + n] * b[s : s + n]
            b[start[t - 1] : start[t - 1] + n] = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
    return f, b


class Field:
    """Weights of the field and of the document score."""

    def __init__(self):
        self.weights = np.zeros(FEATURES)
        self.bias = -2.0
        self.transitions = np.zeros((2, 2))
        self.score = np.zeros(3)

    def emissions(self, words: list[bytes]) -> np.ndarray:
        which, feats = features(words)
        return np.clip(self.bias + np.bincount(which, self.weights[feats], len(words)), -30, 30)

    def marginals(self, ids: np.ndarray, sizes: np.ndarray, words: list[bytes]) -> np.ndarray:
        """The probability of the toxic state for each token."""
        layout = Layout(sizes)
        e = np.empty(len(ids))
        e[layout.place] = np.exp(self.emissions(words))[ids] if len(ids) else 0.0
        f, b = ratios(e, np.exp(self.transitions), layout)
        odds = f * b
        return (odds / (1 + odds))[layout.place]

    def documents(self, marginal: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Columns 1, largest marginal, log of 1 + expected toxic tokens, for each document."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        top = np.zeros(len(sizes))
        np.maximum.at(top, doc, marginal)
        return np.stack([np.ones(len(sizes)), top, np.log1p(np.bincount(doc, marginal, len(sizes)))], axis=1)

    def fit(self, ids, sizes, words, y, toxic):
        """y: toxic tokens; toxic: documents. Full-batch Adam on the regularised conditional likelihood."""
        cut = np.concatenate([np.zeros(0, np.int64), *(np.r_[np.full(n // TRAIN_CUT, TRAIN_CUT), n % TRAIN_CUT] for n in sizes)])
        cut = cut[cut > 0]
        layout = Layout(cut)
        which, feats = features(words)
        by_time = np.empty(len(ids), np.int64)
        by_time[layout.place] = ids
        goal = np.empty(len(ids))
        goal[layout.place] = y
        ends = [(s, n) for s, n in zip(layout.start, layout.live, strict=True)]
        prev = np.concatenate([np.zeros(0, np.int64), *(np.arange(s, s + m) for (s, _), (_, m) in zip(ends, ends[1:], strict=False))])
        next_ = np.concatenate([np.zeros(0, np.int64), *(np.arange(s, s + m) for s, m in ends[1:])])
        seen = np.array([[np.sum((goal[prev] == i) & (goal[next_] == j)) for j in (0, 1)] for i in (0, 1)], float)
        used = np.unique(feats)
        params = np.concatenate([np.zeros(len(used)), [self.bias], np.zeros(4)])
        own = np.searchsorted(used, feats)
        m1, m2 = np.zeros_like(params), np.zeros_like(params)
        n = max(1, int(y.sum()))
        for step in range(1, STEPS + 1):
            em = np.clip(params[-5] + np.bincount(which, params[own], len(words)), -30, 30)
            e, a = np.exp(em)[by_time], np.exp(params[-4:].reshape(2, 2))
            f, b = ratios(e, a, layout)
            p = f * b / (1 + f * b)
            grad_word = np.bincount(by_time, p - goal, len(words)) / n
            pair = np.stack([np.ones(len(prev)) * a[0, 0], a[0, 1] * e[next_] * b[next_], f[prev] * a[1, 0], f[prev] * a[1, 1] * e[next_] * b[next_]], 1)
            grad_pair = ((pair / pair.sum(1, keepdims=True)).sum(0) - seen.ravel()) / n
            grad = np.concatenate([np.bincount(own, grad_word[which], len(used)), [grad_word.sum()], grad_pair]) + 1e-3 * params / n
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
            params = params - 0.3 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        self.weights[used] = params[: len(used)]
        self.bias, self.transitions = params[-5], params[-4:].reshape(2, 2)
        x = self.documents(self.marginals(ids, sizes, words), sizes)
        w = np.zeros(3)
        for _ in range(25):  # Newton's steps of a ridge logistic regression
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hess = (x * (q * (1 - q))[:, None]).T @ x + np.diag([1e-4, 0.05, 0.05])
            w = w + np.linalg.solve(hess, x.T @ (toxic - q) - np.array([1e-4, 0.05, 0.05]) * w)
        self.score = w


def _numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids, sizes = [np.zeros(0, np.int64)], []
    for text in texts:
        w = tokens(text)
        sizes.append(len(w))
        ids.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
    return np.concatenate(ids), np.array(sizes, np.int64), list(number)


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts: dict[bytes, list[int]] = {}
        for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
            for w in set(tokens(text)):
                counts.setdefault(w, [0, 0])[int(toxic)] += 1
        yield pd.DataFrame({"word": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]})


def toxic_words(labelled: DataFrame) -> list[bytes]:
    """Words whose share of toxic documents is above the base rate by more than chance."""
    base = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    if not 0 < base["k"] < base["n"]:
        return []
    p = base["k"] / base["n"]
    counts = labelled.select("text", "toxic").mapInPandas(_word_counts, "word binary, clean long, toxic long")
    counts = written(counts.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "words")
    vocabulary = counts.count()
    n = F.col("clean") + F.col("toxic")
    q = F.col("toxic") / n
    gain = n * (q * F.log(q / p) + F.when(F.col("clean") > 0, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0))
    found = counts.where((F.col("toxic") >= 3) & (q > 0.5)).where(gain > float(np.log(max(vocabulary, 1)) + 2.3))
    return [bytes(r[0]) for r in found.select("word").collect()]


def fit_field(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, field_rows: int = FIELD_ROWS, seed: int = 5, field_chars: int = FIELD_CHARS) -> Field:
    """The field learned from labels (doc_id, toxic) and their texts, on bounded samples."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = marked.orderBy(F.xxhash64(F.lit(seed), "doc_id")).limit(labelled_rows)  # at most labelled_rows of 12 bytes
    labelled = written(texts(docs).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]), "labelled")
    lexicon = toxic_words(labelled)
    if not lexicon:
        return Field()
    known = frozenset(lexicon)
    side, chars = F.row_number().over(_by_side(seed)), F.sum(F.length("text")).over(_by_side(seed))
    part = labelled.withColumns({"side": side, "chars": chars}).where((F.col("side") <= field_rows // 2) & ((F.col("chars") <= field_chars // 2) | (F.col("side") == 1)))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        ids, sizes, words = _numbered(pdf["text"].tolist())
        toxic = pdf["toxic"].to_numpy(float)
        bad = np.array([w in known for w in words], bool)
        y = bad[ids] & (np.repeat(toxic, sizes) > 0)
        field = Field()
        field.fit(ids, sizes, words, y.astype(float), toxic)
        return pd.DataFrame({"field": [pickle.dumps(field)]})

    # A bounded sample in one task, so a lost executor only repeats it; one row comes back.
    return pickle.loads(part.select("doc_id", "text", "toxic", F.lit(0).alias("all")).groupBy("all").applyInPandas(train, "field binary").first()[0])


def _by_side(seed: int):
    from pyspark.sql import Window

    return Window.partitionBy("toxic").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)


def toxicity(docs: DataFrame, field: Field, spans: bool = False) -> DataFrame:
    """doc_id, score, and with spans also the offending offsets: start, end (characters) and text of marginals over one half."""
    model = docs.sparkSession.sparkContext.broadcast(field)

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model.value
        for pdf in (x for batch in batches for x in slices(batch, SLICE_CHARS)):
            ids, sizes, words = _numbered(pdf["text"].tolist())
            p = own.marginals(ids, sizes, words)
            x = own.documents(p, sizes)
            score = 1 / (1 + np.exp(-np.clip(x @ own.score, -30, 30))) if own.score.any() else np.zeros(len(pdf))
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "score": score})
            if spans:
                first = np.cumsum(sizes) - sizes
                out["spans"] = [_spans(t, p[a : a + n]) for t, a, n in zip(pdf["text"], first, sizes, strict=True)]
            yield out

    more = ", spans array<struct<start:int,end:int,text:string>>" if spans else ""
    return texts(docs).mapInPandas(tag, "doc_id long, score double" + more)


def _spans(text: str, marginal: np.ndarray) -> list[dict]:
    raw = text.encode("utf-8", "surrogatepass")
    if not (marginal > 0.5).any():
        return []
    out: list[dict] = []
    last = -2
    for k, m in enumerate(re.finditer(rb"[^ ]+", raw.translate(_LETTER))):
        if marginal[k] > 0.5:
            a, b = (len(raw[:x].decode("utf-8", "replace")) for x in m.span())
            if last == k - 1:
                a = out.pop()["start"]
            out.append({"start": a, "end": b, "text": text[a:b]})
            last = k
    return out


def fold(column: str, folds: int) -> Column:
    """crc32 of an id as text, modulo folds."""
    return F.pmod(F.crc32(F.col(column).cast("long").cast("string").cast("binary")), F.lit(folds))
