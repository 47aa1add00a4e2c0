"""Operators against brute force on small fixtures, with the edge cases their docstrings define."""

import collections
import hashlib
import math
import os
import re
import time
import zlib
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import decontamination, language_model, license_scan, mixing, near_duplicates, quality_rules, suffix_dedup, token_counts, toxicity, url_filters
from cairn.llm.components import components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, block long, score double, a long, component long"
P = "The quick brown fox number {} jumps over the lazy dog while seven wizards boil {} fine potions in the old tower by the sea and sing about {} ships. "


def rows(*texts, start=0):
    return [(start + i, t, "en", "s" + str(i % 3), len(t or ""), 1, False, 2, 0.5, 1, 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing names."""
    long = " ".join(f"w{i % 5000}" for i in range(60000))
    one = "".join(P.format(i, i * 7, i * 3) for i in range(30))
    data = rows(None, "", " \n\t", "a", one, one, one.replace("fox number 3", "ox number 3"), long, "é" * 300, "x" * 500, "one two three", "one two three")
    data.append((None, "text without id " * 20, None, None, None, None, None, None, None, None, None))
    data.append((4, one, "en", None, 3, 1, True, 2, 0.5, 1, 1))
    return spark.createDataFrame(data, COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def text_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# 1 quality rules


def base(t):
    w = words(t)
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_base(spark, docs, odd):
    for df in (docs, odd.where("doc_id IS NOT NULL")):
        texts = text_of(df)
        for r in quality_rules.quality_rules(df).collect():
            assert tuple(r[c] for c in quality_rules.BASE) == base(texts[r.doc_id])
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_quality_order_changes_no_verdict(spark, docs, none):
    a = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    b = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, quality_rules.RULES[::-1], 50).collect()}
    assert a == b and 0 < sum(a.values()) < len(a)
    assert {r.doc_id for r in quality_rules.good_documents(docs).select("doc_id").collect()} == {k for k, v in a.items() if v}
    assert quality_rules.quality_rules(none).count() == quality_rules.good_documents(none).count() == 0


def test_quality_cascade_prefers_cheap_rejections(spark, docs):
    free, idle = quality_rules.Rule("all", "n_words > 0"), quality_rules.Rule("none", "length(regexp_replace(text, '[a-z]', '')) < 0")
    assert [r.name for r in quality_rules.measured_order(docs, [idle, free])] == ["all", "none"]


def test_quality_cascade_counts_what_is_left():
    """A rule that rejects much, but only what another rejects too, comes after one that rejects others."""
    outcomes = [((True, True, False), 50), ((True, False, False), 10), ((False, False, True), 5), ((False, False, False), 35)]
    assert quality_rules.cascade(outcomes, [1.0, 1.0, 1.0]) == [0, 2, 1]
    assert quality_rules.cascade(outcomes, [10.0, 1.0, 1.0]) == [1, 2, 0]
    assert quality_rules.cascade([], [2.0, 1.0]) == [1, 0] and quality_rules.cascade(outcomes, []) == []


# 2 suffix dedup


def brute_dedup(texts, length=100):
    seen, out = set(), {}
    for i in sorted(texts):
        b = texts[i].encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(b[k : k + length])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("how", ["small", "large", "index", "hot"])
def test_suffix_dedup(spark, docs, odd, how, monkeypatch):
    """Equal to brute force with few and many shards, with every segment through the index, and with all picks hot."""
    df = docs.select("doc_id", "text")
    if how == "large":
        df = df.unionByName(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select(F.col("doc_id") + 10000, "text").toDF("doc_id", "text"))
    else:
        monkeypatch.setattr(suffix_dedup, "SHARD_KEYS", 50 if how == "small" else 5000)
    if how == "hot":
        monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", 1)
    want = brute_dedup(text_of(df))
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(df.repartition(3), fold=how != "index").collect()}
    assert got == want


@pytest.mark.parametrize("how", ["fold", "index", "hot"])
def test_suffix_dedup_rows(spark, how, monkeypatch):
    """Rows that share a doc_id, or have none, keep their own marks."""
    if how == "hot":
        monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", 1)
    rng = np.random.default_rng(4)
    a, b, c, d = ("".join(map(chr, rng.integers(97, 123, 300))) for _ in range(4))
    twice = c[:150] + "!" + c[10:150] + "?" + c[20:]
    texts_ = [(7, a), (7, b), (7, twice), (7, twice), (5, b[:150] + "-" + d), (None, d), (None, a[50:250]), (None, d + c), (9, c), (2**53 + 1, "x" + d)]
    df = spark.createDataFrame(texts_, "doc_id long, text string").coalesce(1)
    out = suffix_dedup.suffix_dedup(df, fold=how != "index", with_text=True).collect()
    want = []
    order = lambda k: (texts_[k][0] is None, texts_[k][0] or k)
    for k, (_, t) in enumerate(texts_):
        gone = [False] * len(t)
        for i in range(len(t) - 99):
            w = t[i : i + 100]
            if any(w in u for j, (_, u) in enumerate(texts_) if order(j) < order(k)) or t.index(w) < i:
                gone[i : i + 100] = [True] * 100
        want.append("".join(x for x, g in zip(t, gone, strict=True) if not g))
    assert sorted((str(r.doc_id), r.kept_text) for r in out) == sorted((str(t[0]), w) for t, w in zip(texts_, want, strict=True))


def test_suffix_dedup_edges(spark, odd, none):
    out = suffix_dedup.suffix_dedup(odd, with_text=True).collect()
    assert len(out) == odd.count() and suffix_dedup.suffix_dedup(none).count() == 0
    same = [r for r in out if r.doc_id == 4]
    assert len(same) == 2 and {r.n_removed for r in same} == {0}, "rows of one doc_id are no repeats of each other"
    assert all(r.kept_text is not None for r in out)
    x = next(r for r in out if r.doc_id == 9)
    assert (x.n_removed, x.n_spans) == (499, 1)


def test_suffix_dedup_other_lengths(spark, docs):
    df = docs.select("doc_id", "text").where("doc_id < 60")
    for length in (40, 1500):
        want = brute_dedup(text_of(df), length)
        assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(df, length).collect()} == want


def test_run_index():
    """Matching statistics of other texts, and repeats of the index's own, against brute force."""
    rng = np.random.default_rng(1)
    for trial in range(20):
        sizes = rng.integers(1, 60, 12)
        data = rng.integers(0, 2 + trial % 3, sizes.sum()).astype(np.uint8)
        rows_ = np.repeat(np.arange(6), 2) if trial % 2 else np.arange(12)
        ids = np.sort(rng.integers(0, 6, rows_.max() + 1))[rows_]
        index = suffix_dedup.RunIndex(data, sizes, 12)
        ends, segment = np.cumsum(sizes), np.repeat(np.arange(12), sizes)
        want, seen = np.zeros(len(data), bool), []
        for i in range(len(data)):
            if ends[segment[i]] - i >= 12:
                w = data[i : i + 12].tobytes()
                want[i] = any(v == w and (ids[segment[j]] < ids[segment[i]] or rows_[segment[j]] == rows_[segment[i]]) for j, v in seen)
                seen.append((i, w))
        assert (suffix_dedup.repeated(data, sizes, ids, rows_, 12) == want).all() and index.runs <= len(data) + 12
        query = rng.integers(0, 4, 50).astype(np.uint8)
        match, _ = index.statistics(query, np.array([20, 30]))
        texts_ = [data[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)]
        for i in range(50):
            most = (20 if i < 20 else 50) - i
            assert match[i] == max(k for k in range(most + 1) if any(query[i : i + k].tobytes() in t for t in texts_))


def test_run_index_compresses_repeats():
    """One text many times over: runs grow with the different strings, not with the bytes."""
    text = np.random.default_rng(2).integers(0, 26, 400).astype(np.uint8)
    few, many = (suffix_dedup.RunIndex(np.tile(text, k), np.full(k, 400)) for k in (2, 200))
    assert many.runs < 30 * few.runs


# 3 near duplicates


def brute_classes(texts):
    bags = {i: collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in texts.items() if (w := words(lower(t)))}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = sum((bags[a] & bags[b]).values())
            if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}


def test_near_duplicates(spark, docs, odd):
    for df in (docs, odd.where("doc_id IS NOT NULL")):
        got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(df).collect()}
        assert got == brute_classes(text_of(df))


def test_near_duplicate_rows(spark):
    """Rows that share a doc_id or have none are judged by their own texts; one row of each class is first."""
    one, other = (" ".join(f"{w}{i}" for i in range(200)) for w in ("a", "b"))
    data = [(7, one), (7, other), (3, other + " end"), (None, one), (None, "alone " * 9), (8, "alone " * 9), (9, ""), (9, None), (2**53 + 1, "x y"), (2**53 + 2, "x y")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(data)], "k long, doc_id long, text string")
    out = {r.row: (r.doc_id, r.class_id, r.first) for r in near_duplicates.near_duplicates(df, row="k").collect()}
    want = [(7, 7, True), (7, 3, False), (3, 3, True), (None, 7, False), (None, 8, False), (8, 8, True), (9, 9, True), (9, 9, True), (2**53 + 1, 2**53 + 1, True), (2**53 + 2, 2**53 + 1, False)]
    assert out == dict(enumerate(want))


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicate_chains(spark, block, monkeypatch):
    """Chains of texts whose ends differ, some beside other classes: leaders do not reach all, blocks do."""
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rng = np.random.default_rng(9)
    texts_ = {}
    for c in range(4):
        w = [f"c{c}w{i}" for i in range(150)]
        for k in range(40):
            texts_[int(rng.integers(0, 10**9))] = " ".join(w)
            w[int(rng.integers(0, 150))] = f"n{c}k{k}"
            if k % 9 == 8:  # a jump that ends the chain, but still shares bands
                for j in rng.integers(0, 150, 5):
                    w[int(j)] = f"j{c}k{k}j{j}"
    df = spark.createDataFrame(list(texts_.items()), "doc_id long, text string")
    want = brute_classes(texts_)
    assert {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(df).collect()} == want and len(set(want.values())) > 4


def test_near_duplicate_variants(spark, none, odd):
    """A large group of variants of one text, none of which is the base, is one class with a link per member or so."""
    base_ = [f"word{i}" for i in range(400)]
    data = [(k, " ".join(w if (i + k) % 97 else f"other{k}" for i, w in enumerate(base_))) for k in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = near_duplicates.near_duplicates(df).collect()
    assert {r.class_id for r in out} == {0}
    _, links = near_duplicates.near_duplicate_links(df)
    assert links.count() < 60 * 32  # bands times members, not pairs
    assert near_duplicates.near_duplicates(none).count() == 0
    assert [r.class_id for r in near_duplicates.near_duplicates(odd).where("doc_id IS NULL").collect()] == [None]


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(3)
    errors = []
    for n in range(60):
        keys = near_duplicates.mix64(np.arange(n * 1000, n * 1000 + 40, dtype=np.uint64))
        a, b = rng.integers(0, 9, 40), rng.integers(0, 9, 40)
        bags = [(keys[c > 0], c[c > 0].astype(np.int64)) for c in (a, b)]
        s = near_duplicates.bag_minhash(bags, 256)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.06


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 120)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 120)}


# 4 toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = toxicity.fold("doc_id", 5) == 0
    field = toxicity.fit_field(docs, labels.where(~held))
    out = toxicity.toxicity(docs, field, spans=True).join(labels, "doc_id").select("doc_id", "score", "toxic", "spans", held.alias("held")).collect()
    own = [r for r in out if r.held]
    clean, bad = [r.score for r in own if not r.toxic], [r.score for r in own if r.toxic]
    assert np.mean([[x < y for x in clean] for y in bad]) > 0.8
    assert sum(s >= 0.5 for s in clean) <= 8
    texts = text_of(docs)
    for r in out:
        for s in r.spans:
            assert texts[r.doc_id][s.start : s.end] == s.text and r.score >= 0


def test_toxicity_edges(spark, odd, none):
    field = toxicity.fit_field(odd, spark.createDataFrame([(1, None), (None, 1), (4, 0)], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.toxicity(odd, field).collect()} == {0.0}
    assert toxicity.toxicity(none, field).count() == 0
    data = [(i, ("you are a foulword " if i % 4 == 0 else "you are a nice ") + f"person number {i} and we said so", i % 4 == 0) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string, t boolean")
    field = toxicity.fit_field(df, df.select("doc_id", F.col("t").cast("int").alias("toxic")))
    got = toxicity.toxicity(odd.unionByName(df.select("doc_id", "text"), allowMissingColumns=True), field)
    assert got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    scored = {r.doc_id: r.score for r in toxicity.toxicity(df, field).collect()}
    assert all((scored[i] >= 0.5) == t for i, _, t in data)
    empty = toxicity.toxicity(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string"), field).collect()
    assert len({r.score for r in empty}) == 1 and empty[0].score < 0.5


def test_toxic_words_and_scores_by_brute_force(spark):
    """The lexicon by plain counts; scores from enumerated marginals; the fit lowers its own loss; bounds of the sample hold."""
    rng = np.random.default_rng(6)
    vocabulary = [f"word{i}" for i in range(40)]
    data = []
    for i in range(300):
        bad = i % 5 == 0
        w = list(rng.choice(vocabulary, 8)) + (["vile"] if bad or i % 97 == 1 else []) + (["nasty"] if bad and i % 2 else [])
        data.append((i, " ".join(rng.permutation(w)), int(bad)))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    counts = collections.defaultdict(lambda: [0, 0])
    for _, t, y in data:
        for w in set(t.split()):
            counts[w][y] += 1
    p, want = sum(y for *_, y in data) / len(data), []
    for w, (c, k) in counts.items():
        n, q = c + k, k / (c + k)
        gain = n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if c else 0)) if k else 0
        if k >= 3 and q > 0.5 and gain > math.log(len(counts)) + 2.3:
            want.append(w.encode())
    assert sorted(toxicity.toxic_words(df)) == sorted(want) == [b"nasty", b"vile"]
    labels = df.select("doc_id", "toxic")
    field = toxicity.fit_field(df, labels)
    for i, t, _ in data[:12]:
        words_ = toxicity.tokens(t)
        e, a = np.exp(field.emissions(words_)), np.exp(field.transitions)
        total, mass = 0.0, np.zeros(len(words_))
        for s in np.ndindex(*[2] * len(words_)):
            x = np.prod(np.where(s, e, 1.0)) * np.prod([a[s[k], s[k + 1]] for k in range(len(words_) - 1)])
            total, mass = total + x, mass + x * np.array(s)
        m = mass / total
        z = field.score @ [1, m.max(), math.log1p(m.sum())]
        got = toxicity.toxicity(df.where(F.col("doc_id") == i), field).first().score
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-6
    few = toxicity.fit_field(df, labels, field_chars=200)
    assert np.isfinite(few.score).all() and toxicity.toxicity(df, few).where("score < 0 OR score > 1").count() == 0


def test_field_marginals_match_enumeration():
    rng = np.random.default_rng(5)
    e, a = np.exp(rng.normal(size=6)), np.exp(rng.normal(size=(2, 2)))
    sizes = np.array([4, 2])
    layout = toxicity.Layout(sizes)
    by_time = np.empty(6)
    by_time[layout.place] = e
    f, b = toxicity.ratios(by_time, a, layout)
    p = (f * b / (1 + f * b))[layout.place]
    for first, n in ((0, 4), (4, 2)):
        total, mass = 0.0, np.zeros(n)
        for s in np.ndindex(*[2] * n):
            w = np.prod([e[first + k] if s[k] else 1 for k in range(n)]) * np.prod([a[s[k], s[k + 1]] for k in range(n - 1)])
            total, mass = total + w, mass + w * np.array(s)
        assert np.allclose(p[first : first + n], mass / total)


# 5 token counts


def test_token_counts(spark, docs, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    strange = spark.createDataFrame(rows("a<|endoftext|>b  c", "\u0558x y \u2028 z", "it's  \n\n we'll\x1c\x85 go", "𝔘 ⅷ ١٢ 中文テキスト", "<|endoftext|>", start=50000), COLUMNS)
    for df in (docs, odd, strange):
        want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in df.select("doc_id", "text").collect())
        got = token_counts.token_counts(df, path).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.token_counts(none, path).count() == 0


# 6 decontamination


def brute_hits(texts, items):
    split = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    out = {}
    windows = [(i, tuple(w[k : k + 10])) for i, t in items for w in [split(lower(t or ""))] if w for k in range(max(1, len(w) - 9))]
    for d, t in texts.items():
        w = split(lower(t))
        hit, its = set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    its.add(str(i))
        out[d] = (len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes, slots", [(1 << 20, 1), (600, 1 << 22), (600, 50)])
def test_decontamination(spark, odd, none, block_bytes, slots):
    items = [(1, P.format(1, 2, 3)), (2, None), (3, "one two THREE"), (10, "é" * 300), (4, "!!"), (5, P.format(1, 2, 3) + "more words"), (6, "w7 w8 w9 w10 w11 w12 w13 w14 w15 w16")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = spark.createDataFrame(rows("so " + P.format(1, 2, 3).upper() + " and one-two,three", "one two", start=90), COLUMNS)
    df = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(more)
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.decontamination(df, bench, broadcast_bytes=block_bytes, slots=slots).collect()}
    assert got == brute_hits(text_of(df), items)
    assert decontamination.decontamination(none, bench).count() == 0
    assert decontamination.decontamination(odd, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_blocks_keep_rows(spark, odd):
    """Missing and repeated doc_ids: the same rows whatever the size of the benchmark."""
    items = [(1, P.format(1, 2, 3)), (3, "one two THREE"), (10, "é" * 300), (6, "w7 w8 w9 w10 w11 w12 w13 w14 w15 w16"), (7, "without id")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = spark.createDataFrame([(None, "clean"), (None, "one two three"), (4, "clean"), (4, P.format(1, 2, 3))], "doc_id long, text string")
    df = odd.select("doc_id", "text").unionByName(more)
    plain = [sorted(map(repr, decontamination.benchmark_hits(df, bench, broadcast_bytes=b).collect())) for b in (1 << 20, 100)]
    assert len(plain[0]) == df.count() and plain[0] == plain[1]


def test_decontamination_large_benchmark(spark):
    """A benchmark of more than 32 MiB stays in Spark; an item without item_id is listed as an empty string."""
    item = F.concat_ws(" ", *[F.concat(F.lit("w"), F.hash(F.lit(j), "id").cast("string")) for j in range(30)])
    bench = spark.range(120000).select(F.col("id").alias("item_id"), F.translate(item, "-", "m").alias("text"))
    bench = bench.unionByName(spark.createDataFrame([(None, "a text of nobody"), (5, None)], "item_id long, text string"))
    assert bench.agg(F.sum(F.octet_length("text"))).first()[0] > 32 << 20
    some = {r.item_id: r.text for r in bench.where("item_id IN (3, 70000, 119999)").collect()}
    data = [(1, "so " + " ".join(some[3].split()[4:16]) + " end"), (None, some[70000].upper()), (2, " ".join(some[119999].split()[:9])), (2, "this is a text of nobody!"), (3, None)]
    out = decontamination.benchmark_hits(spark.createDataFrame(data, "doc_id long, text string"), bench).collect()
    assert sorted((str(r.doc_id), len(r.hits), r.items) for r in out) == [("1", 12, ["3"]), ("2", 0, []), ("2", 4, [""]), ("3", 0, []), ("None", 30, ["70000"])]
    small = bench.where("item_id IS NULL OR item_id < 9")
    assert sorted(map(repr, decontamination.benchmark_hits(spark.createDataFrame(data, "doc_id long, text string"), small).where("doc_id = 2").select("items").collect())) == ["Row(items=[''])", "Row(items=[])"]


# 7 licence scan


def test_license_scan(spark, odd, none):
    texts = ["A poem.\nReleased under the mit LICENCE\nend", "copyright 2020 me\nLicensed under the Apache License, version 2.0!", "no licence here", "Released under the MIT License. And more.", None]
    got = {r.doc_id: (r.licenses, r.n_licenses, r.whole_text) for r in license_scan.license_scan(spark.createDataFrame(rows(*texts), COLUMNS)).collect()}
    assert got == {0: ("MIT", 1, False), 1: ("Apache-2.0", 1, True), 2: ("", 0, False), 3: ("", 0, False), 4: ("", 0, False)}
    assert license_scan.license_scan(odd).where("n_licenses > 0").count() == 0 and license_scan.license_scan(odd).count() == odd.count()
    assert license_scan.license_scan(none).count() == 0
    assert license_scan.license_scan(odd, license_scan.known_licenses(spark).limit(0)).count() == odd.count()


def test_license_scan_finds_every_known_text(spark):
    isc = dict((k, t) for k, t in license_scan.KNOWN if t.startswith("Permission to use"))["ISC"]
    mit = next(t for k, t in license_scan.KNOWN if k == "MIT" and len(t) > 500)
    wrapped = "The MIT License (MIT)\n\nCopyright (c) 2020 Me\n\n" + mit.strip().replace(" of ", "\nof ")
    apache = next(t for k, t in license_scan.KNOWN if k == "Apache-2.0" and len(t) > 5000)
    texts = ["A tool.\nLicensed under CC BY-NC 4.0.\nend", f"A tool.\n{isc}\nend", wrapped, f"A tool.\n\n{wrapped}\n\nend", apache, "# Tool\n" + apache, "x " + mit[:-60]]
    got = {r.doc_id: (r.licenses, r.whole_text) for r in license_scan.license_scan(spark.createDataFrame(rows(*texts), COLUMNS)).collect()}
    assert got == {0: ("CC-BY-NC-4.0", False), 1: ("ISC", False), 2: ("MIT", True), 3: ("MIT", False), 4: ("Apache-2.0", True), 5: ("Apache-2.0", False), 6: ("", False)}
    known = spark.createDataFrame([("Beer", "Do as you like."), ("Beer", None)], "license_id string, text string")
    out = license_scan.license_scan(spark.createDataFrame(rows("do as you LIKE", "so\nDo as you like!\n", "Do as you like or not"), COLUMNS), known)
    assert {r.doc_id: (r.licenses, r.whole_text) for r in out.collect()} == {0: ("Beer", True), 1: ("Beer", False), 2: ("", False)}


def test_canonical_lines(spark, docs, odd):
    """The lines of a whole text in one pass are the canonical forms of its lines."""
    text = F.coalesce("text", F.lit(""))
    each = F.array_distinct(F.filter(F.transform(F.split(text, "\n", -1), license_scan.canonical), lambda x: x != ""))
    strange = spark.createDataFrame([("Sub licence\nsub\nLicence, licence - Licence\r\n (c) me\n\n© x\nnoncommercial",)], "text string")
    for df in (docs, odd, strange):
        assert df.where(~F.array_sort(each).eqNullSafe(F.array_sort(license_scan.canonical_lines(license_scan.words_in_lines(text))))).count() == 0
        assert df.where(license_scan.canonical(text) != license_scan.canonical_of(license_scan.words_in_lines(text))).count() == 0


def test_license_scan_after_a_shuffle(spark):
    """Each row keeps its own licences where rows come by round robin."""
    df = spark.range(20000, numPartitions=9).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Released under the MIT License.").otherwise("no").alias("text"))
    out = license_scan.license_scan(df.repartition(13))
    assert out.where("(n_licenses = 1) != (doc_id % 3 = 0)").count() == 0 and out.count() == 20000


# 8 URL filters


def test_url_filters(spark):
    urls = ["http://A.Example.com/en/7?x", "https://example.com/en/6", "http://x.net/de/1", "http://example.net/de/8/9#a", "http://spam-farm.example.org/fr/1", "http://blog.spam-farm.example.org", "no url", None, "http://notcom/en/", "ftp://org/es/", "http://good.example.org?q=/en/", "x://", "http://bad.test/page/"]
    pages = spark.createDataFrame([(i, u, None, "r") for i, u in enumerate(urls)] + [(5, urls[5], None, "r"), (None, "http://com/en/", None, "r")], "page_id long, url string, html string, rule string")
    listed = spark.createDataFrame([("http://www.spam-farm.example.org",), ("bad.test/page/",), (None,)] + [(f"other{i}.test/",) for i in range(2000)], "url string")
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.url_filters(pages, listed=listed).collect())
    want = [
        (0, "a.example.com", "/en/7", "example.com/en/7", "allow"), (1, "example.com", "/en/6", "com/en/", "block"), (2, "x.net", "/de/1", "net/de/", "allow"),
        (3, "example.net", "/de/8/9", "example.net/de/8", "block"), (4, "spam-farm.example.org", "/fr/1", None, "block"), (5, "blog.spam-farm.example.org", "", None, "block"),
        (5, "blog.spam-farm.example.org", "", None, "block"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "notcom", "/en/", None, "allow"), (9, "org", "/es/", "org/es/", "block"),
        (10, "good.example.org", "", None, "allow"), (11, "", "", None, "allow"), (12, "bad.test", "/page/", None, "block"), (None, "com", "/en/", "com/en/", "block"),
    ]
    assert got == collections.Counter(want)
    assert url_filters.url_filters(pages.limit(0)).count() == 0
    assert url_filters.url_filters(pages, listed=listed.limit(0)).where("rule IS NULL AND verdict = 'block'").count() == 0


def test_url_filters_long_hosts_and_rows(spark):
    """Parent domains of hosts of any number of labels; rows are judged each, also after a shuffle and with one page_id."""
    deep = ".".join(["a"] * 150) + ".bad.test"
    pages = spark.createDataFrame([(k % 5, f"http://{deep if k % 4 == 0 else 'ok.test'}/p{k}") for k in range(400)] + [(None, None)], "page_id long, url string")
    out = url_filters.url_filters(pages.repartition(7), listed=spark.createDataFrame([("bad.test",)], "url string")).collect()
    assert len(out) == 401 and all((r.verdict == "block") == (r.host == deep) for r in out) and sum(r.verdict == "block" for r in out) == 100


def test_bloom_has_all_keys(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = url_filters.build_bloom(keys)
    hashes = lambda a, b: np.array([r[0] for r in spark.range(a, b).select(F.xxhash64(F.concat(F.lit("k"), "id"))).collect()], np.int64).view(np.uint64)
    assert bloom.may_have(hashes(0, 5000)).all() and bloom.may_have(hashes(5000, 15000)).mean() < 0.02


# 9 mixing


def test_mixing_deviates_less_than_a_block(spark, odd, none):
    data = [(i, "x" * (50 + i % 100), "abc"[0 if i % 3 else 1 + i % 2]) for i in range(6000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    weights = {"a": 5, "b": 2, "c": 1}
    out = mixing.mixing(df, weights, block_chars=500, period=64, slice_rows=300).collect()
    assert len(out) == 6000
    slots = {}
    for r in out:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    own, used = collections.Counter(), mixing.whole_weights(weights, 64)
    end = max(r.slot for r in out if r.on_target)
    for slot in range(end + 1):
        own[slots[slot][0]] += 1
        assert all(abs(own[s] - used[s] / 64 * (slot + 1)) < 1 for s in used)
    for s in used:
        assert sorted({r.block for r in out if r.source == s}) == list(range(max(r.block for r in out if r.source == s) + 1))
    assert mixing.mixing(none).count() == 0
    assert mixing.mixing(odd).count() == odd.count()


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 1.001, "b": 1, "c": 0.999}])
def test_mixing_keeps_true_weights(spark, weights):
    """Weights that do not divide the period, over many periods."""
    df = spark.createDataFrame([(i, "x" * 50, "abc"[i % 3]) for i in range(6000)], "doc_id long, text string, source string")
    out = mixing.mixing(df, weights, block_chars=100, period=64, slice_rows=300).collect()
    assert len(out) == 6000
    slots, own = {}, collections.Counter()
    for r in out:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    end = max(r.slot for r in out if r.on_target)
    assert end > 2900
    for slot in range(end + 1):
        own[slots[slot][0]] += 1
        assert all(abs(own[s] - w / 3 * (slot + 1)) < 1 for s, w in weights.items())


def test_mixing_order_hangs_on_rows_alone(spark):
    """Repeated and missing doc_ids, read in different orders, give the same mix; more sources than the period's slots do as well."""
    data = [(None if i % 3 == 0 else i % 7, "x" * (i % 90) + str(i), "ab"[i % 2]) for i in range(900)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    mixed = lambda d: sorted(map(repr, mixing.mixing(d, {"a": 2, "b": 1}, block_chars=300, slice_rows=50, with_columns=True).collect()))
    first = mixed(df.coalesce(1))
    assert first == mixed(df.repartition(7)) == mixed(df.orderBy(F.desc("text")).coalesce(1)) and len(first) == 900
    slots = [r.n for r in mixing.mixing(df, {"a": 2, "b": 1}, block_chars=300, slice_rows=50).groupBy("slot").agg(F.count("*").alias("n")).collect()]
    assert max(slots) < 60
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x" * 30).alias("text"), (F.col("id") % 100).cast("string").alias("source"))
    out = mixing.mixing(many, block_chars=10, period=64).collect()
    assert len(out) == 300 and len({(r.source, r.block) for r in out}) == len({r.slot for r in out})


# 10 language model


def brute_model(texts, train):
    tok = {i: words(lower(t)) + ["\n"] for i, t in texts.items()}
    c = collections.Counter(w for i in train for w in tok[i])
    n, v = sum(c.values()), len(c)
    two = collections.Counter(p for i in train for p in zip([" "] + tok[i][:-1], tok[i], strict=True))
    count = lambda xs: [sum(x == k for x in xs) for k in (1, 2, 3, 4)]
    d2, cont = language_model.discounts(count(two.values())), collections.Counter(w for _, w in two)
    d1 = language_model.discounts(count(cont.values()))
    after, spread = collections.Counter(), collections.Counter()
    for (a, _), k in two.items():
        after[a] += k
        spread[a] += d2[min(k, 3)]
    total, rest = sum(cont.values()), sum(d1[min(x, 3)] for x in cont.values())
    out = {}
    for i, t in tok.items():
        base = score = 0.0
        for a, w in zip([" "] + t[:-1], t, strict=True):
            base += math.log10((c[w] + 1) / (n + v + 1))
            low = (max(cont[w] - d1[min(cont[w], 3)], 0) + rest / (v + 1)) / total if total else 1 / (v + 1)
            score += math.log10((max(two[a, w] - d2[min(two[a, w], 3)], 0) + spread[a] * low) / after[a] if after[a] else low)
        out[i] = (len(t), sum(c[w] > 0 for w in t), n, base, score)
    return out


@pytest.mark.parametrize("keys, bits", [(1 << 20, 32), (700, 32), (50000, 13)])
def test_language_model(spark, docs, odd, none, keys, bits, monkeypatch):
    """Equal to brute force, also with words numbered beyond a page."""
    monkeypatch.setattr(language_model, "SHARD_KEYS", keys)
    monkeypatch.setattr(language_model, "BLOCK_BYTES", keys * 100)
    df = docs.select("doc_id", "text").unionByName(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select((F.col("doc_id") + 10000).alias("doc_id"), "text"))
    texts = text_of(df)
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    want = brute_model(texts, train)
    got = language_model.language_model(df, toxicity.fold("doc_id", 7) != 2, bits).collect()
    assert len(got) == len(want)
    for r in got:
        assert np.allclose(tuple(r)[1:], want[r.doc_id], rtol=1e-7), r
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 7 == 2 and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_edges(spark, odd, none):
    assert language_model.language_model(none, F.lit(True)).count() == 0
    out = language_model.language_model(odd, F.lit(True)).collect()
    assert len(out) == odd.count() and all(r.score <= 0 for r in out) and sum(r.doc_id is None for r in out) == 1
    blank = language_model.language_model(odd, F.lit(False)).collect()
    assert all(r.n_known == r.train_tokens == 0 and r.score == 0 for r in blank)


def test_language_model_disk(spark, monkeypatch):
    """Shuffle files go with the step that made them, and what is written stays below three quarters of the text's bytes."""
    files = lambda: {x.rsplit("/", 1)[-1] for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(",") if x.endswith(".data")}
    old, write, sizes = files(), language_model.written, {}

    def watched(df, name, **more):
        out = write(df, name, **more)
        sizes[name] = sum(os.path.getsize(urlparse(f).path) for f in out.inputFiles())
        end = time.time() + 10
        while files() - old and time.time() < end:
            time.sleep(0.1)
        assert not files() - old, name
        return out

    monkeypatch.setattr(language_model, "written", watched)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert language_model.language_model(docs, toxicity.fold("doc_id", 7) != 2).count() == docs.count()
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert sum(sizes.values()) < 0.75 * total, sizes
