"""One query per operator over its whole table, and DuckDB SQL where SQL can say it.

Rows without doc_id are in no held-out fold: held_out is false for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_model, license_scan, mixing, near_duplicates, quality_rules, suffix_dedup, token_counts, toxicity, url_filters

#: Target weights of the mix; sources that are not named weigh 1.
MIX = {"src0": 4.0, "src1": 3.0, "src2": 2.0, "src3": 2.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(toxicity.fold("doc_id", 5) == 0, F.lit(False))
    field = toxicity.fit_field(docs, labels.where(~held_out))
    scored = toxicity.toxicity(docs, field)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filters(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing(table(spark, sf_dir, "documents"), MIX)


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(toxicity.fold("doc_id", 7) == 2, F.lit(False))
    scored = language_model.language_model(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_suffix_dedup, op3_near_duplicates, op4_toxicity, op5_token_counts, op6_decontamination, op7_license_scan, op8_url_filters, op9_mixing, op10_language_model, pipeline)
}


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM pos),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words
    OR n_dup_lines * 2 > length(text) - length(replace(text, chr(10), '')) + 1
    OR word_chars < 2 * n_words OR word_chars > 14 * n_words
    OR (length(text) - length(replace(text, '!', ''))) * 5 > n_words
    OR length(regexp_replace(text, '[^A-Z]+', '', 'g')) * 3 > word_chars
    OR len(regexp_extract_all(text, '[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*')) * 10 < 7 * n_words) AS kept
FROM f"""


def _values(rows) -> str:
    quote = lambda x: "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quote(x) for x in r) + ")" for r in rows)


OP6 = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS k
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM low, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
occ AS (SELECT doc_id, i, m, item_id FROM places AS p JOIN win USING (m, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM low LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""


def _canonical_sql(x: str) -> str:
    out = rf"' ' || trim(regexp_replace(regexp_replace(lower({x}), '(?m)^\s*(copyright|©|\(c\))[^\n]*$', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
    for old, new in license_scan.SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out})"


OP7 = rf"""
WITH known AS (SELECT DISTINCT license_id, {_canonical_sql("text")} AS c FROM (VALUES {_values(license_scan.KNOWN)}) t(license_id, text)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT r, {_canonical_sql("x")} AS c, false AS whole FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '(?i)licen[cs]e')
      UNION ALL SELECT r, {_canonical_sql("text")}, true FROM d WHERE regexp_matches(text, '(?i)licen[cs]e|permission')),
f AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids, count(DISTINCT license_id) AS n, bool_or(whole) AS whole FROM u JOIN known USING (c) GROUP BY r)
SELECT doc_id, coalesce(ids, '') AS licenses, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(whole, false) AS whole_text
FROM d LEFT JOIN f USING (r)"""


def _op8() -> str:
    rules = "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{v} {r}'"
        for v, r in sorted(url_filters.RULES, key=lambda x: -len(x[1]))
        for h, _, p in [r.partition("/")]
    ) + " END"
    listed = ", ".join(f"'{x[:-1]}'" for x in url_filters.LISTED)
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS x FROM pages),
p AS (SELECT page_id, translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT *, {rules} AS fit, regexp_replace(host, '^www\.', '') AS bare FROM p)
SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule,
  CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 1)
       WHEN len(list_filter([{listed}], lambda l: bare = l OR ends_with(bare, '.' || l))) > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM f"""


ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1,
    "op6_decontamination": OP6,
    "op7_license_scan": OP7,
    "op8_url_filters": _op8(),
}
