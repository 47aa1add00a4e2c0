"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every document gets the base counts. The rules behind them are tried one after another in a CASE, and
the order is measured: each rule's cost, and the rows that it rejects of those that the rules before it leave, are estimated on a bounded
sample, and rules that reject most per unit of cost come first. The order changes the work, never the verdict.

Edge cases: a null or empty text has no words and fails the base; repeated rows are judged alike;
an empty table gives an empty result; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import re
import time
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 2000
REPEAT = 8  # how often each sampled row is judged where a rule is timed


class Rule(NamedTuple):
    name: str
    rejects: str  # SQL over text, words and the base counts


#: Tried only where the base holds, so n_words is 50 or more.
RULES = [
    Rule("symbols", "n_symbols * 10 > n_words"),
    Rule("duplicate_lines", r"n_dup_lines * 2 > (length(text) - length(replace(text, '\n', '')) + 1)"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("exclamations", "(length(text) - length(replace(text, '!', ''))) * 5 > n_words"),
    Rule("shouting", "length(regexp_replace(text, '[^A-Z]+', '')) * 3 > word_chars"),
    Rule("few_letters", r"regexp_count(text, '[^ \\t-\\r]*\\p{L}[^ \\t-\\r]*') * 10 < 7 * n_words"),
]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: All base counts of a text as one struct. A one-element transform binds a value that is used more than once
#: (so words are split once, also where the optimiser copies the expression into a filter). Windows are
#: compared by 64-bit hash; sorting (hash, start) puts equal windows side by side, and each start covers up
#: to the next one, three words at most.
_BASE = r"""
transform(array(IF(text rlike '[^ \\t-\\r]',
                   split(trim(BOTH ' \t\n\u000b\u000c\r' FROM text), '[ \\t-\\r]+', -1), array())), words ->
transform(array(IF(size(words) < 4, array(), transform(sequence(0, size(words) - 3),
                   i -> xxhash64(words[i], words[i + 1], words[i + 2])))), windows ->
  named_struct(
    'n_words', CAST(size(words) AS BIGINT),
    'word_chars', CAST(length(array_join(words, '')) AS BIGINT),
    'n_symbols', CAST(size(split(text, '[#*$%&|<>]', -1)) - 1 AS BIGINT),
    'n_dup_lines', CAST(transform(array(filter(split(text, '\n', -1), x -> x rlike '[^ \\t-\\r]')),
                   x -> size(x) - size(array_distinct(x)))[0] AS BIGINT),
    'n_repeat_words', CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L ELSE
      transform(array(sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i)))), z ->
        transform(array(sort_array(transform(filter(
            transform(z, (x, j) -> named_struct('i', x.i, 'twice',
                (j > 0 AND z[greatest(j - 1, 0)].h = x.h)
                OR (j < size(z) - 1 AND z[least(j + 1, size(z) - 1)].h = x.h))),
            x -> x.twice), x -> x.i))), q ->
          aggregate(transform(q, (x, j) -> IF(j = size(q) - 1, 3, least(3, q[least(j + 1, size(q) - 1)] - x))),
                    0L, (a, x) -> a + x))[0])[0] END))[0])[0]
"""


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text, the base counts and base_failed of every row."""
    df = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = df.withColumn("base", F.expr(_BASE)).select("doc_id", "text", "base.*")
    return df.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def cascade(outcomes: list[tuple[tuple[bool, ...], int]], costs: list[float]) -> list[int]:
    """The rules' places in the order of most rejections per cost, each counted over what the rules before it leave.

    outcomes: which rules reject, and how many rows have that outcome.
    """
    left, order = list(outcomes), []
    while len(order) < len(costs):
        hits = [sum(n for rejects, n in left if rejects[k]) for k in range(len(costs))]
        best = min((k for k in range(len(costs)) if k not in order), key=lambda k: (-hits[k] / costs[k], costs[k], k))
        order.append(best)
        left = [(rejects, n) for rejects, n in left if not rejects[best]]
    return order


def measured_order(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Rule]:
    """The rules as a cascade, by what a sample of at most about sample_rows rows shows.

    A rule's cost is the time that it adds to a job over the sample, each row REPEAT times, so that the job's own start weighs little; the
    lesser of two runs counts. Outcomes are counted together: at most one row for each combination comes to the driver.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = base_counts(docs if share == 1 else docs.sample(share, seed)).persist()
    try:
        hit = {f"_r{k}": F.coalesce(F.expr(rule.rejects), F.lit(False)) for k, rule in enumerate(rules)}
        counted = sample.where("NOT base_failed").select(*[c.alias(name) for name, c in hit.items()]).groupBy(*hit).agg(F.count("*").alias("n"))
        outcomes = [(tuple(r)[:-1], r["n"]) for r in counted.collect()]
        many = sample.where("NOT base_failed").withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEAT))))

        def seconds(rejects: str) -> float:
            took = []
            for _ in range(2):
                began = time.perf_counter()
                many.agg(F.count_if(F.expr(rejects))).collect()
                took.append(time.perf_counter() - began)
            return min(took)

        idle = seconds("_again < 0")
        costs = [max(seconds(rule.rejects) - idle, 1e-3) for rule in rules]
    finally:
        sample.unpersist()
    return [rules[k] for k in cascade(outcomes, costs)]


def good_documents(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that the cascade keeps, with all their columns."""
    order = measured_order(docs, RULES if rules is None else rules, sample_rows)
    tests = ["n_words < 50", "100 * n_repeat_words > 50 * n_words", *(r.rejects for r in order)]
    cases = " ".join(f"WHEN {re.sub(rf'\b({"|".join(BASE)})\b', r'b.\1', x)} THEN false" for x in tests)
    # One expression of text alone: other columns may have any names.
    kept = f"transform(array(coalesce(text, '')), text -> transform(array({_BASE}), b -> CASE {cases} ELSE true END)[0])[0]"
    return docs.where(F.expr(kept))


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for each row of docs."""
    counted = base_counts(docs)
    order = measured_order(docs, RULES if rules is None else rules, sample_rows)
    kept = F.when(F.col("base_failed"), False)
    for rule in order:
        kept = kept.when(F.expr(rule.rejects), False)
    return counted.select("doc_id", *BASE, "base_failed", kept.otherwise(True).alias("kept"))
