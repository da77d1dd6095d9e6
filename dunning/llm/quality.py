"""Quality rules as a short-circuit cascade.

Measures are columns of built-in functions. A rule is a condition on them that
rejects a text. What the cascade does to the rows that reach it is estimated on a
bounded sample of rows that pass the base rule: a rule's cost is the time of many
evaluations inside one job less that of a rule that does nothing, its selectivity the
share of rows it rejects among those that the rules before it leave. The cascade
takes the rule of most rejections per cost first, counts again on the rows that
are left, and so on, so that a text stops at the first rule that rejects it. The
order changes cost (and ``rejected_by``) only: a text is kept if no rule rejects it.

Repeated 5-word windows are found without leaving the row: window hashes are
compared as a set first; only texts with a repeat sort (hash, position) pairs,
take the positions whose hash has an equal neighbour, and add up the words
that the windows cover.

Scale: one map over the scan, no shuffle, no Python; memory per text in
proportion to its words. The sample has about ``sample_rows`` rows at any size,
however many rows are equal or have no id.

Defined results: a null or empty text has no words and fails the base rule; a
null id is passed through; repeated rows get equal results; an empty table
gives an empty result; other columns are ignored. Windows are compared by
64-bit hashes within one text.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x09-\x0D\x20]+"
WINDOW = 5
SAMPLE_ROWS = 2_000
SAMPLE_SEED = 17
REPEATS = 6           # evaluations of a rule on each row of the sample, when its time is taken
LEAST_SECONDS = 1e-3  # what a clock can tell apart from nothing

#: Texts that the cascade does not see.
BASE = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"

#: Rules that reject a text, as SQL conditions on the measures and on ``text``, ``words``, ``lines``.
RULES = {
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > size(lines)",
    "capitals": r"n_words >= 20 and 2 * char_length(regexp_replace(text, '[^\\p{Lu}]+', '')) > char_length(regexp_replace(text, '[^\\p{L}]+', ''))",
    "stutter": "5 * size(filter(words, (w, i) -> i > 0 and w = words[i - 1])) > n_words",
    "letterless_words": r"2 * size(filter(words, w -> not rlike(w, '\\p{L}'))) > n_words",
}


def repeat_words(words: str = "words") -> Column:
    """Words inside windows that occur twice or more in the text."""
    n = F.size(words)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))
    return hashes


def measures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, words, lines and the five measures."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x09-\x0D\x20]")))
    rows = rows.withColumn("hashes", repeat_words())
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    rows = rows.withColumn("repeats", F.expr("hashes is not null and size(array_distinct(hashes)) < size(hashes)"))
    sort = "sort_array(transform(hashes, (h, i) -> struct(h as h, i as i)))"
    rows = rows.withColumn("sorted", F.expr(f"case when repeats then {sort} end"))
    again = "filter(sorted, (x, k) -> (k > 0 and x.h = sorted[k - 1].h) or (k < size(sorted) - 1 and x.h = sorted[k + 1].h))"
    rows = rows.withColumn("starts", F.expr(f"case when repeats then sort_array(transform({again}, x -> x.i)) end"))
    covered = (f"aggregate(starts, struct(0 as n, -{WINDOW} as last), "
               f"(s, i) -> struct(s.n + least({WINDOW}, i - s.last) as n, i as last), s -> s.n)")
    return rows.select(
        "id", "text", "words", "lines", "n_words",
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"case when repeats then {covered} else 0 end").cast("long").alias("n_repeat_words"))


def seconds(rows: DataFrame, rule: str) -> float:
    """Time of ``REPEATS`` evaluations of a rule on every row, the better of two runs."""
    often = rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    times = []
    for _ in range(2):
        began = time.perf_counter()
        often.agg(F.count_if(F.expr(rule))).collect()
        times.append(time.perf_counter() - began)
    return min(times)


def greedy_order(verdicts: list[tuple[frozenset[str], int]], costs: dict[str, float]) -> list[str]:
    """Rules by rejections per cost, each counted on the rows that the rules before it leave;
    ``verdicts`` are sets of rejecting rules with their numbers of rows. Ties go to the cheaper rule, then by name."""
    order: list[str] = []
    while len(order) < len(costs):
        left = [(rejecting, n) for rejecting, n in verdicts if not rejecting.intersection(order)]
        order.append(min((name for name in costs if name not in order), key=lambda name: (
            -sum(n for rejecting, n in left if name in rejecting) / costs[name], costs[name], name)))
    return order


def order_rules(docs: DataFrame, id_col: str, text_col: str, rules: dict[str, str], sample_rows: int) -> list[str]:
    """Rule names in the order of the cascade, from a sample of about ``sample_rows`` rows."""
    total = docs.count()
    if not total:
        return list(rules)
    sample = docs.sample(fraction=min(1.0, sample_rows / total), seed=SAMPLE_SEED)
    held = measures(sample, id_col, text_col).persist()
    reached = held.where(f"not ({BASE})")  # above the kept rows: below them the measures would be computed once per use
    hits = [F.coalesce(F.expr(rule), F.lit(False)).alias(name) for name, rule in rules.items()]
    counted = reached.groupBy(*hits).count().collect()  # one row per set of rejecting rules: at most the sample
    verdicts = [(frozenset(name for name in rules if row[name]), row["count"]) for row in counted]
    nothing = seconds(reached, "n_words < 0")
    costs = {name: max(LEAST_SECONDS, seconds(reached, rule) - nothing) for name, rule in rules.items()}
    held.unpersist()
    return greedy_order(verdicts, costs)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, str] | None = None,
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: id, the five measures, ``base_failed`` (n_words < 10, or more than
    a fifth of the words in repeated windows), ``rejected_by`` (first rule of the cascade that
    rejects it, null if none or if the base rule failed) and ``kept``."""
    rules = RULES if rules is None else rules
    cascade = F.when(F.col("base_failed"), F.lit(None).cast("string"))
    for name in order_rules(docs, id_col, text_col, rules, sample_rows):
        cascade = cascade.when(F.expr(rules[name]), F.lit(name))
    rows = measures(docs, id_col, text_col)
    rows = rows.withColumn("base_failed", F.expr(BASE))
    return (rows.withColumn("rejected_by", cascade)
            .select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "rejected_by", (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept")))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x09-\x0D\x20]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')) AS lines FROM t),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id),
m AS (SELECT w.doc_id, text, words, lines, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words)
  AND NOT 10 * n_symbols > n_words
  AND NOT 2 * n_dup_lines > len(lines)
  AND NOT (n_words >= 20 AND 2 * length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) > length(regexp_replace(text, '[^\p{L}]+', '', 'g')))
  AND NOT 5 * len(list_filter(words, lambda w, i: i > 1 AND w = words[i - 1])) > n_words
  AND NOT 2 * len(list_filter(words, lambda w: NOT regexp_matches(w, '\p{L}'))) > n_words AS kept
FROM b
"""
