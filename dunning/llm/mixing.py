"""Mixing sources to target weights by Poisson replication.

A source s with share w_s of the target and n_s of the N documents has the
repetition rate w_s N / n_s. Each document draws its number of copies from the
Poisson distribution of that rate by inverting it at a uniform number made from
a seeded MD5 of its id, so a rerun (or a recomputed partition) draws the same
number; a source's expected share of the output is exactly w_s. The copies are
exploded and put in a global order by a seeded hash of (id, copy).

Rates above ``STEP`` are drawn as sums of independent draws of at most ``STEP``,
so that exp(-rate) never underflows.

Scale: one aggregate of one row per source and task, a join of the documents
with their source's rate (broadcast if the sources, which are counted first, are
at most ``FEW_SOURCES``; else an equi join that adaptive execution splits), and
one range exchange for the shuffled order. A hot source is only read: no step
groups its rows.

Defined results: a null source is a source of its own; a null id draws as the
empty string; repeated rows draw the same number; sources without a target
weight get weight 0 and vanish; targets without documents are ignored and the
others scaled up; negative or all-zero weights are an error; an empty table
gives an empty result; other columns are carried along unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 16.0
FEW_SOURCES = 10_000  # up to this many sources the table of rates (700 bytes each) is broadcast
KINDS = 80  # counts above this have probability < 1e-30 at rate STEP


def uniform(seed: int, *parts: Column) -> Column:
    """Uniform number in [0, 1) from the first 13 hex digits of an MD5 (52 bits)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def distribution(rate: Column) -> Column:
    """Array of the Poisson distribution function at 0, 1, ..., KINDS (rate at most STEP)."""
    first = F.exp(-rate)
    state = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k.cast("double")
        return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), F.array_append(s["all"], s["sum"] + p).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(KINDS)), state, step, lambda s: s["all"])


def poisson(function: Column, at: Column) -> Column:
    """Smallest k whose distribution function exceeds ``at``."""
    return F.size(F.filter(function, lambda f: f <= at))


def source_rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, power: float) -> DataFrame:
    """(source, rate). ``weights``: target shares by source; without them a source's
    target is its share to the given power (1: as is, 0: all sources alike)."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.pow("n", F.lit(power)))
    else:
        if any(w < 0 for w in weights.values()) or not any(weights.values()):
            raise ValueError("target weights must not be negative and not all zero")
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])
        weighted = counts.withColumn("w", F.coalesce(F.element_at(table, F.col("source")), F.lit(0.0)))
    sources, all_n, all_w = weighted.agg(F.count(F.lit(1)), F.sum("n"), F.sum("w")).first()  # three numbers
    if sources <= FEW_SOURCES:
        weighted = F.broadcast(weighted)
    if not all_w:
        return weighted.select("source", F.lit(0.0).alias("rate"))
    return weighted.select("source", (F.col("w") / F.lit(all_w) * F.lit(all_n) / F.col("n")).alias("rate"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None,
        power: float = 0.5, seed: int = 7, names: tuple[str, str, str] = ("n_copies", "copy_no", "shuffle_key"),
        text_col: str = "text") -> DataFrame:
    """The input's columns, each document as often as drawn, plus (unless the input has columns of
    these ``names``, which then stay) the number of copies, the copy's number from 1, and the key
    of the global order; sorted by that key. A document without an id draws by a digest of its
    text, where there is such a column."""
    own = "_mix"
    while any(c.startswith(own) for c in docs.columns):
        own = "_" + own
    rates = source_rates(docs, source_col, weights, power)
    steps = F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP).cast("int"))  # once per source
    rates = rates.select(F.col("source").alias(f"{own}_source"), steps.alias(f"{own}_steps"), distribution(F.col("rate") / steps).alias(f"{own}_cdf"))
    joined = docs.join(rates, docs[source_col].eqNullSafe(rates[f"{own}_source"]))
    name = F.col(id_col).cast("string")
    if text_col in docs.columns:
        name = F.coalesce(name, F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    uniforms = F.transform(F.sequence(F.lit(1), F.col(f"{own}_steps")), lambda k: uniform(seed, F.col(f"{own}_name"), k))
    draw = F.aggregate(uniforms, F.lit(0), lambda total, u: total + poisson(F.col(f"{own}_cdf"), u))
    n, copy, key = (f"{own}_{x}" for x in ("n", "copy", "key"))
    drawn = joined.withColumn(f"{own}_name", name).withColumn(n, draw.cast("long")).where(F.col(n) > 0)
    copies = drawn.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    keyed = copies.withColumn(key, F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.coalesce(f"{own}_name", F.lit("")),
                                                     F.col(copy).cast("string"))))
    added = [F.col(c).alias(name) for c, name in zip((n, copy, key), names) if name not in docs.columns]
    return keyed.sort(key, id_col).select(*[docs[c] for c in docs.columns], *added)


ORACLE = """
WITH n AS (SELECT source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
s AS (SELECT source, rate, CAST(greatest(1, ceil(rate / 16.0)) AS BIGINT) AS steps FROM r),
cdf AS (SELECT source, k, sum(CASE WHEN k = 0 THEN exp(-rate / steps)
          ELSE exp(-rate / steps + k * ln(rate / steps) - lgamma(k + 1)) END) OVER (PARTITION BY source ORDER BY k) AS f
        FROM s, (SELECT unnest(range(0, 81)) AS k)),
u AS (SELECT doc_id, source, text, step, CAST(('0x' || substr(md5('7|' || doc_id || '|' || step), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
      FROM (SELECT doc_id, d.source, d.text, unnest(range(1, steps + 1)) AS step FROM documents d JOIN s ON d.source IS NOT DISTINCT FROM s.source)),
k AS (SELECT doc_id, source, text, step, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM u.source AND cdf.f <= u.u) AS k FROM u),
c AS (SELECT doc_id, source, text, CAST(sum(k) AS BIGINT) AS n_copies FROM k GROUP BY doc_id, source, text)
SELECT doc_id, source, n_copies, copy_no, md5('order7|' || doc_id || '|' || copy_no) AS shuffle_key, sha256(text) AS text_sha256
FROM (SELECT doc_id, source, text, n_copies, unnest(range(1, n_copies + 1)) AS copy_no FROM c WHERE n_copies > 0)
"""
