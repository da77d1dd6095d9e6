"""Exact top-k inner-product search with a vector-approximation file.

Every component x becomes the integer floor(scale * x). Equal vectors are
collapsed to their k + 1 smallest ids (more can't reach any result: ties go to
the smaller id and a query only excludes itself).

Phase 1 (scan). Each dimension's range is cut into 2^bits cells; a vector's
approximation is its cell numbers, one byte a dimension. Blocks of queries meet
blocks of approximations: cell borders bound every score from below and above
by two matrix products. In a block, a vector whose upper bound is below the k-th
largest lower bound can't be a result; what is left is emitted.
Phase 2 (refine). Over all blocks, the k-th largest lower bound of a query
prunes again. Exact vectors are joined to the rest and read in order of their
bounds, best first, until the k-th exact score is at least the next bound.

Scale: the queries are a stated set (ids divisible by ``every``); blocks of them
are copied to each block of vectors, never the other way round beyond one copy
per query block. A block holds ``BLOCK`` vectors or ``QUERIES`` queries whatever
the input, so memory is bounded; equal vectors never crowd a block. The cell
borders are two numbers a dimension.

Scores are exact: components are integers and products of vectors with small
components are summed in doubles below 2^53; others in Python integers.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, neither do rows with a null id; vectors of another
length than the query's are no candidates; an id that occurs with several
vectors is a candidate once for each, and as a query stands for its smallest
vector; repeated rows count once; scores beyond 64 bits saturate; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 4096
QUERIES = 1024
BITS = 6
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.array(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v, dim): distinct rows with usable vectors, components floor(scale * x) as doubles."""
    x = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = (x.isNotNull() & (F.size(x) > 0) & F.col("id").isNotNull()
              & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    # dividing first would round: the product of a double by a power of two is exact
    return rows.where(usable).select("id", F.transform(x, lambda c: F.floor(c * F.lit(float(scale)).cast("double")).cast("double")).alias("v"),
                                     F.size(x).alias("dim"))


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of q . x for low <= x <= high (rows of q by rows of low)."""
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    lower, upper = plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T
    slack = top * 1e-9  # sums that no double holds exactly
    return lower - slack, upper + slack


def _scores(q: np.ndarray, x: np.ndarray) -> list[int]:
    """Exact inner products of one integer query with rows of x, saturated at 64 bits."""
    if len(x) and float(np.abs(x).max()) * float(np.abs(q).max()) * len(q) < EXACT:
        return (x @ q).astype(np.int64).tolist()
    ints = [int(c) for c in q]
    return [max(-LONG - 1, min(LONG, sum(a * int(b) for a, b in zip(ints, row)))) for row in x]


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5,
           scale: int = 256, bits: int = BITS) -> DataFrame:
    """Rows (query_id, rank from 1, id, score): the k best rows of every id divisible by ``every``."""
    rows = integer_vectors(vectors, id_col, vector_col, scale).distinct()
    kept = (rows.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
            .select("id", "v", "dim"))
    asked = (rows.where(F.col("id") % every == 0)
             .withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("v"))).where("n = 1").select("id", "v", "dim"))
    count = vectors.count()
    n_blocks, n_groups = max(1, -(-count // BLOCK)), max(1, -(-count // (every * QUERIES)))

    # cell borders: smallest and largest component of each dimension
    each = rows.select("dim", F.posexplode("v").alias("j", "x")).groupBy("dim", "j").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    ranges = (each.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("j", "lo", "hi"))).alias("r"))
              .select("dim", F.expr("transform(r, x -> x.lo)").alias("lo"), F.expr("transform(r, x -> x.hi)").alias("hi")))
    cells = 1 << bits
    code = F.expr(f"transform(v, (x, j) -> cast(case when hi[j] > lo[j] then least({cells - 1}, floor((x - lo[j]) / (hi[j] - lo[j]) * {cells})) "
                  "else 0 end as smallint))")
    coded = (kept.join(ranges, "dim").withColumn("code", code).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)))
             .select(*(F.col(c).alias(c) for c in ("id", "dim", "code", "block", "lo", "hi"))))
    groups = F.pmod(F.xxhash64("id"), F.lit(n_groups)).alias("grp")
    left = coded.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))))
    right = (asked.select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("dim").alias("dim"), groups)
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))))
    keys = ["dim", "grp", "block"]

    def scan(data: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if data.num_rows and queries.num_rows:
            dim = data.column("dim")[0].as_py()
            q, ids = _matrix(queries.column("q"), dim), queries.column("query_id").to_numpy()
            codes, vec = _matrix(data.column("code"), dim), data.column("id").to_numpy()
            lo, hi = (np.array(data.column(c)[0].as_py()) for c in ("lo", "hi"))
            width = (hi - lo) / cells
            low, high = lo + codes * width - width * 1e-6, lo + (codes + 1) * width + width * 1e-6
            top = max(1.0, float(np.abs(q).max()) * float(max(np.abs(lo).max(), np.abs(hi).max())) * dim)
            for at in range(0, len(q), 128):
                lower, upper = _bounds(q[at:at + 128], low, high, top)
                own = vec[None, :] == ids[at:at + 128, None]
                lower[own] = upper[own] = -np.inf
                if lower.shape[1] > k:
                    least = np.partition(lower, -k, axis=1)[:, -k]
                else:
                    least = np.full(len(lower), -np.inf)
                i, j = np.nonzero((upper >= least[:, None]) & ~own)
                out.append((ids[at + i], vec[j], lower[i, j], upper[i, j]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0), np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], names=["query_id", "id", "lower", "upper"])

    bounded = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "query_id long, id long, lower double, upper double")
    # the k-th largest lower bound of each query, over all blocks
    best = W.partitionBy("query_id").orderBy(F.desc("lower"))
    least = (bounded.select("query_id", "lower").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
             .groupBy("query_id").agg(F.min("lower").alias("least"), F.count(F.lit(1)).alias("n"))
             .select("query_id", F.when(F.col("n") == k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("least")))
    open_pairs = bounded.join(least, "query_id").where("upper >= least").select("query_id", "id", "upper").distinct()
    exact = (open_pairs.join(kept.select("id", "v", "dim"), "id")
             .join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("dim").alias("q_dim")), "query_id")
             .where("dim = q_dim").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks))))

    def refine(table: pa.Table) -> pa.Table:
        """Read exact vectors in bound order until the k-th score is certain."""
        dim, query = table.column("dim")[0].as_py(), table.column("query_id")[0].as_py()
        q = np.array(table.column("q")[0].as_py())
        ids, upper, x = table.column("id").to_numpy(), table.column("upper").to_numpy(), _matrix(table.column("v"), dim)
        order = np.argsort(-upper, kind="stable")
        found: list[tuple[int, int]] = []
        at, step = 0, max(8, 2 * k)
        while at < len(order):
            if len(found) >= k and -found[k - 1][0] > upper[order[at]]:
                break
            part = order[at:at + step]
            found = sorted(found + [(-s, int(i)) for s, i in zip(_scores(q, x[part]), ids[part])])[:k]
            at += step
        return pa.table([pa.array([query] * len(found), pa.int64()), pa.array([i for _, i in found], pa.int64()),
                         pa.array([-s for s, _ in found], pa.int64())], names=["query_id", "id", "score"])

    scored = exact.groupBy("query_id", "block").applyInArrow(refine, "query_id long, id long, score long")
    final = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (scored.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
