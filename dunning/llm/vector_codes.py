"""Product codes of integer vectors, trained and assigned by exact matrix products.

Components become floor(scale * x). A vector is cut into equal parts; every part
position has a codebook, trained by rounds of nearest entry and floored mean.

Distances are |x|^2 - 2 x.c + |c|^2, where x.c is a limb-split product: integers are
cut into limbs of ``LIMB`` bits (the top one signed), pairs of limbs are multiplied by
float64 BLAS, whose sums stay below 2^53 for parts of up to 2^(53 - 2 LIMB)
components, and the products are shifted and added as 64-bit integers; the first
smallest distance wins. Vectors whose distances might leave 64 bits are compared in
Python integers.

Scale: each round is one map over the vectors that emits entry counts and
componentwise sums of its task, and one sum over tasks; only codebooks (entries x
components numbers) pass through the driver. Nothing is shuffled by vector but
the label totals, which are pre-aggregated; the coded rows meet them in an equi join.
Every round starts from the table again, so a lost executor costs one task's work.

Defined results: vectors that are null, empty or hold null or non-finite components
take no part, neither do vectors that can't be cut into equal parts; vectors of
different lengths have codebooks of their own; rows with a null id are coded and come
last among the first entries; repeated rows count each; ids that tie are ordered
by their components; fewer rows than entries make a smaller codebook; components
beyond 2^62 and errors beyond 64 bits saturate; rows of a null label share one
total; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMB = 12
TOP = 1 << 62
LONG = (1 << 63) - 1
ROWS = 2048  # rows compared at a time


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Limbs of ``LIMB`` bits as doubles, lowest first; the last one carries the sign."""
    out, left = [], x
    while True:
        if not left.size or (-(1 << LIMB) <= left.min() and left.max() < 1 << LIMB):
            return [*out, left.astype(np.float64)]
        out.append((left & ((1 << LIMB) - 1)).astype(np.float64))
        left = left >> LIMB


def products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products (rows of x by rows of c) of 64-bit integers, if they fit 64 bits."""
    total = np.zeros((len(x), len(c)), dtype=np.int64)
    right = [limb.T for limb in _limbs(c)]
    for i, a in enumerate(_limbs(x)):
        for j, b in enumerate(right):
            if LIMB * (i + j) < 64:
                total += (a @ b).astype(np.int64) << (LIMB * (i + j))
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the first nearest row of ``book`` for every row of ``x``."""
    size = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if x.shape[1] * (2 * size) ** 2 > LONG:
        x, book = x.astype(object), book.astype(object)
        far = np.array([[sum(int(d) ** 2 for d in a - b) for b in book] for a in x], dtype=object)
    else:
        far = (x * x).sum(1)[:, None] - 2 * products(x, book) + (book * book).sum(1)[None, :]
    index = np.array([int(np.argmin(row)) for row in far], dtype=np.int64) if far.dtype == object else far.argmin(1)
    return index, far[np.arange(len(far)), index]


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> DataFrame:
    """(id, v, label): rows whose vector takes part, components as doubles."""
    x = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    return rows.where(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0)
                      & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))


def _integers(column: pa.Array, scale: int):
    """(rows, integer matrix) for each vector length in a batch, at most ``ROWS`` rows at a time."""
    lengths, values = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for dim in np.unique(lengths):
        rows = np.nonzero(lengths == dim)[0]
        for at in range(0, len(rows), ROWS):
            part = rows[at:at + ROWS]
            x = values[starts[part][:, None] + np.arange(dim)[None, :]]
            with np.errstate(over="ignore"):
                yield part, np.clip(np.floor(x * scale), -float(TOP), float(TOP)).astype(np.int64)


def _first_rows(rows: DataFrame, entries: int, scale: int) -> dict[int, np.ndarray]:
    """The integer vectors of the ``entries`` smallest ids of each length; a task hands on no more than that."""

    def first(batches):
        best: dict[int, list] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for part, x in _integers(batch.column(1), scale):
                keys = [(ids[i] is None, ids[i] or 0) for i in part.tolist()]
                last = sorted(keys)[min(entries, len(keys)) - 1]
                held = best.get(x.shape[1], []) + [(key, x[k].tolist()) for k, key in enumerate(keys) if key <= last]
                best[x.shape[1]] = sorted(held)[:entries]
        for dim, held in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(held), pa.int32()), pa.array([n for (n, _), _ in held], pa.bool_()),
                                              pa.array([i for (_, i), _ in held], pa.int64()),
                                              pa.array([v for _, v in held], pa.list_(pa.int64()))], names=["dim", "none", "id", "v"])

    found = rows.select(F.col("id").cast("long"), "v").mapInArrow(first, "dim int, none boolean, id long, v array<long>")
    per = found.groupBy("dim").agg(F.slice(F.sort_array(F.collect_list(F.struct("none", "id", "v"))), 1, entries).alias("first"))
    return {r["dim"]: np.array([x["v"] for x in r["first"]], dtype=np.int64) for r in per.collect()}


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def _sums(x: np.ndarray, index: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and componentwise sums (Python integers) of each entry."""
    wide = x if int(np.abs(x).max(initial=0)) * max(1, len(x)) < TOP else x.astype(object)
    sums = np.array([[0] * x.shape[1]] * entries, dtype=object)
    for e in np.unique(index):
        sums[e] = wide[index == e].sum(0).astype(object)
    return np.bincount(index, minlength=entries), sums


def train(rows: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> dict[int, list[np.ndarray]]:
    """Codebooks (one integer matrix per part) of every vector length."""
    books = {dim: _cut(first, parts) for dim, first in _first_rows(rows, entries, scale).items()}

    for _ in range(rounds if books else 0):

        def gather(batches, books=books):
            counts = {dim: [np.zeros(len(b), dtype=np.int64) for b in book] for dim, book in books.items()}
            sums = {dim: [np.array([[0] * b.shape[1]] * len(b), dtype=object) for b in book] for dim, book in books.items()}
            for batch in batches:
                for _, x in _integers(batch.column(0), scale):
                    dim = x.shape[1]
                    for p, part in enumerate(_cut(x, parts)):
                        n, s = _sums(part, nearest(part, books[dim][p])[0], len(books[dim][p]))
                        counts[dim][p] += n
                        sums[dim][p] += s
            got = [(dim, p, e, int(n), [Decimal(int(v)) for v in sums[dim][p][e]])
                   for dim in books for p in range(parts) for e, n in enumerate(counts[dim][p]) if n]
            columns = list(zip(*got)) or [()] * 5
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["dim", "part", "entry", "n", "s"])

        partial = rows.select("v").mapInArrow(gather, "dim int, part int, entry int, n long, s array<decimal(38,0)>")
        sums = (partial.select("dim", "part", "entry", "n", F.posexplode("s").alias("pos", "x"))
                .groupBy("dim", "part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
        new = {dim: [b.copy() for b in book] for dim, book in books.items()}
        for r in sums.collect():
            new[r["dim"]][r["part"]][r["entry"], r["pos"]] = int(r["x"]) // r["n"]
        books = new
    return books


def digest(book: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in book for x in b.reshape(-1)).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8,
             entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """One row per vector that takes part: id, ``code`` (two hex digits per part), ``error`` (squared distances to the
    entries, summed), ``label_error`` (errors of the label), ``codebooks_sha256``."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256: a code has two hex digits per part")
    rows = usable(vectors, id_col, vector_col, label_col, parts)
    books = train(rows, parts, entries, rounds, scale)
    hashes = {dim: digest(book) for dim, book in books.items()}

    def encode(batches):
        for batch in batches:
            codes, errors, marks = [""] * batch.num_rows, [0] * batch.num_rows, [""] * batch.num_rows
            for at, x in _integers(batch.column(1), scale):
                found = [nearest(part, b) for part, b in zip(_cut(x, parts), books[x.shape[1]])]
                index = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
                far = sum(d.astype(object) for _, d in found)
                for k, row in enumerate(at.tolist()):
                    codes[row], errors[row], marks[row] = index[k].tobytes().hex(), min(int(far[k]), LONG), hashes[x.shape[1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes, pa.string()), pa.array(errors, pa.int64()),
                                              pa.array(marks, pa.string())], names=["id", "label", "code", "error", "codebooks_sha256"])

    schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType()),
                           T.StructField("codebooks_sha256", T.StringType())])
    coded = rows.select("id", "v", "label").mapInArrow(encode, schema)
    totals = coded.groupBy(F.col("label").alias("of")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return (coded.join(totals, coded["label"].eqNullSafe(totals["of"]))
            .select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256"))


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    near = """a{k} AS MATERIALIZED (SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT p.r, p.part, c.entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM p JOIN c{k} c USING (part)) GROUP BY r, part),
"""
    step = """m{k} AS (SELECT part, entry, j, sum(x) AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS j
  FROM a{k} JOIN p USING (r, part)) GROUP BY ALL),
n{k} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM m{k} GROUP BY part, entry),
c{next} AS MATERIALIZED (SELECT part, entry, coalesce(n{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN n{k} USING (part, entry)),
"""
    loop = "".join(near.format(k=k) + (step.format(k=k, next=k + 1) if k < rounds else "") for k in range(rounds + 1))
    return f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {parts} = 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r, len(v) // {parts} AS s FROM e),
p AS MATERIALIZED (SELECT r, part, v[part * s + 1:(part + 1) * s] AS v FROM (SELECT *, unnest(range({parts})) AS part FROM o)),
c0 AS MATERIALIZED (SELECT part, r AS entry, v FROM p WHERE r < {entries}),
{loop}b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
f AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM o JOIN f USING (r) CROSS JOIN b
"""


ORACLE = _oracle()
