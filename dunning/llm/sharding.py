"""Sharding by proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash and ranked; row r of n (from 0)
has the fractional rank (2 r + 1) / (2 n). Sorting all rows by fractional rank
interleaves the sources in proportion, and cutting the order into equal parts
gives shards whose counts differ by at most one and whose mixture matches the
whole's (each source is off by less than two rows in any shard).

Scale: ranks are prefix sums. The hash range is cut into even ranges; rows are
counted per (source, range), ranges are added up per source, and rows are
numbered inside their range only, so a source with a third of all rows is
ranked by many tasks. The same again for the global order. Texts never leave
the scan: only id, size, checksum and keys are shuffled. DataFrame functions
throughout.

Defined results: a null text has size 1 and the checksum of the empty text; a
null source is a source of its own; rows with a null id and repeated rows are
ordinary rows (ties of the order are broken by id, then checksum); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE_ROWS = 20_000  # expected rows of one hash or rank range
LAW = "rows"


def _numbered(rows: DataFrame, keys: list[str], range_col: str, order: list) -> DataFrame:
    """0-based ``rank`` of each row inside its ``keys``, ordered by range and then ``order``:
    rows before its range plus its number inside the range. Adds ``total`` (rows of the keys)."""
    counts = rows.groupBy(*keys, range_col).agg(F.count(F.lit(1)).alias("_n"))
    running = W.partitionBy(*keys).orderBy(range_col).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(range_col).alias("_range"),
                           F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"),
                           F.sum("_n").over(W.partitionBy(*keys)).alias("total"))
    inside = W.partitionBy(*keys, range_col).orderBy(*order)
    on = F.col(range_col) == F.col("_range")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return (rows.withColumn("_row", F.row_number().over(inside) - 1).join(starts, on)
            .withColumn("rank", F.col("_before") + F.col("_row"))
            .drop("_row", "_range", "_before", *[f"_{k}" for k in keys]))


def stratified_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                      shards: int = 16, seed: int = 11) -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``law`` ('rows'), ``shard``
    (0-based), ``slot`` (position in the shard, gapless from 0), ``grown_shard`` (null),
    ``source``."""
    total = docs.count()
    if total == 0:
        ranges = 1
    else:
        ranges = max(1, total // RANGE_ROWS)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("hash", F.xxhash64(F.lit(seed), "id", "text_crc32"))
    rows = rows.withColumn("range", F.floor((F.shiftrightunsigned("hash", 11) / F.lit(float(1 << 53))) * ranges))
    rows = rows.withColumn("hash", F.shiftrightunsigned("hash", 11))
    ranked = _numbered(rows, ["source"], "range", ["hash", "id", "text_crc32"])
    ranked = (ranked.withColumn("fraction", (2 * F.col("rank") + 1) / (2 * F.col("total")))
              .drop("rank", "total", "range").withColumn("part", F.floor(F.col("fraction") * ranges)).withColumn("all", F.lit(0)))
    placed = _numbered(ranked, ["all"], "part", ["fraction", "source", "hash", "id", "text_crc32"])
    shard = F.expr(f"rank * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (placed.withColumn("shard", shard.cast("long")).withColumn("slot", F.col("rank") - first)
            .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"),
                    F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source"))
