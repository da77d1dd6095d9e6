"""Removal of repeated lines or paragraphs by hashing.

A text is cut into units (lines at \\n, or paragraphs at blank lines). A unit is
normalised (lower case, white-space runs to one space, trimmed) and hashed; the
128-bit digests are grouped globally, the occurrence that ranks first (smallest
document id, then position) stays and every other one is removed. Every unit that
is not blank is compared, in scripts without spaces too; a larger ``min_words``
spares units of fewer words.

Scale: only (digest, id, key, position, offsets) leave the scan. Minima per digest
are pre-aggregated in each task; the join that marks later occurrences is a
plain equi join, so a unit that a third of all documents hold is split by
adaptive skew handling; each document then collects only its own spans, and its
text is shuffled once to meet them.

Passages (``passage_words``): a repeat inside lines that differ, or across lines, is no
repeated line. With it, every window of that many words (normalised as units are) is
compared as well, and the maximal runs of words in windows that stand in another document
too are reported; a repeat within one document is none, and the first occurrence counts
like the others, since nothing is removed. A window is known by the least of the
fingerprints of its word n-grams (a third of its words): blocks of about ``BLOCK_BYTES`` of
text send each of these once, and only windows whose least one is held by another document
send their own fingerprint. Fingerprints are 64-bit and keyed anew for each call; among m
different windows about m^2 / 2^65 pairs meet. The text is shuffled once more for it, by
block; a text must fit a task.

A row is known by its id and a 64-bit digest of id and text (``key``), which
ranks rows of one id or of none: spans found in one text never reach another.

Defined results: null and empty texts have no units and keep an empty text;
documents with a null id rank last; rows of the same id and text are one row: the
first occurrence in it stays in each of them; an empty table gives an
empty result; other columns are ignored. A removed line takes the \\n after it
(the last line the one before it) with it; offsets count code points of the
input and cover the unit alone.
"""

from __future__ import annotations

import hashlib
import re
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunning.llm.graph import freeing
from dunning.llm.suffix_dedup import (BLOCK_BYTES, BUCKET_PRINTS, MARKS, SENT, _first_of_equals, _incoming, _sent, _spans, _ties,
                                      _within)

SEPARATOR = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")}
NO_ID = (1 << 63) - 1  # rank of a null id
SPANS = "array<struct<start: long, end: long>>"


def units_of(text: str, unit: str, min_words: int) -> list[tuple[int, int, int, bytes]]:
    """(position, start, end, digest) of the units that are compared."""
    import xxhash

    out, start, position = [], 0, 0
    borders = [m.span() for m in SEPARATOR[unit].finditer(text)] + [(len(text), len(text))]
    for end, after in borders:
        words = text[start:end].lower().split()
        if len(words) >= min_words:
            out.append((position, start, end, xxhash.xxh3_128_digest(" ".join(words))))
        start, position = after, position + 1
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans and one separator run each."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
        if at < len(text):
            at += len(re.match(r"\n?", text[at:at + 1]).group())
    kept = "".join(out) + text[at:]
    if spans and spans[-1][1] == len(text) and kept.endswith("\n"):
        kept = kept[:-1]
    return kept


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(given, text, id, key): the id as given, the id that ranks, the digest of id and text."""
    rows = docs.select(F.col(id_col).cast("long").alias("given"), F.col(text_col).cast("string").alias("text"))
    return rows.select("given", "text", F.coalesce("given", F.lit(NO_ID)).alias("id"), F.xxhash64("given", "text").alias("key"))


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line",
                   min_words: int = 1) -> DataFrame:
    """(id, key, position, start, end) of every unit that occurs earlier."""

    def run(batches):
        for batch in batches:
            rows = [(i, k, *u) for i, k, t in zip(*(c.to_pylist() for c in batch.columns)) if t
                    for u in units_of(t, unit, min_words)]
            columns = list(zip(*rows)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             names=["id", "key", "position", "start", "end", "digest"])

    units = (keyed(docs, id_col, text_col).select("id", "key", "text")
             .mapInArrow(run, "id long, key long, position long, start long, end long, digest binary"))
    first = (units.groupBy("digest").agg(F.min(F.struct("id", "key", "position")).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("digest", "first"))
    return (units.join(first, "digest").where("struct(id, key, position) > first")
            .select("id", "key", "position", "start", "end").distinct())


class Windows:
    """The windows of ``size`` words of the different rows of one block."""

    def __init__(self, table: pa.Table, size: int, key: str):
        import pandas as pd

        self.size, self.gram = size, -(-size // 3)
        rows = dict(zip(zip(table.column("id").to_pylist(), table.column("key").to_pylist()), table.column("text").to_pylist()))
        self.rows = [(i, k, t) for (i, k), t in sorted(rows.items())]
        hashes, lens = [np.zeros(0, dtype=np.uint64)], []
        for _, _, text in self.rows:
            words = text.lower().split()
            hashes.append(pd.util.hash_array(np.array(words, dtype=object), hash_key=key, categorize=False))
            lens.append(len(words))
        self.lens = np.array(lens, dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lens)])
        counts = np.maximum(self.lens - size + 1, 0)
        self.row = np.repeat(np.arange(len(counts)), counts)  # of each window
        self.starts = np.arange(int(counts.sum())) + np.repeat(self.offsets[:-1] - (np.cumsum(counts) - counts), counts)
        values = np.concatenate(hashes)
        self.grams = _mixed([values[k:len(values) - self.gram + 1 + k] for k in range(self.gram)]) if len(self.starts) else values[:0]

    def least(self) -> np.ndarray:
        """The least fingerprint of an n-gram of each window."""
        values, span, wanted = self.grams, 1, self.size - self.gram + 1
        while len(self.starts) and span < wanted:
            step = min(span, wanted - span)
            values, span = np.minimum(values[:len(values) - step], values[step:]), span + step
        return values[self.starts]

    def prints(self, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the windows ``at``, of the n-grams that cover them."""
        steps = [*range(0, self.size - self.gram, self.gram), self.size - self.gram]
        return _mixed([self.grams[self.starts[at] + k] for k in steps])

    def candidates(self, marks: dict[int, bytes], buckets: int) -> np.ndarray:
        return np.nonzero(_incoming(self.least(), marks, buckets))[0]

    def once(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The fingerprints, each once for every row that holds it."""
        order = np.lexsort((prints, self.row[at]))
        values, rows = prints[order], self.row[at][order]
        return values[_first_of_equals(values) | _first_of_equals(rows)]

    def passages(self, at: np.ndarray):
        """(id, key, spans in code points) of the rows that hold a window of ``at``."""
        covered = _within(self.starts[at], self.starts[at] + self.size, int(self.offsets[-1]) + 1)
        for row in np.unique(self.row[at]).tolist():
            given, key, text = self.rows[row]
            words = [m.span() for m in re.finditer(r"\S+", text)]
            lo = int(self.offsets[row])
            yield given, key, [{"start": words[a][0], "end": words[b - 1][1]} for a, b in _spans(covered[lo:lo + len(words)])]


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """One fingerprint of the fingerprints at each place, in their order."""
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for part in parts:
        out ^= part
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 51) -> DataFrame:
    """(id, key, passages): the maximal runs of words of each row that lie in windows of
    ``words`` words which another document holds too; rows without any are left out."""
    n_bytes = int(docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0)
    blocks, buckets = max(16, n_bytes // BLOCK_BYTES), max(64, n_bytes // (4 * BUCKET_PRINTS))
    key = secrets.token_hex(8)  # one key for all tasks of this call
    rows = (keyed(docs, id_col, text_col).where("text is not null")
            .select(F.pmod(F.xxhash64("id", "key"), F.lit(blocks)).alias("block"), "id", "key", "text"))

    def marks_of(right: pa.Table, stage: str) -> dict[int, bytes]:
        return {b: m for s, b, m in zip(*(right.column(k).to_pylist() for k in ("stage", "bucket", "marks"))) if s == stage}

    def least_stage(left: pa.Table) -> pa.Table:
        own = Windows(left, words, key)
        return _sent(left.column("block")[0].as_py(), own.once(own.least(), np.arange(len(own.starts))), buckets)

    def window_stage(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Windows(left, words, key)
        at = own.candidates(marks_of(right, "least"), buckets)
        return _sent(left.column("block")[0].as_py(), own.once(own.prints(at), at), buckets)

    def mark_stage(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Windows(left, words, key)
        at = own.candidates(marks_of(right, "least"), buckets)
        at = at[_incoming(own.prints(at), marks_of(right, "window"), buckets)]
        columns = list(zip(*own.passages(at))) or [[]] * 3
        types = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "key", "passages"])

    def staged(marks: DataFrame, stage: str) -> DataFrame:
        return marks.select("block", F.lit(stage).alias("stage"), "bucket", "marks")

    def tied(sent: DataFrame) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(freeing(_ties), MARKS)

    by_block = rows.groupBy("block")
    least = staged(tied(by_block.applyInArrow(freeing(least_stage), SENT)), "least")
    window = staged(tied(by_block.cogroup(least.groupBy("block")).applyInArrow(freeing(window_stage), SENT)), "window")
    known = least.unionByName(window)
    return by_block.cogroup(known.groupBy("block")).applyInArrow(freeing(mark_stage), f"id long, key long, passages {SPANS}")


def remove_repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line",
                          min_words: int = 1, passage_words: int = 0) -> DataFrame:
    """One row per document: id, ``n_removed`` (units), ``n_chars_removed``, ``spans``
    (removed units in the input), ``kept_text``, ``kept_sha256``. With ``passage_words``, also
    ``n_passages``, ``n_passage_chars`` and ``passages`` (spans in the input, none of them removed):
    see ``shared_passages``."""
    spans = (repeated_units(docs, id_col, text_col, unit, min_words).groupBy("id", "key")
             .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")))

    span_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_removed", T.LongType()),
                        T.StructField("n_chars_removed", T.LongType()), T.StructField("spans", span_type),
                        T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())])

    if passage_words:
        out = out.add("passages", span_type)

    def run(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text, spans = text or "", spans or []
                kept = without_spans(text, [(s["start"], s["end"]) for s in spans])
                for column, value in zip(columns, (len(spans), len(text) - len(kept), spans, kept,
                                                   hashlib.sha256(kept.encode()).hexdigest())):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types)), *batch.columns[3:]],
                                             names=out.names)

    found = keyed(docs, id_col, text_col).join(spans, ["id", "key"], "left")
    if not passage_words:
        return found.select("given", "text", "spans").mapInArrow(run, out)
    found = found.join(shared_passages(docs, id_col, text_col, passage_words), ["id", "key"], "left")
    every = F.coalesce("passages", F.array().cast(SPANS)).alias("passages")
    done = found.select("given", "text", "spans", every).mapInArrow(run, out)
    n_chars = F.aggregate("passages", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select(*out.names[:-1], F.size("passages").cast("long").alias("n_passages"), n_chars.alias("n_passage_chars"), "passages")
