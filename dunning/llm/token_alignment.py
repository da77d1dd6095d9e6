"""Alignment of the tokens of two tokenizers, with corpus-wide link counts.

A byte-level BPE (A) encodes a space and the text; a piece model (B) encodes the
text, to which it adds the space itself. The running byte ends of A's tokens are
the keys of a dictionary to their indexes, so are those of B; the keys that both
hash sets hold, sorted, slice both id lists into groups. Every A token of a group is
linked with every B token of it; links are expanded group by group, those of a group of more
than ``GROUP`` links as different id pairs with their number.

Units. Neither tokenizer joins a character that is not white space with a space behind it:
A's pattern ends there, and no piece of B has its space mark behind another character
(checked when the model is loaded; without that the whole text is one unit). A text is
therefore aligned unit by unit, and every end of a unit ends a group. A task
remembers about twice ``UNITS`` short units at most, which is what makes words that recur cheap.
The units that it does not know are encoded by A as one text and aligned in arrays over all their
tokens; where bytes differ, or a group is large, units are aligned one by one.

Counts. A pair's count is the number of documents that hold it. A first pass writes
each document's different pairs, packed, to the shared checkpoint folder; tasks
count pairs in bounded tables, and a sum per pair joins them. The best count of an
A id is one row per entry of A's vocabulary. The ``known`` most frequent pairs are
broadcast, a number fixed by the parameter: all pairs of a count of at least t, t being the
smallest power of two that fits; they hold most links. The links of all rarer pairs are joined
by pair, whose rows are fewer than t each, and summed per document.

Scale: two passes, one over the texts and one over the packed pairs; nothing is shuffled
but partial counts, the rare links, and one short row per document. A task holds one
text and its tokens at a time besides its bounded tables.

Defined results: a text that is null, empty, or that a tokenizer does not give back byte
by byte has no tokens: zeros and empty strings; null ids are passed through; repeated rows
count as documents of their own; ties for the best count are all best; an empty
table gives an empty result; other columns are ignored; long texts and long units are
processed whole.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable
from itertools import accumulate, chain, count, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunning.llm.graph import shared_folder

UNITS = 250_000
UNIT_CHARS = 64
GROUP = 256
TEXTS = 64
PARTIAL = 2_000_000
KNOWN = 1 << 19
# White space of either tokenizer (a set too large only makes units longer).
SPACES = "\t-\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = re.compile(f"(?<=[^{SPACES}])(?= )")
UNSAFE = re.compile(f"[{SPACES}] ")
ENDS_BLANK = re.compile(f".*[{SPACES}]\\Z", re.DOTALL).match
MARK = "▁"


def byte_of_symbol() -> dict[str, int]:
    """The symbols of byte-level BPE: printable bytes stand for themselves, the others for characters from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        symbol = byte_of_symbol()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(symbol[c] for c in t) if all(c in symbol for c in t) else b""
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(names)]
        self.splits = not any(MARK in t.lstrip(MARK) for t in names)
        self.mark = self.b.piece_to_id(MARK)
        added = [t.content for t in self.a.get_added_tokens_decoder().values()]
        #: Whether units of A may be encoded as one text: no added token crosses a space.
        self.joins = self.splits and not any(" " in t for t in added)
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        #: The ids as text with the mark that follows them: inside a group, and at the end of A's or B's part.
        self.a_text = [np.array([f"{i}{end}" for i in range(len(self.a_bytes))], dtype=object) for end in ",|"]
        self.b_text = [np.array([f"{i}{end}" for i in range(len(names))], dtype=object) for end in ",;"]
        #: A pair of ids is the number a * n_b + b.
        self.n_a, self.n_b = len(self.a_bytes), len(names)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch(units, add_special_tokens=False)]
        # the model adds its space to any text but an empty one
        b = [ids or [self.mark] for ids in self.b.encode([u[1:] for u in units], num_threads=1)]
        return a, b

    def encode_joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A's ids of units that end in no white space, one after another; B's; how many of these each unit has."""
        a = self.a.encode("".join(units), add_special_tokens=False).ids
        b = [ids or [self.mark] for ids in self.b.encode([u[1:] for u in units], num_threads=1)]
        return (np.array(a, dtype=np.int64), np.fromiter(chain.from_iterable(b), dtype=np.int64),
                np.fromiter(map(len, b), dtype=np.int64, count=len(b)))

    def units(self, text: str) -> list[str]:
        if not self.splits:
            return [" " + text]
        if UNSAFE.search(text) or text[:1] == " ":
            return SPLIT.split(" " + text)
        return [" " + u for u in text.split(" ")]


def groups(a_lengths: Iterable[int], b_lengths: Iterable[int]) -> list[tuple[int, int]]:
    """Ends (index into A, index into B, both exclusive) of the groups of two token lists of the same bytes."""
    a_end = dict(zip(accumulate(a_lengths), count(1)))
    b_end = dict(zip(accumulate(b_lengths), count(1)))
    return [(a_end[e], b_end[e]) for e in sorted(a_end.keys() & b_end.keys())]


class Aligner:
    """Aligns texts of one task; remembers a bounded number of units."""

    def __init__(self, byte_level: str, pieces: str):
        self.pair = Pair(byte_level, pieces)
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def unit(self, unit: str, a: list[int], b: list[int]) -> tuple | None:
        """(groups as text, n_a, n_b, n_groups, pairs of 8 bytes each, their numbers or None if 1 each); None if bytes differ.
        A pair may come several times."""
        a_bytes, b_bytes = list(map(self.pair.a_bytes.__getitem__, a)), list(map(self.pair.b_bytes.__getitem__, b))
        if not b"".join(a_bytes) == b"".join(b_bytes) == unit.encode():
            return None
        n_b, at, bt, text, codes, times = self.pair.n_b, 0, 0, [], [], None
        for a_to, b_to in groups(map(len, a_bytes), map(len, b_bytes)):
            if a_to - at == b_to - bt == 1:
                text.append(f"{a[at]}|{b[bt]}")
                codes.append(a[at] * n_b + b[bt])
            else:
                left, right = a[at:a_to], b[bt:b_to]
                text.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                if len(left) * len(right) > GROUP and times is None:
                    times = [1] * len(codes)
                if times is None:
                    codes += [x * n_b + y for x in left for y in right]
                else:  # from the first large group on: different ids and their numbers
                    for (x, n), (y, m) in product(Counter(left).items(), Counter(right).items()):
                        codes.append(x * n_b + y)
                        times.append(n * m)
            if times is not None and len(times) < len(codes):
                times.append(1)
            at, bt = a_to, b_to
        return (";".join(text), len(a), len(b), len(text), array("q", codes).tobytes(), None if times is None else array("q", times).tobytes())

    def together(self, units: list[str]) -> list[tuple | None] | None:
        """``unit`` of many units that end in no white space, in arrays over all their tokens; None if one of them
        needs to be looked at by itself (bytes differ, tokens without bytes, a large group)."""
        pair = self.pair
        a, b, n_b = pair.encode_joined(units)
        raw = list(map(str.encode, units))
        whole = b"".join(raw)
        if b"".join(map(pair.a_bytes.__getitem__, a.tolist())) != whole or b"".join(map(pair.b_bytes.__getitem__, b.tolist())) != whole:
            return None
        a_size, b_size = pair.a_sizes[a], pair.b_sizes[b]
        if not a_size.all() or not b_size.all():
            return None
        ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        a_end, b_end, b_to = np.cumsum(a_size), np.cumsum(b_size), np.cumsum(n_b)
        a_to = np.searchsorted(a_end, ends) + 1
        if (a_end[a_to - 1] != ends).any() or (b_end[b_to - 1] != ends).any():
            return None
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        in_a, in_b = np.bincount(a_group), np.bincount(b_group)
        if (in_a * in_b).max() > GROUP:
            return None
        a_stop, b_stop = np.cumsum(in_a), np.cumsum(in_b)
        b_start = b_stop - in_b
        # links: every A token with the B tokens of its group
        times = in_b[a_group]
        link_to = np.cumsum(times)
        b_of_link = np.arange(link_to[-1]) + np.repeat(b_start[a_group] - (link_to - times), times)
        codes = (np.repeat(a, times) * pair.n_b + b[b_of_link]).tobytes()
        # text: a group's A tokens, then its B tokens
        parts = np.empty(len(a) + len(b), dtype=object)
        a_last, b_last = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        a_last[a_stop - 1] = b_last[b_stop - 1] = True
        parts[np.arange(len(a)) + b_start[a_group]] = np.where(a_last, pair.a_text[1][a], pair.a_text[0][a])
        parts[np.arange(len(b)) + a_stop[b_group]] = np.where(b_last, pair.b_text[1][b], pair.b_text[0][b])
        parts = parts.tolist()
        out, at, link_at = [], 0, 0
        n_a, n_groups = np.diff(a_to, prepend=0).tolist(), np.diff(np.searchsorted(common, ends) + 1, prepend=0).tolist()
        for to, link, *numbers in zip((a_to + b_to).tolist(), (8 * link_to[a_to - 1]).tolist(), n_a, n_b.tolist(), n_groups):
            out.append(("".join(parts[at:to])[:-1], *numbers, codes[link_at:link], None))
            at, link_at = to, link
        return out

    def aligned(self, units: list[str], parts: int = 16) -> list[tuple | None]:
        """``unit`` of every unit: all at once, else in ``parts`` parts, else one by one."""
        if self.pair.joins and len(units) > 1:
            if not any(map(ENDS_BLANK, units)):
                found = self.together(units)
                if found is not None:
                    return found
                if parts > 1:
                    size = max(1, len(units) // parts)
                    return [x for lo in range(0, len(units), size) for x in self.aligned(units[lo:lo + size], 1)]
            else:
                plain = [u for u in units if not ENDS_BLANK(u)]
                blank = [u for u in units if ENDS_BLANK(u)]
                found = dict(zip(plain, self.aligned(plain, parts))) | dict(zip(blank, map(self.unit, blank, *self.pair.encode(blank))))
                return list(map(found.__getitem__, units))
        return list(map(self.unit, units, *self.pair.encode(units)))

    def learn(self, units: set[str]) -> None:
        known, older = self.known, self.older
        new = [u for u in units if u not in known]
        if len(known) + len(new) > UNITS and known:
            # what was not asked for since the last turn is forgotten
            self.known, self.older = known, older = {}, known
            new = list(units)
        again = [u for u in new if u in older]
        known.update(zip(again, map(older.__getitem__, again)))
        if len(again) < len(new):
            new = [u for u in new if u not in known]
            known.update(zip(new, self.aligned(new)))

    def many(self, texts: list[str | None]):
        """(n_a, n_b, n_groups, n_links, groups as text, pair codes, numbers) of each text, None without tokens."""
        split = [self.pair.units(t) if t else [] for t in texts]
        self.learn({u for units in split for u in units if len(u) <= UNIT_CHARS})
        for units in split:
            if max(map(len, units), default=0) <= UNIT_CHARS:
                parts = list(map(self.known.__getitem__, units))
            else:
                parts = [self.known[u] if len(u) <= UNIT_CHARS else self.unit(u, *(ids[0] for ids in self.pair.encode([u]))) for u in units]
            if not parts or None in parts:
                yield None
                continue
            text, n_a, n_b, n_groups, codes, times = zip(*parts)
            found = np.frombuffer(b"".join(codes), dtype=np.int64)
            if any(times):
                n = np.concatenate([np.frombuffer(t, dtype=np.int64) if t else np.ones(len(c) // 8, dtype=np.int64) for c, t in zip(codes, times)])
                pairs, at = np.unique(found, return_inverse=True)
                total = np.zeros(len(pairs), dtype=np.int64)
                np.add.at(total, at, n)
                n = total
            else:
                pairs, n = np.unique(found, return_counts=True)
            yield sum(n_a), sum(n_b), sum(n_groups), int(n.sum()), ";".join(text), pairs, n


def _narrow(x: np.ndarray) -> bytes:
    """Numbers of 1 or more in a byte each where they fit, else in 8."""
    return x.astype(np.uint8 if not len(x) or x.max() < 256 else np.int64).tobytes()


def _numbers(batch: pa.RecordBatch, at: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row within the batch, pair, number) of all packed pairs of a batch; columns ``at`` and ``at + 1``."""
    pairs, times = batch.column(at).to_pylist(), batch.column(at + 1).to_pylist()
    sizes = [len(x) // width for x in pairs]
    codes = np.frombuffer(b"".join(pairs), dtype=f"u{width}").astype(np.int64)
    if all(len(t) == k for t, k in zip(times, sizes)):
        n = np.frombuffer(b"".join(times), dtype=np.uint8).astype(np.int64)
    else:
        n = np.concatenate([np.frombuffer(t, dtype=np.uint8 if len(t) == k else np.int64).astype(np.int64) for t, k in zip(times, sizes)])
    return np.repeat(np.arange(len(sizes)), sizes), codes, n


def pack(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
         with_groups: bool = False) -> DataFrame:
    """One row per document: ``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, its different pairs
    ascending in ``width`` bytes each, their numbers and, with ``with_groups``, the ``groups`` as text."""
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"] + ["groups"] * with_groups
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 2 + [pa.string()] * with_groups

    def run(batches):
        aligner = Aligner(byte_level, pieces)
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                rows = []
                for found in aligner.many(batch.column(1)[lo:lo + TEXTS].to_pylist()):
                    if found is None:
                        row = [0, 0, 0, 0, "", b"", b"", ""]
                    else:
                        *numbers, text, codes, n = found
                        row = [*numbers, hashlib.sha256(text.encode()).hexdigest(), codes.astype(f"u{width}").tobytes(), _narrow(n), text]
                    rows.append(row[:len(kinds)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:lo + TEXTS], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)

    schema = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary" + ", groups string" * with_groups
    fields = [T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL(schema).fields]
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, T.StructType(fields))


def count_pairs(packed: DataFrame, width: int) -> DataFrame:
    """(pair, n): the number of documents that hold each pair; tasks count in tables of bounded size."""

    def run(batches):
        def merged(parts):
            pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            n = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(n, at, np.concatenate([n for _, n in parts]))
            return pairs, n

        def out(parts):
            pairs, n = merged(parts)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

        parts, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 10 * TEXTS):
                parts.append(np.unique(_numbers(batch.slice(lo, 10 * TEXTS), 0, width)[1], return_counts=True))
                size += len(parts[-1][0])
                if size > PARTIAL:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size > PARTIAL // 2:
                        yield out(parts)
                        parts, size = [], 0
        if parts:
            yield out(parts)

    return packed.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN,
          with_groups: bool = False) -> DataFrame:
    """One row per document: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose count is the highest of
    their A id), ``count_sum`` (counts over links), ``groups_sha256`` and, with ``with_groups``, ``groups``."""
    spark = docs.sparkSession
    pair = Pair(byte_level, pieces)
    n_b, width = pair.n_b, 4 if pair.n_a * pair.n_b < 1 << 32 else 8
    folder = os.path.join(shared_folder(spark), f"token-alignment-{uuid.uuid4().hex}")
    (pack(docs, byte_level, pieces, id_col, text_col, width, with_groups).withColumn("row", F.monotonically_increasing_id())
     .write.option("compression", "zstd").parquet(f"{folder}/packed"))
    packed = spark.read.parquet(f"{folder}/packed")
    count_pairs(packed, width).withColumn("a", F.expr(f"cast(pair div {n_b} as int)")).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    # at most one row per entry of A's vocabulary
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))

    # the broadcast part: counts of 2^low or more, at most ``known`` pairs
    sizes = {r["bits"]: r["k"] for r in counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count(F.lit(1)).alias("k")).collect()}
    low, total = 64, 0
    while low and total + sizes.get(low, 0) <= known:
        total += sizes.get(low, 0)
        low -= 1
    least = 1 << low
    frequent = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(frequent.column("pair").to_numpy())
    table = spark.sparkContext.broadcast(tuple(frequent.column(c).to_numpy()[order] for c in ("pair", "n", "best")))

    def look_up(codes):
        pairs, n, best = table.value
        at = np.minimum(np.searchsorted(pairs, codes), max(0, len(pairs) - 1))
        hit = pairs[at] == codes if len(pairs) else np.zeros(len(codes), dtype=bool)
        return hit, at, n, best

    def frequent_links(batches):
        for batch in batches:
            row, codes, times = _numbers(batch, 1, width)
            hit, at, n, best = look_up(codes)
            sums, tops = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            np.add.at(sums, row[hit], times[hit] * n[at[hit]])
            np.add.at(tops, row[hit], times[hit] * best[at[hit]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tops), pa.array(sums)], names=["row", "n_best", "count_sum"])

    def rare_links(batches):
        for batch in batches:
            row, codes, times = _numbers(batch, 1, width)
            rest = ~look_up(codes)[0]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[row[rest]]), pa.array(codes[rest]), pa.array(times[rest])],
                                             names=["row", "pair", "times"])

    links = packed.select("row", "pairs", "times")
    rare = (links.mapInArrow(rare_links, "row long, pair long, times long").join(counts.where(F.col("n") < least), "pair")
            .select("row", F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")))
    sums = (links.mapInArrow(frequent_links, "row long, n_best long, count_sum long").union(rare)
            .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    shown = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * with_groups
    return packed.drop("pairs", "times").join(sums, "row").select(F.col("id").alias(id_col), *shown)
