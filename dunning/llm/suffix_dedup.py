"""Exact removal of repeated byte strings: suffix buckets with a difference cover.

A suffix matters only up to ``length`` bytes: two suffixes tie when their first
``length`` bytes are equal, and a byte is removed when a tied suffix covers it.

1. Difference cover. D is a perfect difference set modulo v: for any two
   positions i, j there is a shift s < v that takes both to sampled positions
   (position mod v in D). Two suffixes that tie therefore agree on the first
   ``length - v + 1`` bytes of their sampled suffixes at one common s.
2. Cover-sample ranks. The sampled suffixes (|D| of every v positions) are
   sorted by that prefix, one bucket at a time; the rank says whether a sampled
   suffix ties with another one or stands alone.
3. Suffix buckets. A suffix with no tied sampled suffix within v bytes can't tie
   and never leaves its block. The others are sorted, again one bucket of the
   suffix order at a time, and neighbours that tie are marked.
4. Each block reads its marks back, joins the marked ranges into runs and
   hashes what is left.

Passages of a number of words (``passage_words``) are found alike, with word starts in
place of bytes and from the same exchange of the text; their fingerprints go to further buckets.

Prefixes are compared by fingerprints (the order inside and between buckets is the
order of the fingerprints, so buckets are even whatever the texts): the value of the
prefix, read as a polynomial, at a random point modulo the prime 2^61 - 1. The point is drawn
anew for each call, so no pair of texts is built to collide; two given different prefixes of n bytes
meet with probability below n / 2^61, and among m candidates about m^2 / 2^62 pairs do.

Bounded memory: a block holds about ``BLOCK_BYTES`` of text, a bucket about
``BUCKET_PRINTS`` fingerprints. Every block sends a fingerprint once however
often it holds it, and gets back one bit for each, so a passage that very many
documents share costs one entry per block. Texts that occur more than once are
reduced to one before all this (a copy ties with it everywhere). The text is
shuffled once and read by three stages from that one exchange.

Defined results: a null text is an empty one; texts shorter than ``length``
keep everything; repeated rows are copies of each other and lose everything if
they are long enough; a null id is passed through; an empty table gives an
empty result; other columns are ignored. Every occurrence of a repeated string
is removed, the first included.
"""

from __future__ import annotations

import hashlib
import secrets
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunning.llm.graph import freeing

BLOCK_BYTES = 2 << 20
BUCKET_PRINTS = 2 << 20
PRIME = (1 << 61) - 1              # modulus of the rolling fingerprint
SLICE = 1 << 16
PRIMES = (17, 13, 11, 7, 5, 3, 2)  # orders q of the difference covers, v = q^2 + q + 1


@lru_cache(maxsize=8)
def difference_cover(length: int) -> tuple[int, np.ndarray]:
    """(v, sampled residues): the largest cover that leaves at least a fifth of
    ``length`` (or one byte) to compare at a sampled position.

    For a prime q, the exponents e with trace(g^e) = 0 in the field of q^3
    elements, modulo v = q^2 + q + 1, form a perfect difference set (Singer).
    """
    for q in PRIMES:
        v = q * q + q + 1
        if length - v + 1 >= max(1, length // 5):
            return v, _singer(q)
    return 1, np.zeros(1, dtype=np.int64)


def _singer(q: int) -> np.ndarray:
    """q + 1 residues modulo q^2 + q + 1 with every difference exactly once:
    exponents e where g^e has no z^2 part, g = z a generator of GF(q^3)."""
    v = q * q + q + 1
    for c in range(q ** 3):
        c0, c1, c2 = c % q, c // q % q, c // q // q  # z^3 = c0 + c1 z + c2 z^2
        x, hits = (1, 0, 0), []
        for e in range(v):
            if x[2] == 0:
                hits.append(e)
            x = (x[2] * c0 % q, (x[0] + x[2] * c1) % q, (x[1] + x[2] * c2) % q)
        if len(hits) == q + 1 and len({(a - b) % v for a in hits for b in hits}) == v:
            return np.array(hits, dtype=np.int64)
    raise ValueError(f"no difference set of order {q}")


_P, _LOW, _29 = np.uint64(PRIME), np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME for x below 2^64."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, by halves of 32 and 29 bits (2^61 is 1, so 2^64 is 8); slice by slice, which
    bounds what is held between. ``b`` may be one number."""
    out = np.empty(len(a), dtype=np.uint64)
    for lo in range(0, len(a), SLICE):
        x, y = a[lo:lo + SLICE], b if len(b) == 1 else b[lo:lo + SLICE]
        x1, x0, y1, y0 = x >> np.uint64(32), x & _LOW, y >> np.uint64(32), y & _LOW
        low, middle = x0 * y0, x1 * y0 + x0 * y1
        out[lo:lo + SLICE] = _reduced((low & _P) + (low >> np.uint64(61)) + (middle >> np.uint64(29)) + ((middle & _29) << np.uint64(32))
                                      + np.uint64(8) * (x1 * y1))
    return out


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n - 1) modulo PRIME."""
    power = np.ones(1, dtype=np.uint64)
    while len(power) < n:
        power = np.concatenate([power, _times(power, np.full(1, pow(base, len(power), PRIME), dtype=np.uint64))])
    return power[:n]


class Block:
    """The texts of one block, in one buffer, with rolling fingerprints at the point ``base``."""

    def __init__(self, texts: list[bytes], length: int, base: int):
        self.length, self.texts, self.base = length, texts, base
        self.lens = np.array([len(t) for t in texts], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lens)])
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        back, first = pow(base, -1, PRIME), _powers(base, SLICE)
        self.back, self.far = _powers(back, SLICE), np.array([pow(back, lo, PRIME) for lo in range(0, n + 1, SLICE)], dtype=np.uint64)
        # running sums of byte * power, high and low half apart: neither leaves 64 bits
        high = low = np.zeros(1, dtype=np.uint64)
        for lo in range(0, n, SLICE):
            values = data[lo:lo + SLICE].astype(np.uint64) + np.uint64(1)
            power = _times(first[:len(values)], np.full(1, pow(base, lo, PRIME), dtype=np.uint64))
            high = high[-1] + np.cumsum(values * (power >> np.uint64(32)))
            low = low[-1] + np.cumsum(values * (power & _LOW))
            self.sums[lo + 1:lo + len(values) + 1] = _reduced(_times(_reduced(high), np.full(1, 1 << 32, dtype=np.uint64)) + _reduced(low))

    def prints(self, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """Fingerprint of the ``size`` bytes (one number, or one a start) at each start, mixed so that its high bits are even;
        slice by slice."""
        out, sizes = np.empty(len(starts), dtype=np.uint64), np.broadcast_to(size, len(starts))
        for lo in range(0, len(starts), SLICE):
            at = starts[lo:lo + SLICE]
            h = _times(_reduced(self.sums[at + sizes[lo:lo + SLICE]] + (_P - self.sums[at])), _times(self.back[at % SLICE], self.far[at // SLICE]))
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out[lo:lo + SLICE] = h ^ (h >> np.uint64(32))
        return out

    def starts(self, size: int):
        """All starts with ``size`` bytes before the text's end, and their positions in the text; slice by slice."""
        counts = np.maximum(self.lens - size + 1, 0)
        ends = np.cumsum(counts)
        total = int(counts.sum())
        for lo in range(0, total, SLICE):
            hi = min(lo + SLICE, total)
            a, b = np.searchsorted(ends, [lo, hi - 1], side="right").tolist()
            own = counts[a:b + 1].copy()
            own[0] = ends[a] - lo
            own[-1] -= ends[b] - hi
            at = np.arange(lo, hi) - np.repeat((ends - counts)[a:b + 1], own)
            yield np.repeat(self.offsets[a:b + 1], own) + at, at

    def sampled(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the cover sample and the fingerprints that rank them."""
        v, cover = difference_cover(self.length)
        size = self.length - v + 1
        inside = np.zeros(v, dtype=bool)
        inside[cover] = True
        starts = _joined(starts[inside[at % v]] for starts, at in self.starts(size))
        return starts, self.prints(starts, size)

    def candidates(self, tied: np.ndarray) -> np.ndarray:
        """Starts of suffixes with a tied sampled suffix among their next v positions."""
        v, _ = difference_cover(self.length)
        near = _within(np.maximum(tied - v + 1, 0), tied + 1, len(self.sums) + 1)
        return _joined(starts[near[starts]] for starts, _ in self.starts(self.length))


class Words:
    """The words of a block's texts and, as for bytes, the suffixes of ``size`` words that start at one."""

    def __init__(self, block: Block, size: int):
        self.block, self.size = block, size
        data = np.frombuffer(b"".join(block.texts), dtype=np.uint8)
        inside = (data != 32) & ((data < 9) | (data > 13))
        border = np.zeros(len(data) + 1, dtype=bool)
        border[block.offsets] = True
        self.starts = np.nonzero(inside & (border[:-1] | ~np.append(False, inside[:-1])[:len(data)]))[0]
        self.ends = np.nonzero(inside & (border[1:] | ~np.append(inside[1:], False)[:len(data)]))[0] + 1
        self.first = np.searchsorted(self.starts, block.offsets)  # word number of each text's first word
        self.text = np.searchsorted(block.offsets, self.starts, side="right") - 1

    def at(self, size: int) -> np.ndarray:
        """Numbers of the words with ``size`` words before the text's end."""
        number = np.arange(len(self.starts))
        return number[number + size <= self.first[self.text + 1]]

    def prints(self, at: np.ndarray, size: int) -> np.ndarray:
        return self.block.prints(self.starts[at], self.ends[at + size - 1] - self.starts[at])

    def sampled(self) -> tuple[np.ndarray, np.ndarray]:
        v, cover = difference_cover(self.size)
        inside = np.zeros(v, dtype=bool)
        inside[cover] = True
        at = self.at(self.size - v + 1)
        at = at[inside[(at - self.first[self.text[at]]) % v]]
        return at, self.prints(at, self.size - v + 1)

    def candidates(self, tied: np.ndarray) -> np.ndarray:
        v, _ = difference_cover(self.size)
        near = _within(np.maximum(tied - v + 1, 0), tied + 1, len(self.starts) + 1)
        at = self.at(self.size)
        return at[near[at]]

    def once(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The fingerprints, each once for every text that holds it."""
        order = np.lexsort((prints, self.text[at]))
        values, texts = prints[order], self.text[at][order]
        return values[_first_of_equals(values) | _first_of_equals(texts)]

    def passages(self, at: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each text, the runs of words (spans of bytes) in the suffixes ``at``."""
        covered = _within(at, at + self.size, len(self.starts) + 1)
        return [[(int(self.starts[lo + a]) - at, int(self.ends[lo + b - 1]) - at) for a, b in _spans(covered[lo:hi])]
                for at, lo, hi in zip(self.block.offsets.tolist(), self.first.tolist(), self.first[1:].tolist())]


def _joined(parts) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.int64), *parts])


def _within(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """For each of n positions, whether a range from a start up to its end holds it."""
    change = np.zeros(n, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change, out=change) > 0


def _outgoing(prints: np.ndarray, buckets: int):
    """Distinct fingerprints by bucket: (bucket, bytes of the sorted fingerprints, bits: held twice here)."""
    values = np.sort(prints)
    new = _first_of_equals(values)
    twice = np.append(~new[1:], False)[new]
    values = values[new]
    for b, lo, hi in _ranges(values, buckets):
        yield b, values[lo:hi].tobytes(), np.packbits(twice[lo:hi]).tobytes()


def _packed(sorted_prints: bytes) -> bytes:
    """Sorted fingerprints as the gaps between them, byte plane by byte plane: the high planes of gaps are nearly all zero,
    which the compression of shuffles takes out."""
    gaps = np.diff(np.frombuffer(sorted_prints, dtype=np.uint64), prepend=np.uint64(0))
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(planes: bytes) -> np.ndarray:
    gaps = np.frombuffer(planes, dtype=np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(gaps).view(np.uint64).ravel(), dtype=np.uint64)


def _first_of_equals(values: np.ndarray) -> np.ndarray:
    """For each of sorted values, whether it differs from the one before."""
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return new


def _ranges(values: np.ndarray, buckets: int):
    """(bucket, from, to) of sorted fingerprints: a bucket of the suffix order is a range of the fingerprint, so buckets
    ascend with it."""
    borders = np.array([-(-(b << 32) // buckets) << 32 for b in range(1, buckets)], dtype=np.uint64)
    cuts = [0, *np.searchsorted(values, borders).tolist(), len(values)]
    return [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi]


def _incoming(prints: np.ndarray, marks: dict[int, bytes], buckets: int, first: int = 0) -> np.ndarray:
    """For each fingerprint, whether its bucket (they are numbered from ``first``) found it tied."""
    order = np.argsort(prints)
    values = prints[order]
    new = _first_of_equals(values)
    values = values[new]
    tied = np.zeros(len(values), dtype=bool)
    for b, lo, hi in _ranges(values, buckets):
        if first + b in marks:
            tied[lo:hi] = np.unpackbits(np.frombuffer(marks[first + b], dtype=np.uint8), count=hi - lo)
    del values
    out = np.zeros(len(prints), dtype=bool)
    out[order] = np.repeat(tied, np.diff(np.append(np.nonzero(new)[0], len(new))))
    return out


def _ties(table: pa.Table) -> pa.Table:
    """Sort one bucket; for every block, one bit for each fingerprint it sent: tied with a
    neighbour (of another block, or sent as held twice)."""
    blocks, prints, twice = (table.column(k).to_pylist() for k in ("block", "prints", "twice"))
    own = [_unpacked(p) for p in prints]
    every = np.concatenate(own)
    order = np.argsort(every)
    ordered = every[order]
    same = ordered[1:] == ordered[:-1]
    del ordered
    tied = np.zeros(len(every), dtype=bool)
    tied[order[1:][same]] = tied[order[:-1][same]] = True
    del order
    tied |= np.concatenate([np.unpackbits(np.frombuffer(t, dtype=np.uint8), count=len(o)) for t, o in zip(twice, own)]) == 1
    ends = np.cumsum([len(o) for o in own]).tolist()
    rows = [(blk, np.packbits(tied[e - len(o):e]).tobytes()) for blk, o, e in zip(blocks, own, ends) if tied[e - len(o):e].any()]
    bucket = table.column("bucket")[0].as_py()
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int64()),
                     pa.array([r[1] for r in rows], pa.binary())], names=["block", "bucket", "marks"])


SENT = "block long, bucket long, prints binary, twice binary"
MARKS = "block long, bucket long, marks binary"


def _load(left: pa.Table, right: pa.Table, length: int, base: int):
    """One block: (marks by stage and bucket, digests with copies, row -> text number, Block).

    ``right`` holds rows (stage, bucket, marks): 'rank' and 'tie' are what buckets sent
    back; 'first' and 'copy' name a digest with copies, which takes part only where it is 'first'.
    """
    marks: dict[str, dict[int, bytes]] = {"rank": {}, "tie": {}, "first": {}, "copy": {}}
    for stage, bucket, value in zip(*(right.column(k).to_pylist() for k in ("stage", "bucket", "marks"))):
        marks[stage][value if stage in ("first", "copy") else bucket] = value
    digests, texts = left.column("digest").to_pylist(), left.column("text").combine_chunks()
    row_of: dict[bytes, int] = {}
    for row, digest in enumerate(digests):
        if digest not in marks["copy"]:
            row_of.setdefault(digest, row)
    number = {digest: k for k, digest in enumerate(sorted(row_of))}
    return marks, digests, number, Block([texts[row_of[d]].as_py() for d in number], length, base)


def _tied_starts(block: Block | Words, marks: dict, rank_buckets: int, first: int = 0) -> np.ndarray:
    starts, prints = block.sampled()
    return block.candidates(starts[_incoming(prints, marks["rank"], rank_buckets, first)])


def _sent(block_id: int, prints: np.ndarray, buckets: int, first: int = 0) -> pa.Table:
    rows = list(_outgoing(prints, buckets))
    return pa.table([pa.array([block_id] * len(rows), pa.int64()), pa.array([first + r[0] for r in rows], pa.int64()),
                     pa.array([_packed(r[1]) for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                    names=["block", "bucket", "prints", "twice"])


def _spans(covered: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()))


def _whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the parts of UTF-8 characters that they hold only in part."""
    out = []
    for lo, hi in spans:
        while lo < hi and text[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(text) and text[hi] & 0xC0 == 0x80:
            hi -= 1
        if hi > lo:
            out.append((lo, hi))
    return out


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    borders = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[lo:hi] for lo, hi in zip(borders[::2], borders[1::2]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                   keep: list[str] | None = None, with_text: bool = False, words: int = 0, long: int = 0,
                   passage_words: int = 0) -> DataFrame:
    """One row per document: id, the columns ``keep`` names (as a struct ``kept``),
    ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (byte offsets of the maximal
    removed runs in the input), ``kept_sha256`` (of the remaining bytes) and, with
    ``with_text``, ``kept_text``: the remaining text, where a run that begins or
    ends inside a UTF-8 character leaves that whole character in place. With
    ``words``, a run of fewer words and fewer than ``long`` bytes stays. With
    ``passage_words``, ``n_passages``, ``n_passage_bytes`` and ``passages`` (byte spans)
    follow: the maximal runs of words covered by a string of that many words that also
    stands, between the same white space, in another document; these are not removed."""
    keep = keep or []
    base = secrets.randbelow(PRIME - (1 << 32)) + (1 << 31)  # one point for all tasks of this call
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    n_bytes = int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    blocks = max(16, n_bytes // BLOCK_BYTES)
    v, cover = difference_cover(length)
    rank_buckets = max(64, n_bytes * len(cover) // v // BUCKET_PRINTS)
    tie_buckets = max(64, n_bytes // (4 * BUCKET_PRINTS))

    digest = F.unhex(F.sha2(text, 256))
    block = F.pmod(F.xxhash64(F.col(id_col), digest), F.lit(blocks)).alias("block")
    rows = docs.select(block, F.col(id_col).alias("id"), digest.alias("digest"), text.alias("text"),
                       (F.struct(*keep) if keep else F.lit(True)).alias("kept"))

    held = docs.select(block, digest.alias("digest")).groupBy("block", "digest").agg(F.count(F.lit(1)).alias("n"))
    many = held.groupBy("digest").agg(F.sum("n").alias("n"), F.min("block").alias("home")).where("n > 1")
    copies = held.select("block", "digest").join(many, "digest").select(
        "block", F.when(F.col("block") == F.col("home"), "first").otherwise("copy").alias("stage"),
        F.lit(0).cast("long").alias("bucket"), F.col("digest").alias("marks"))

    def rank_stage(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _sent(0, np.zeros(0, np.uint64), rank_buckets)
        _, _, _, own = _load(left, right, length, base)
        block_id = left.column("block")[0].as_py()
        sent = _sent(block_id, own.sampled()[1], rank_buckets)
        if not passage_words:
            return sent
        by_word = Words(own, passage_words)
        at, prints = by_word.sampled()
        return pa.concat_tables([sent, _sent(block_id, by_word.once(prints, at), rank_buckets, rank_buckets)])

    def tie_stage(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _sent(0, np.zeros(0, np.uint64), tie_buckets)
        marks, _, _, own = _load(left, right, length, base)
        starts = _tied_starts(own, marks, rank_buckets)
        block_id = left.column("block")[0].as_py()
        sent = _sent(block_id, own.prints(starts, length), tie_buckets)
        if not passage_words:
            return sent
        by_word = Words(own, passage_words)
        at = _tied_starts(by_word, marks, rank_buckets, rank_buckets)
        prints = by_word.once(by_word.prints(at, passage_words), at)
        return pa.concat_tables([sent, _sent(block_id, prints, tie_buckets, tie_buckets)])

    result = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("kept", rows.schema["kept"].dataType),
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType()),
        T.StructField("n_passages", T.LongType()), T.StructField("n_passage_bytes", T.LongType()),
        T.StructField("passages", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def mark_stage(left: pa.Table, right: pa.Table) -> pa.Table:
        marks, digests, number, own = _load(left, right, length, base)
        starts = _tied_starts(own, marks, rank_buckets)
        starts = starts[_incoming(own.prints(starts, length), marks["tie"], tie_buckets)]
        covered = _within(starts, starts + length, len(own.sums) + 1)
        texts = left.column("text").combine_chunks()
        found: list[list[tuple[int, int]]] = []
        if passage_words:
            by_word = Words(own, passage_words)
            at = _tied_starts(by_word, marks, rank_buckets, rank_buckets)
            found = by_word.passages(at[_incoming(by_word.prints(at, passage_words), marks["tie"], tie_buckets, tie_buckets)])
        out: list[list] = [[], [], [], [], [], [], [], [], []]
        for row, key in enumerate(digests):
            raw = texts[row].as_py()
            if key in marks["copy"] or key in marks["first"]:
                spans = [(0, len(raw))] if len(raw) >= length else []
                whole = [(len(raw) - len(raw.lstrip()), len(raw.rstrip()))]
                passages = whole if passage_words and len(raw.split()) >= passage_words else []
            else:
                lo = int(own.offsets[number[key]])
                spans = _spans(covered[lo:lo + len(raw)])
                passages = found[number[key]] if passage_words else []
            if words:
                spans = [(a, b) for a, b in spans if b - a >= long or len(raw[a:b].split()) >= words]
            left_over = _without(raw, spans)
            for column, value in zip(out, (
                    len(raw), len(raw) - len(left_over), len(spans), [{"start": a, "end": b} for a, b in spans],
                    hashlib.sha256(left_over).hexdigest(),
                    _without(raw, _whole_characters(raw, spans)).decode("utf-8", "replace") if with_text else None,
                    len(passages), sum(b - a for a, b in passages), [{"start": a, "end": b} for a, b in passages])):
                column.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), span_type, pa.string(), pa.string(), pa.int64(), pa.int64(), span_type)
        return pa.table([left.column("id"), left.column("kept"), *(pa.array(c, t) for c, t in zip(out, types))],
                        names=result.names)

    def staged(marks: DataFrame, stage: str) -> DataFrame:
        return marks.select("block", F.lit(stage).alias("stage"), "bucket", "marks")

    by_block = rows.groupBy("block")
    ranks = by_block.cogroup(copies.groupBy("block")).applyInArrow(freeing(rank_stage), SENT).groupBy("bucket").applyInArrow(freeing(_ties), MARKS)
    known = copies.unionByName(staged(ranks, "rank"))
    ties = by_block.cogroup(known.groupBy("block")).applyInArrow(freeing(tie_stage), SENT).groupBy("bucket").applyInArrow(freeing(_ties), MARKS)
    known = known.unionByName(staged(ties, "tie"))
    done = by_block.cogroup(known.groupBy("block")).applyInArrow(freeing(mark_stage), result)
    dropped = ([] if with_text else ["kept_text"]) + ([] if passage_words else ["n_passages", "n_passage_bytes", "passages"])
    return done.drop(*dropped, *([] if keep else ["kept"]))
