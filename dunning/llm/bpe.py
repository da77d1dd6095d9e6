"""Byte-level BPE encoding and decoding (segment tree over byte positions).

Every pre-token (one match of the split pattern) is encoded on its own. A
complete binary tree stands over its byte positions; the leaf of a live token's
first byte holds ``rank * size + position`` of the pair that this token forms
with its right neighbour (``INF`` when the pair is no token), an inner node the
smaller child. The root is therefore the leftmost pair of minimum rank. A merge
rewrites three leaves (the merged token, its left neighbour, the dead right
token) and their ancestors, so a pre-token of n bytes costs O(n log n) however
long it is.

Short pre-tokens are merged many at a time: one row of a matrix per distinct
pre-token, one merge per row and step. Long ones use the same tree on lists.

Scale: a map over the scan, no shuffle. Documents are taken in slices of
bounded characters. A text is first cut into chunks (a run of other characters
with at most one white-space character before it, or what is left of a longer
white-space run); no match of the split pattern crosses their borders, so a
worker can keep a bounded table of the chunks it has encoded (a speed-up only:
after the table is cleared, a chunk is encoded again).

Defined results: a null or empty text has 0 tokens, both hashes are those of the
empty string; a null id is passed through; repeated rows give repeated results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunning.llm.graph import freeing

INF = np.int64(2**62)
BATCH_BYTES = 32      # pre-tokens up to this many bytes are merged in matrices
BATCH_ROWS = 1 << 11  # rows of one matrix
SLICE_CHARS = 1 << 19
KNOWN_MAX = 400_000   # chunks a worker remembers
LONG_TEXT = 1 << 22   # texts above this are split by a streaming match


class Vocabulary:
    """Ranks of a vocabulary file and the pair table derived from them.

    A pair (left id, right id) may merge when the concatenated bytes are a
    token; the token's rank is both its priority and its id.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = rank
        self.pairs = pairs
        # the same table as arrays: open addressing, so that a matrix of pairs is looked up at once
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.mask = (1 << (4 * len(pairs)).bit_length()) - 1
        self.slot_key = np.full(self.mask + 1, -1, dtype=np.int64)
        self.slot_rank = np.full(self.mask + 1, -1, dtype=np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.slot_key[slot[todo]] == -1
            put = todo[free]
            self.slot_key[slot[put]] = keys[put]  # of those meeting in a slot the last stays
            done = self.slot_key[slot[todo]] == keys[todo]
            self.slot_rank[slot[todo[done]]] = values[todo[done]]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & self.mask
        self.byte_pair = np.full((256, 257), -1, dtype=np.int64)
        for a in range(256):
            for b in range(256):
                self.byte_pair[a, b] = ranks.get(bytes([a, b]), -1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the two tokens never merge."""
        key = (left << 32) | right
        slot = self._slot(key)
        out, seen = self.slot_rank[slot], self.slot_key[slot]
        todo = np.nonzero((seen != key) & (seen != -1))[0]
        out[seen != key] = -1
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            seen = self.slot_key[slot[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.slot_rank[slot[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
        return out


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def encode_long(vocab: Vocabulary, piece: bytes) -> list[int]:
    """Merge one pre-token on a segment tree held in lists."""
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    inf, pairs = int(INF), vocab.pairs
    tok = [int(vocab.byte_ids[b]) for b in piece]
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))
    tree = [inf] * (2 * size)

    def leaf(at: int) -> int:
        right = nxt[at]
        rank = pairs.get((tok[at] << 32) | tok[right]) if right < n else None
        return inf if rank is None else rank * size + at

    def put(at: int, value: int) -> None:
        node = at + size
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
            node >>= 1

    for i in range(n):
        tree[size + i] = leaf(i)
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while tree[1] < inf:
        rank, at = divmod(tree[1], size)
        dead = nxt[at]
        tok[at] = rank
        nxt[at] = nxt[dead]
        if nxt[dead] < n:
            prv[nxt[dead]] = at
        put(dead, inf)
        put(at, leaf(at))
        if prv[at] >= 0:
            put(prv[at], leaf(prv[at]))
    out, at = [], 0
    while at < n:
        out.append(tok[at])
        at = nxt[at]
    return out


def encode_rows(vocab: Vocabulary, pieces: list[bytes], size: int) -> list[list[int]]:
    """Merge pre-tokens of at most ``size`` bytes, a row of the matrices each."""
    m = len(pieces)
    lens = np.array([len(p) for p in pieces], dtype=np.int64)
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(m, size)
    # column `size` is a sentinel that no token pairs with
    tok = np.full((m, size + 1), np.int64(1) << 31, dtype=np.int64)
    tok[:, :size] = np.where(np.arange(size) < lens[:, None], vocab.byte_ids[raw], tok[:, :size])
    nxt = np.tile(np.minimum(np.arange(1, size + 2), size), (m, 1))
    prv = np.tile(np.arange(-1, size), (m, 1))
    tree = np.full((m, 2 * size), INF, dtype=np.int64)
    ends = np.where(np.arange(1, size + 1) < lens[:, None], np.pad(raw[:, 1:], ((0, 0), (0, 1))), 256)
    rank = vocab.byte_pair[raw, ends]
    tree[:, size:] = np.where(rank >= 0, rank * size + np.arange(size), INF)
    for lo in (1 << k for k in range(size.bit_length() - 2, -1, -1)):
        tree[:, lo:2 * lo] = np.minimum(tree[:, 2 * lo:4 * lo:2], tree[:, 2 * lo + 1:4 * lo:2])
    rows = np.nonzero(tree[:, 1] < INF)[0]
    while len(rows):
        rank, at = np.divmod(tree[rows, 1], size)
        dead = nxt[rows, at]
        after, before = nxt[rows, dead], prv[rows, at]
        tok[rows, at] = rank
        nxt[rows, at] = after
        prv[rows, after] = at
        right = vocab.pair_rank(rank, tok[rows, after])
        left = vocab.pair_rank(tok[rows, before], rank)
        nodes = []
        for pos, value in ((dead, INF), (at, np.where(right >= 0, right * size + at, INF))):
            tree[rows, size + pos] = value
            nodes.append((rows, (size + pos) >> 1))
        has = before >= 0
        r, b, v = rows[has], before[has], left[has]
        tree[r, size + b] = np.where(v >= 0, v * size + b, INF)
        nodes.append((r, (size + b) >> 1))
        for _ in range(size.bit_length() - 1):
            for i, (r, node) in enumerate(nodes):
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                nodes[i] = (r, node >> 1)
        rows = rows[tree[rows, 1] < INF]
    # live tokens in order: follow nxt from byte 0
    live = np.zeros((m, size + 1), dtype=bool)
    at, rows = np.zeros(m, dtype=np.int64), np.arange(m)
    while len(rows):
        live[rows, at] = True
        at = nxt[rows, at]
        more = at < lens[rows]
        rows, at = rows[more], at[more]
    counts = live.sum(axis=1)
    flat = tok[live].tolist()
    ends = np.cumsum(counts).tolist()
    return [flat[e - c:e] for e, c in zip(ends, counts.tolist())]


def encode_pieces(vocab: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """Token ids of each pre-token, which must not be empty."""
    out: list[list[int] | None] = [None] * len(pieces)
    by_size: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        rank = vocab.ranks.get(piece)
        if rank is not None:
            out[i] = [rank]
        elif len(piece) > BATCH_BYTES:
            out[i] = encode_long(vocab, piece)
        else:
            by_size.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
    for size, where in by_size.items():
        for lo in range(0, len(where), BATCH_ROWS):
            part = where[lo:lo + BATCH_ROWS]
            for i, ids in zip(part, encode_rows(vocab, [pieces[i] for i in part], size)):
                out[i] = ids
    return out


def decode(vocab: Vocabulary, ids: list[int]) -> bytes:
    table = vocab.bytes_of
    return b"".join([table[i] for i in ids])


# The characters of Unicode's White_Space property, as in the pattern's \s.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{SPACE}]?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])")


def _numbers(ids: bytes) -> np.ndarray:
    return np.array(ids.split(b",") if ids else [], dtype=np.int32)


class Encoder:
    """Encodes texts of one worker; remembers a bounded number of chunks."""

    def __init__(self, path: str, pattern: str, keep_ids: bool = False, remembered: int = KNOWN_MAX):
        import regex

        self.keep_ids, self.remembered = keep_ids, remembered
        self.vocab = load_vocabulary(path)
        self.match = regex.compile(pattern)
        self.ids: dict[str, bytes] = {}
        self.raw: dict[str, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.ids]
        if len(self.ids) + len(new) > self.remembered and self.ids:
            self.ids.clear()
            self.raw.clear()
            new = list(chunks)
        split = [self.match.findall(c) for c in new]
        pieces = list(set().union(*split))
        ids = dict(zip(pieces, encode_pieces(self.vocab, [p.encode() for p in pieces])))
        for chunk, parts in zip(new, split):
            own = ids[parts[0]] if len(parts) == 1 else [i for p in parts for i in ids[p]]
            self.ids[chunk] = ",".join(map(str, own)).encode()
            self.raw[chunk] = decode(self.vocab, own)

    def result(self, chunks: list[str]) -> tuple[int, str, str, np.ndarray | None]:
        """(number of ids, SHA-256 of the ids as text, SHA-256 of the decoded bytes, ids if kept)."""
        ids = b",".join(map(self.ids.__getitem__, chunks))
        raw = b"".join(map(self.raw.__getitem__, chunks))
        return (ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest(),
                _numbers(ids) if self.keep_ids else None)

    def streamed(self, text: str) -> tuple[int, str, str, np.ndarray | None]:
        """As ``result`` for a very long text, holding a part of its chunks at a time."""
        n, ids_hash, raw_hash, found, kept = 0, hashlib.sha256(), hashlib.sha256(), CHUNK.finditer(text), []
        while part := [m.group() for m in islice(found, 100_000)]:
            self.learn(set(part))
            ids = b",".join([self.ids[p] for p in part])
            ids_hash.update(b"," + ids if n else ids)
            raw_hash.update(b"".join([self.raw[p] for p in part]))
            n += ids.count(b",") + 1
            if self.keep_ids:
                kept.append(_numbers(ids))
        return n, ids_hash.hexdigest(), raw_hash.hexdigest(), np.concatenate(kept) if kept else None

    def many(self, texts: list[str]) -> Iterator[tuple[int, str, str, np.ndarray | None]]:
        lo = 0
        while lo < len(texts):
            if len(texts[lo]) > LONG_TEXT:
                yield self.streamed(texts[lo])
                lo += 1
                continue
            hi, chars = lo, 0
            while hi < len(texts) and chars < SLICE_CHARS and len(texts[hi]) <= LONG_TEXT:
                chars += len(texts[hi])
                hi += 1
            split = [CHUNK.findall(t) for t in texts[lo:hi]]
            self.learn(set().union(*split))
            yield from map(self.result, split)
            lo = hi


def encode_and_decode(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id",
                      text_col: str = "text", with_ids: bool = False, remembered: int = KNOWN_MAX) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``ids_sha256`` (SHA-256 of the decimal ids joined by
    commas), ``decoded_sha256`` (of the decoded bytes) and, with ``with_ids``, the ``ids``. A worker
    remembers ``remembered`` chunks at most: fewer take less memory and more time."""
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    types = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * with_ids

    def run(batches):
        encoder = Encoder(vocabulary_path, pattern, with_ids, remembered)
        for batch in batches:
            columns = list(zip(*encoder.many([t or "" for t in batch.column(1).to_pylist()]))) or [()] * 4
            if with_ids:
                columns[3] = [x if x is not None else [] for x in columns[3]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType()))][:4 + with_ids])
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(freeing(run), schema)


def token_ids(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``ids``."""
    return encode_and_decode(docs, vocabulary_path, pattern, id_col, text_col, with_ids=True).select(id_col, "ids")


def decode_ids(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Inverse of ``token_ids``: one row per document with ``text`` (null ids: empty).
    Bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        vocab = load_vocabulary(vocabulary_path)
        for batch in batches:
            texts = [decode(vocab, ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return encoded.select(id_col, ids_col).mapInArrow(run, schema)
