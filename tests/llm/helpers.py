"""Small tables and brute-force versions for the corpus operators."""

from __future__ import annotations

import hashlib
import random

CLASHES = ("id", "node", "block", "bucket", "digest", "key", "kept", "stage", "marks", "part", "grp", "rank", "total", "n",
           "n_words", "words", "lines", "hash", "range", "source_", "spans", "toxic", "score", "copy_no", "_mix_n", "_row", "url_", "low")


def documents(spark, rows, extra: bool = True):
    """documents table of (doc_id, text, source); with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)]) if extra else df


def prose(rng: random.Random, n: int, vocabulary: int = 40) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) >= 5:
        return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    return frozenset([tuple(words)] if words else [])


def jaccard_components(rows):
    """doc_id -> (set size, smallest linked id); all pairs."""
    sets = [(i, shingles(t)) for i, t, _ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, r in sets[:a]:
            if s and r and 100 * len(s & r) >= 80 * len(s | r):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def without_repeats(texts, length):
    """[(n_bytes, n_removed, n_spans, sha256 of the rest)] by comparing all strings of ``length`` bytes."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for p in range(len(b) - length + 1):
            seen[b[p:p + length]] = seen.get(b[p:p + length], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
