"""Set-similarity join on word n-grams by vertical partitioning.

A text's set holds its distinct n-grams of words (ASCII-lower-cased runs of
non-space characters); two texts link when 100 * overlap >= threshold * union.

1. Every n-gram is a 64-bit fingerprint. Its top 16 bits name a bin; the bins'
   document counts (65,536 numbers, whatever the input) rank the bins from rare
   to frequent, and (bin rank, fingerprint) is the global n-gram order: an
   n-gram that very many texts share lies in a heavy bin and comes last.
2. Texts with equal sets form one class (a node); classes are joined, not texts.
3. Candidates share an n-gram of both prefixes (the rarest n - ceil(t n) + 1)
   and pass the length and position bounds there. Prefix n-grams go to hash
   buckets as packed arrays, copies collapsed per task. In a bucket each class
   is paired with the next class of every n-gram (by size); n-grams with more
   classes hand their members to step 6.
4. A class carries the parity bits of its n-grams (4 bits an n-gram): two sets
   differ in at least as many n-grams as their bits differ, so a pair whose bits
   differ too much is no link. What is left is counted: the global order is cut
   into fragments of equal mass, a candidate's set is cut at the same borders,
   partial overlaps are counted in each fragment on their own and summed per
   pair; a pair links when the sum reaches threshold (|a| + |b|) / (100 + threshold).
5. Links give connected components.
6. Exact remainder: groups of the same classes, as the n-grams of one shared
   passage have them, are taken once, at the first of their n-grams. Members of
   larger n-gram groups that now span several components are
   compared across components only, in blocks of bounded size,
   by the same bounds and by sketches (parity bits folded to one bit an n-gram,
   4,096 at most, so what a member carries does not grow with a long text); what
   passes meets the whole parity bits pair by pair. First every component sends
   only its most similar pair, and again (4 times at most) if most of what was sent links; then every
   pair across components that is still possible is counted as in 4. Pairs
   inside one component can't change it, so a group of near copies is never
   squared. Groups are cut where the sizes leap too far for a link across.

Nothing is capped. Driver-side state: the 65,536 bin counts and a 2^25-bit
filter of candidate classes (it only spares shuffling sets that surely have no
candidate; false positives are dropped by the join).

Fingerprints and text digests are 64-bit (a digest only chooses the texts to look at
again): two different n-grams of one pair of texts meet with
probability about |a| |b| / 2^64.

Defined results: null, empty or word-less texts have 0 n-grams and link with
nothing; texts of fewer than n words have one n-gram, their whole sequence;
repeated rows give repeated results; a row with a null id takes part, its class
is named by the smallest id that is not null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunning.llm.graph import components, cut, freeing, release

BINS = 1 << 16
NEXT = 1                 # classes that step 3 pairs each class with
BUCKET_GRAMS = 400_000   # prefix n-grams of one bucket
FRAGMENTS = 4
BLOCK_MEMBERS = 2048     # members of an n-gram group that one task compares with as many
NEAREST_PASSES = 4       # passes of step 6 in which components send their most similar pair only
SKETCH_LEAST = 8         # 64-bit words of parity bits that a member of step 6 carries, if it has as many
SKETCH_WORDS = 64        # and at most
PAIR_WORDS = 1 << 18     # words compared at a time
HELD_PAIRS = 200_000     # pairs a task of step 6 gathers before it drops the worse and repeated ones
FILTER_BITS = 1 << 25
SLICE_BYTES = 4 << 20    # text handled at a time


def _mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit (multiply and xor-shift)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram fingerprints of each text."""
    import xxhash

    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = pc.list_flatten(words).dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()] or [0], dtype=np.uint64)
    codes = flat.indices.to_numpy(zero_copy_only=False)
    empty = flat.dictionary.index("").as_py()
    keep = codes != empty
    hashes = table[codes[keep]]
    ends = np.cumsum(np.concatenate([[0], keep]))[np.asarray(words.offsets) - words.offsets[0].as_py()]
    power = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, n + 1)]
    rolled = np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64)
    for k in range(n):
        rolled += hashes[k:k + len(rolled)] * power[k]
    rolled = _mix(rolled)
    out = []
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if hi - lo >= n:
            out.append(np.unique(rolled[lo:hi - n + 1]))
        elif hi > lo:
            part = sum((hashes[lo + k:lo + k + 1] * power[k] for k in range(hi - lo)), np.zeros(1, np.uint64))
            out.append(_mix(part + np.uint64(hi - lo)))
        else:
            out.append(rolled[:0])
    return out


def _node(grams: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes(), seed=1)).astype(np.int64))


def _digests(texts: pa.Array) -> np.ndarray:
    """64-bit digest of each text's bytes."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(t or b"") for t in texts.cast(pa.binary()).to_pylist()], dtype="u8").view("i8")


def _slices(batches):
    """(ids, texts) of bounded bytes from Arrow batches."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // SLICE_BYTES
        for cutoff in np.unique(part):
            at = np.nonzero(part == cutoff)[0]
            yield batch.slice(at[0], len(at))


def _parity(grams: np.ndarray) -> bytes:
    """Bit k: parity of the number of n-grams that are k modulo the width (a power of two, 4 bits an n-gram at least)."""
    width = 1 << max(6, (4 * len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parity bits (rows of 64-bit words) at a smaller width."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def _possible(bits_a: bytes, bits_b: bytes, na: int, nb: int, threshold: int) -> bool:
    x, y = np.frombuffer(bits_a, dtype="u8")[None], np.frombuffer(bits_b, dtype="u8")[None]
    words = min(x.shape[1], y.shape[1])
    differ = int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum())
    return na + nb - differ >= 2 * _needed(na, nb, threshold)


def _needed(na, nb, threshold: int):
    """Least overlap of a link: ceil(threshold * (na + nb) / (100 + threshold))."""
    return -((-threshold * (na + nb)) // (100 + threshold))


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """(id, node, text, grams, bits, bins): a row per document (text is a digest), and a row per task with its bin counts."""

    def run(batches):
        bins = np.zeros(BINS, dtype=np.int64)
        schema = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("text", pa.int64()), ("grams", pa.int64()), ("bits", pa.binary()),
                            ("bins", pa.binary())])
        seen: set[int] = set()
        for part in _slices(batches):
            sets = gram_sets(part.column(1), n)
            if sets:
                bins += np.bincount(np.concatenate(sets) >> np.uint64(48), minlength=BINS)
            nodes = [_node(s) if len(s) else None for s in sets]
            bits = []
            for node, grams in zip(nodes, sets):  # once per class and task, while the table of classes is small
                bits.append(_parity(grams) if node is not None and node not in seen else None)
                if node is not None and len(seen) < 1_000_000:
                    seen.add(node)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(nodes, pa.int64()), pa.array(_digests(part.column(1))), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(bits, pa.binary()), pa.nulls(len(sets), pa.binary())], schema=schema)
        void = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([void, void, void, void, pa.nulls(1, pa.binary()), pa.array([bins.tobytes()], pa.binary())], schema=schema)

    return docs.mapInArrow(freeing(run), "id long, node long, text long, grams long, bits binary, bins binary")


def _bin_counts(scan: DataFrame) -> np.ndarray:
    def add(batches):
        total = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(total)[0], pa.int64()), pa.array(total[total > 0])],
                                         names=["bin", "n"])

    rows = (scan.where(F.col("bins").isNotNull()).select("bins").mapInArrow(add, "bin long, n long")
            .groupBy("bin").agg(F.sum("n").alias("n")).collect())  # at most 65,536 rows
    counts = np.zeros(BINS, dtype=np.int64)
    for row in rows:
        counts[row["bin"]] = row["n"]
    return counts


def _ordered(grams: np.ndarray, bin_rank: np.ndarray) -> np.ndarray:
    """The same n-grams as keys of the global order, sorted."""
    low = grams & np.uint64((1 << 48) - 1)
    return np.sort((bin_rank[grams >> np.uint64(48)] << np.uint64(48)) | low)


PACKED = {"gram": "u8", "node": "i8", "size": "u4", "pos": "u4"}


def _prefixes(docs: DataFrame, n: int, threshold: int, bin_rank: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, gram, node, size, pos): packed prefix n-grams, one row per slice and bucket."""

    def run(batches):
        seen: set[int] = set()
        for part in _slices(batches):
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for grams in gram_sets(part.column(1), n):
                if not len(grams) or (node := _node(grams)) in seen:
                    continue
                if len(seen) < 1_000_000:  # only spares repeats; buckets collapse the rest
                    seen.add(node)
                size = len(grams)
                prefix = _ordered(grams, bin_rank)[:size + (-threshold * size) // 100 + 1]
                for column, value in zip(columns, (prefix, np.full(len(prefix), node, "i8"),
                                                   np.full(len(prefix), size, "u4"), np.arange(len(prefix), dtype="u4"))):
                    column.append(value)
            if not columns[0]:
                continue
            arrays = [np.concatenate(c) for c in columns]
            bucket = _mix(arrays[0]) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            arrays, bucket = [a[order] for a in arrays], bucket[order]
            found, first = np.unique(bucket, return_index=True)
            ends = np.append(first[1:], len(bucket))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.astype("i8"))] + [pa.array([a[i:j].tobytes() for i, j in zip(first, ends)], pa.binary())
                                                  for a in arrays],
                names=["bucket", *PACKED])

    return docs.mapInArrow(freeing(run), "bucket long, gram binary, node binary, size binary, pos binary")


def _pairs(prefixes: DataFrame, threshold: int) -> DataFrame:
    """Rows (a, b, na, nb) of candidates, and rows (gram, a, na, pos) of members left to step 6,
    where gram names an n-gram and a run of its classes' sizes without a leap."""
    schema = pa.schema([("gram", pa.int64()), ("a", pa.int64()), ("na", pa.int64()), ("pos", pa.int64()),
                        ("b", pa.int64()), ("nb", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        gram, node, size, pos = (np.frombuffer(b"".join(table.column(k).to_pylist()), dtype=d) for k, d in PACKED.items())
        order = np.argsort(gram)
        again = gram[order][1:] == gram[order][:-1]
        shared = np.zeros(len(gram), dtype=bool)
        shared[order[1:][again]] = shared[order[:-1][again]] = True
        gram, node, size, pos = (x[shared] for x in (gram, node, size.astype("i8"), pos.astype("i8")))
        order = np.lexsort((node, size, gram))
        gram, node, size, pos = (x[order] for x in (gram, node, size, pos))
        if len(gram):  # copies from other tasks
            new = np.append(True, (gram[1:] != gram[:-1]) | (node[1:] != node[:-1]))
            gram, node, size, pos = (x[new] for x in (gram, node, size, pos))
        found = []
        for k in range(1, NEXT + 1):
            i = np.nonzero(gram[k:] == gram[:-k])[0] if len(gram) > k else np.zeros(0, "i8")
            j = i + k
            need = _needed(size[i], size[j], threshold)
            ok = 1 + np.minimum(size[i] - pos[i] - 1, size[j] - pos[j] - 1) >= need
            found.append(np.stack([node[i][ok], node[j][ok], size[i][ok], size[j][ok]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        apart = gram[1:] != gram[:-1]  # a group ends where sizes leap too far for any link across
        starts = np.nonzero(np.append(True, apart | (100 * size[:-1] < threshold * size[1:])))[0] if len(gram) else np.zeros(0, "i8")
        count = np.diff(np.append(starts, len(gram)))
        rest = np.repeat(count > NEXT + 1, count)
        gram = _mix(gram + np.repeat(size[starts], count).view("u8"))
        n_pairs, n_rest = pairs.shape[1], int(rest.sum())
        void = lambda k: pa.nulls(k, pa.int64())
        return pa.concat_tables([
            pa.Table.from_arrays([void(n_pairs), pa.array(pairs[0]), pa.array(pairs[2]), void(n_pairs),
                                  pa.array(pairs[1]), pa.array(pairs[3])], schema=schema),
            pa.Table.from_arrays([pa.array(gram[rest].view("i8")), pa.array(node[rest]), pa.array(size[rest]),
                                  pa.array(pos[rest]), void(n_rest), void(n_rest)], schema=schema)])

    return prefixes.groupBy("bucket").applyInArrow(freeing(run), "gram long, a long, na long, pos long, b long, nb long")


def _distinct_groups(members: DataFrame) -> DataFrame:
    """The members without those of n-grams whose group has the same classes as that of an n-gram before it: positions
    are smaller there in every class, so the bounds pass whatever pair they pass in a later group. Groups are
    compared by their number of classes and 128 bits."""
    sets = members.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                       F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.sum("pos").alias("pos"))
    first = sets.groupBy("n", "x", "y").agg(F.min(F.struct("pos", "gram")).alias("first")).select("first.gram")
    return members.join(first, "gram", "left_semi")


def _likely(pairs: DataFrame, bits: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose parity bits allow a link."""
    names = ["a", "b", "na", "nb"]
    both = (pairs.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("bits_a")), "a")
            .join(bits.select(F.col("node").alias("b"), F.col("bits").alias("bits_b")), "b").select(*names, "bits_a", "bits_b"))

    def run(batches):
        for batch in batches:
            na, nb, x, y = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            ok = [_possible(*row, threshold) for row in zip(x, y, na, nb)]
            yield batch.select(names).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(freeing(run), "a long, b long, na long, nb long")


def _sketch(bits: bytes) -> bytes:
    """Parity bits folded to about one bit an n-gram, but ``SKETCH_LEAST`` to ``SKETCH_WORDS`` words. Folding keeps the bound."""
    whole = np.frombuffer(bits, dtype="u8")
    return _folded(whole[None], min(len(whole), max(SKETCH_LEAST, min(len(whole) // 4, SKETCH_WORDS))))[0].tobytes()


def _sketches(bits: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_sketch(b) for b in batch.column(1).to_pylist()], pa.binary())],
                                             names=["node", "sketch"])

    return bits.select("node", "bits").mapInArrow(freeing(run), "node long, sketch binary")


def _differ(flat: np.ndarray, start: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Differing sketch bits of rows i and j, the wider sketch folded to the narrower one."""
    out = np.zeros(len(i), dtype="i8")
    for wi, wj in set(zip(words[i].tolist(), words[j].tolist())) if len(i) < 64 else np.unique(np.stack([words[i], words[j]]), axis=1).T.tolist():
        at = np.nonzero((words[i] == wi) & (words[j] == wj))[0]
        w, step = min(wi, wj), max(1, PAIR_WORDS // max(wi, wj))
        for k in range(0, len(at), step):
            part = at[k:k + step]
            x = _folded(flat[start[i[part]][:, None] + np.arange(wi)], w)
            y = _folded(flat[start[j[part]][:, None] + np.arange(wj)], w)
            out[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype="i8")
    return out


def _across(members: DataFrame, threshold: int, best: bool, buckets: int) -> DataFrame:
    """(a, b, na, nb): pairs of classes of different components in one n-gram's group that
    pass the bounds and whose sketches allow a link; with ``best``, of every component
    only the most similar pair that it takes part in. Large groups are dealt in pairs of blocks; a task takes the
    blocks of one bucket, sorted by size, and compares rows k apart, all groups at once, for
    k = 1, 2, ... until no row has a partner of fitting size left."""
    names = ["a", "b", "na", "nb"]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        gram, lo, hi, block, node, size, pos, root = (table.column(k).to_numpy() for k in
                                                      ("gram", "lo", "hi", "block", "node", "size", "pos", "root"))
        order = np.lexsort((node, size, hi, lo, gram))
        raw = table.column("sketch").to_pylist()
        words = np.array([len(b) // 8 for b in raw], dtype="i8")
        start = (np.cumsum(words) - words)[order]
        flat, words = np.frombuffer(b"".join(raw), dtype="u8"), words[order]
        del raw
        gram, lo, hi, block, node, size, pos, root = (x[order] for x in (gram, lo, hi, block, node, size, pos, root))
        new = np.append(True, (gram[1:] != gram[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
        group = np.cumsum(new)
        found, held = [], 0

        def best_of(rows: np.ndarray) -> np.ndarray:
            """The distinct pairs, or the most similar one of every component."""
            if best:
                ends = np.concatenate([rows, rows], axis=1)
                own = np.concatenate([rows[5], rows[6]])
                by = np.lexsort((ends[2], ends[1], ends[0], own))
                own = own[by]
                rows = ends[:, by][:, np.append(True, own[1:] != own[:-1])]
            rows = rows[:, np.lexsort((rows[2], rows[1]))]
            return rows[:, np.append(True, (rows[1:3, 1:] != rows[1:3, :-1]).any(axis=0))]

        i, k = np.arange(len(group)), 0
        while len(i):
            k += 1
            i = i[i + k < len(group)]
            j = i + k
            fits = (group[i] == group[j]) & (100 * size[i] >= threshold * size[j])  # sizes ascend: who fails once fails from here on
            i = i[fits]
            j = i + k
            need = _needed(size[i], size[j], threshold)
            ok = ((root[i] != root[j]) & ((lo[i] == hi[i]) | (block[i] != block[j]))
                  & (1 + np.minimum(size[i] - pos[i] - 1, size[j] - pos[j] - 1) >= need))
            x, y, need = i[ok], j[ok], need[ok]
            d = _differ(flat, start, words, x, y)
            ok = size[x] + size[y] - d >= 2 * need
            x, y, d = x[ok], y[ok], d[ok]
            if len(x):
                swap = (size[x] == size[y]) & (node[x] > node[y])
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                found.append(np.stack([d, node[x], node[y], size[x], size[y], np.minimum(root[x], root[y]), np.maximum(root[x], root[y])]))
                held += len(x)
                if held > HELD_PAIRS:
                    found = [best_of(np.concatenate(found, axis=1))]
                    held = -found[0].shape[1]
        rows = best_of(np.concatenate(found, axis=1)) if found else np.zeros((7, 0), dtype="i8")
        return pa.table([pa.array(row) for row in rows], names=["d", *names, "r", "s"])

    blocks = members.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS).cast("long").alias("blocks"))
    dealt = (members.join(blocks, "gram").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
             .select(F.pmod(F.xxhash64("gram", "lo", "hi"), F.lit(buckets)).alias("bucket"), "gram", "lo", "hi", "block", "node", "size",
                     "pos", "root", "sketch"))
    found = dealt.groupBy("bucket").applyInArrow(freeing(run), "d long, a long, b long, na long, nb long, r long, s long")
    if best:
        found = (found.select(F.explode(F.array("r", "s")).alias("own"), F.struct("d", *names).alias("pair"))
                 .groupBy("own").agg(F.min("pair").alias("pair")).select("pair.*"))
    return found.select(*names).distinct()


def _filter_bits(texts: DataFrame) -> np.ndarray:
    """2^25-bit filter of a column of text digests, merged by word on the executors."""
    bit = F.pmod(F.col("text"), F.lit(FILTER_BITS))
    words = (texts.select(F.floor(bit / 64).cast("long").alias("word"), F.pmod(bit, F.lit(64)).cast("int").alias("bit"))
             .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas())
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bits[words["word"].to_numpy(dtype="i8")] = words["bits"].to_numpy(dtype="i8")
    return bits


def _segments(docs: DataFrame, nodes: DataFrame, classes: DataFrame, n: int, bin_rank: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(part, grams), part = struct(node, fragment): the sets of the classes in ``nodes``, cut at
    the fragments' borders. Only texts whose digest may be that of such a class are cut into
    n-grams. One exchange on ``part`` serves the join with either end of a pair."""
    wanted = cut(nodes.select("node").distinct().join(classes.select("node", "text"), "node"))
    bits = _filter_bits(wanted)

    def run(batches):
        seen: set[int] = set()
        for part in _slices(batches):
            digests = _digests(part.column(1))
            at = digests % FILTER_BITS
            chosen = np.nonzero((bits[at // 64] >> (at % 64)) & 1)[0]
            if not len(chosen):
                continue
            rows = []
            for grams in gram_sets(part.column(1).take(pa.array(chosen)), n):
                if not len(grams) or (node := _node(grams)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                keys = _ordered(grams, bin_rank)
                rows += [(node, f, s.view("i8")) for f, s in enumerate(np.split(keys, np.searchsorted(keys, pivots))) if len(s)]
            if rows:
                node, fragment, grams = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(fragment, pa.int32()),
                                                  pa.array(grams, pa.list_(pa.int64()))], names=["node", "fragment", "grams"])

    found = docs.mapInArrow(freeing(run), "node long, fragment int, grams array<long>")
    return (found.select(F.struct("node", "fragment").alias("part"), "grams")
            .join(wanted.select(F.explode(_parts("node")).alias("part")), "part", "left_semi").dropDuplicates(["part"]))


def _parts(node: str):
    """struct(node, fragment) of every fragment."""
    return F.array(*[F.struct(F.col(node).alias("node"), F.lit(f).alias("fragment")) for f in range(FRAGMENTS)])


def _links(docs: DataFrame, pairs: DataFrame, classes: DataFrame, n: int, threshold: int, bin_rank: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """Pairs whose overlaps, counted fragment by fragment and summed, reach the threshold."""
    segments = _segments(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")), classes, n, bin_rank, pivots)
    left, right = (segments.select(F.col("part").alias(f"part_{x}"), F.col("grams").alias(f"grams_{x}")) for x in "ab")
    each = pairs.select("*", F.posexplode(F.arrays_zip(_parts("a").alias("a"), _parts("b").alias("b"))).alias("k", "ends"))
    each = each.select("a", "b", "na", "nb", F.col("ends.a").alias("part_a"), F.col("ends.b").alias("part_b"))
    parts = (each.join(left, "part_a").join(right, "part_b")
             .select("a", "b", "na", "nb", F.size(F.array_intersect("grams_a", "grams_b")).alias("overlap")))
    summed = parts.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    return summed.where((100 + threshold) * F.col("overlap") >= threshold * (F.col("na") + F.col("nb"))).select("a", "b")


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                    threshold: int = 80) -> DataFrame:
    """One row per document: id, ``n_shingles`` (size of its set), ``class_id``
    (null for an empty set; equal sets, equal class), ``component_id`` (smallest
    id reachable by links, itself included)."""
    if docs.schema[id_col].dataType not in (T.LongType(), T.IntegerType()):
        raise TypeError(f"{id_col} must be an integer column")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scan = cut(_scan(texts, n))
    rows = cut(scan.where(F.col("bins").isNull()).select("id", "node", "grams"))
    classes = cut(scan.where(F.col("bits").isNotNull()).groupBy("node").agg(F.min("text").alias("text"), F.first("bits").alias("bits")))
    counts = _bin_counts(scan)
    del scan  # its parity bits: ``classes`` holds them once per class
    release(spark)
    bin_rank = np.empty(BINS, dtype=np.uint64)
    by_count = np.lexsort((np.arange(BINS), counts))
    bin_rank[by_count] = np.arange(BINS, dtype=np.uint64)
    mass = np.cumsum(counts[by_count])
    ranks = np.searchsorted(mass, mass[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS)
    pivots = np.unique(ranks).astype(np.uint64) << np.uint64(48)
    prefix_grams = int(counts.sum()) * (100 - threshold) // 100
    buckets = max(16, prefix_grams // BUCKET_GRAMS)

    found = cut(_pairs(_prefixes(texts, n, threshold, bin_rank, buckets), threshold))
    release(spark)
    members = cut(_distinct_groups(found.where(F.col("gram").isNotNull())
                                   .select("gram", F.col("a").alias("node"), F.col("na").alias("size"), "pos")))
    pairs = cut(_likely(found.where(F.col("gram").isNull()).select("a", "b", "na", "nb").distinct(), classes, threshold))
    del found
    release(spark)
    links = cut(_links(texts, pairs, classes, n, threshold, bin_rank, pivots))
    roots = components(links)
    release(spark)

    sketches = cut(_sketches(classes).join(members.select("node").distinct(), "node", "left_semi"))
    best, passes = True, 0
    while True:
        passes += 1
        labelled = members.join(roots, "node", "left").select("gram", "node", "size", "pos", F.coalesce("root", "node").alias("root"))
        spread = labelled.groupBy("gram").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("gram")
        open_members = labelled.join(spread, "gram", "left_semi").join(sketches, "node")
        across = _across(open_members, threshold, best, buckets).join(pairs, ["a", "b", "na", "nb"], "left_anti")
        more = cut(_likely(across, classes, threshold))
        release(spark)
        sent, linked = more.count(), 0
        if sent:
            new = cut(_links(texts, more, classes, n, threshold, bin_rank, pivots))
            linked = new.count()
            pairs = pairs.union(more)
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new))
        release(spark)
        if not best:
            break
        best = 0 < sent <= 2 * linked and passes < NEAREST_PASSES

    firsts = (rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("first"))
              .join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    named = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    firsts = firsts.join(named, "root").select("node", "component_id")
    return (rows.join(firsts, "node", "left")
            .select(F.col("id").alias(id_col), F.coalesce("grams", F.lit(0)).cast("long").alias("n_shingles"),
                    F.col("node").alias("class_id"), F.coalesce("component_id", "id").alias("component_id")))
