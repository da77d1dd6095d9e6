"""Operators 1, 2, 3 and 6 against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from dunning.llm import graph, line_dedup, ngram_join, queries, suffix_dedup, topk
from tests.llm.helpers import documents, jaccard_components, prose, without_repeats


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 440)] + [(7, 7), (None, 1)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


def near_copies(rng):
    rows = [(0, None, "a"), (1, "", "a"), (2, " \n\t ", "a"), (3, "one two", "a"), (4, "One\vTWO", None), (5, "one two three", "b"),
            (6, "a b c d e", "b"), (7, "A b c d e", "b"), (8, "a b c d e", "b")]
    common = prose(rng, 30, 1000)
    for base in range(5):
        words = prose(rng, 60, 1000).split()
        for k in range(9):
            text = list(words)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((100 + base * 20 + k, " ".join(text), "c"))
    rows += [(300 + k, common + " " + prose(rng, 6 + k, 10 ** 6), "d") for k in range(12)]
    rows += [(400 + k, " ".join(["same words again and again"] * 30), "e") for k in range(7)]
    rows += [(9, "repeated row here it is", "f")] * 2
    return rows


def test_ngram_join_matches_all_pairs(spark, monkeypatch):
    rows = near_copies(random.Random(5))
    truth = jaccard_components(rows)
    for budget, block in ((1 << 20, 2048), (200, 3)):  # one bucket, many buckets and blocks
        monkeypatch.setattr(ngram_join, "BUCKET_GRAMS", budget)
        monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", block)
        got = [r.asDict() for r in ngram_join.similarity_join(documents(spark, rows).repartition(3)).collect()]
        assert len(got) == len(rows)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == truth
    empty = {r["doc_id"]: r for r in got}
    assert empty[0]["n_shingles"] == 0 and empty[2]["component_id"] == 2 and empty[1]["class_id"] is None
    assert empty[3]["component_id"] == empty[4]["component_id"] == 3


def test_ngram_join_compares_a_shared_passage_once(spark, monkeypatch):
    rng = random.Random(11)
    passage = prose(rng, 14, 10 ** 6)
    rows = [(k, passage + " " + prose(rng, 200 + k, 10 ** 6), "s") for k in range(6)]
    rows += [(20 + k, rows[k][1] + f" end{k}", "s") for k in range(3)]
    groups, across = [], ngram_join._across

    def counted(members, *rest):
        groups.append(members.select("gram").distinct().count())
        return across(members, *rest)

    monkeypatch.setattr(ngram_join, "_across", counted)
    counts = np.ones(ngram_join.BINS, dtype=np.int64)  # the passage's n-grams are the rarest: all lie in every prefix
    counts[ngram_join.gram_sets(pa.array([passage]), 5)[0] >> np.uint64(48)] = 0
    monkeypatch.setattr(ngram_join, "_bin_counts", lambda scan: counts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_join(documents(spark, rows)).collect()}
    assert got == jaccard_components(rows)
    assert groups and max(groups) == 1  # 10 n-grams of the passage, all with the same classes


def test_equal_groups_keep_the_first_ngram(spark):
    members = [(1, 7, 50, 3), (1, 8, 60, 9), (2, 7, 50, 2), (2, 8, 60, 4), (3, 7, 50, 1), (4, 8, 60, 0), (4, 9, 61, 0), (4, 7, 50, 0)]
    got = ngram_join._distinct_groups(spark.createDataFrame(members, "gram long, node long, size long, pos long")).collect()
    assert {tuple(r) for r in got} == {m for m in members if m[0] != 1}


def test_components_of_few_edges_run_in_few_tasks(spark, monkeypatch):
    cut, parts = graph.cut, []

    def counted(df):
        done = cut(df)
        parts.append(done.rdd.getNumPartitions())
        return done

    monkeypatch.setattr(graph, "cut", counted)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long")
        assert {r["root"] for r in graph.components(links).collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(parts) > 2 and max(parts[1:]) <= spark.sparkContext.defaultParallelism


def test_ngram_join_null_id_and_empty_table(spark):
    rows = [(None, "a b c d e f", "s"), (8, "a b c d e f", "s"), (None, "alone it stands here now", "s")]
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.similarity_join(documents(spark, rows)).collect()}
    assert got == {(None, 8), (8, 8), (None, None)}
    assert ngram_join.similarity_join(documents(spark, [])).collect() == []


def test_difference_cover_meets_every_shift():
    for length in (1, 5, 20, 60, 120, 400):
        v, cover = suffix_dedup.difference_cover(length)
        inside = set(cover.tolist())
        assert all(any((a + s) % v in inside and (a + d + s) % v in inside for s in range(v)) for a in range(v) for d in range(v))
        assert length - v + 1 >= 1


@pytest.mark.parametrize("length", [20, 400])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, length):
    rng = random.Random(length)
    shared = ["".join(rng.choice("abcé") for _ in range(length * 2)) for _ in range(3)]
    texts = [None, "", "short", "z" * (length * 3), "z" * length, "y" * length, "y" * (length - 1)]
    for _ in range(25):
        text = ""
        for _ in range(rng.randrange(1, 5)):
            part = rng.choice(shared)
            lo = rng.randrange(length)
            text += part[lo:lo + rng.randrange(length * 2)] + "".join(rng.choice("abcé") for _ in range(rng.randrange(length)))
        texts.append(text)
    texts += texts[-3:] + [texts[-1]] * 4
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 300)
    monkeypatch.setattr(suffix_dedup, "BUCKET_PRINTS", 50)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(documents(spark, rows), length=length, keep=["lang"], with_text=True).collect()}
    truth = without_repeats(texts, length)
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in got.items()} == dict(enumerate(truth))
    for k, r in got.items():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and r["kept"]["lang"] == "en"
        assert "�" not in r["kept_text"] and len(r["kept_text"].encode()) >= r["n_bytes"] - r["n_removed"]


def test_suffix_dedup_empty_table_and_null_ids(spark):
    assert suffix_dedup.remove_repeats(documents(spark, []), length=20).collect() == []
    rows = [(None, "q" * 30, "s"), (None, "abc", "s")]
    got = sorted(suffix_dedup.remove_repeats(documents(spark, rows), length=20).drop("spans").collect(), key=lambda r: r["n_bytes"])
    assert [(r["doc_id"], r["n_removed"]) for r in got] == [(None, 0), (None, 30)]


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(9)
    lines = [prose(rng, n, 30) for n in (3, 5, 8, 60)] + ["Same  LINE with five words", "same line with FIVE\twords "]
    rows = [(0, None, "s"), (1, "", "s"), (None, "same line with five words\nnew one", "s"), (2, "\n\n", "s"), (2, "\n\n", "s")]
    rows += [(10 + k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9))), "s") for k in range(30)]
    got = {(r["doc_id"]): r for r in line_dedup.remove_repeated_units(documents(spark, rows), min_words=5).collect()}
    seen, truth = set(), {}
    for i, text, _ in sorted({(i, t, s) for i, t, s in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        spans, at = [], 0
        for line in (text or "").split("\n"):
            words = " ".join(line.lower().split())
            if len(words.split()) >= 5:
                if words in seen:
                    spans.append((at, at + len(line)))
                seen.add(words)
            at += len(line) + 1
        truth[i] = spans
    assert {i: [(s["start"], s["end"]) for s in r["spans"]] for i, r in got.items()} == truth
    for i, text, _ in rows:
        gone = [text[a:b] for a, b in truth[i]]
        left = [x for x in (text or "").split("\n")]
        for g in gone:
            left.reverse(); left.remove(g); left.reverse()
        assert sorted(got[i]["kept_text"].split("\n")) == sorted(left or [""])
        assert got[i]["kept_sha256"] == hashlib.sha256(got[i]["kept_text"].encode()).hexdigest()
    paragraphs = [(1, "one two three four five\nsix\n\nother text is in this part", "s"), (2, "One two three four five six\n \n\nnew", "s")]
    par = {r["doc_id"]: r for r in line_dedup.remove_repeated_units(documents(spark, paragraphs), unit="paragraph").collect()}
    assert par[1]["n_removed"] == 0 and par[2]["n_removed"] == 1
    assert line_dedup.remove_repeated_units(documents(spark, [])).collect() == []


def test_line_dedup_rows_without_id_or_of_one_id_keep_their_own_spans(spark):
    both = "first here is a line of words"
    texts = {None: [f"{both}\nalpha text that only this one has", f"{both}\nbeta and another text of some length here",
                    f"gamma text stands in front of it\n{both}"],
             7: [f"delta words in the front of it\n{both}", f"epsilon text has other words here\nand more\n{both}"]}
    rows = [(i, t, "s") for i, ts in texts.items() for t in ts]
    got = [(r["doc_id"], r["kept_text"]) for r in line_dedup.remove_repeated_units(documents(spark, rows).repartition(3), min_words=5).collect()]
    assert len(got) == len(rows)
    kept = [line for _, t in got for line in t.split("\n")]
    assert sorted(kept) == sorted({line for _, t, _ in rows for line in t.split("\n")})
    assert sum(both in t for i, t in got if i == 7) == 1  # an id ranks before none


def test_line_dedup_query_removes_repeats_of_any_length(spark, tmp_path):
    rng = random.Random(10)
    lines = [prose(rng, n, 30) for n in (1, 1, 2, 4, 5, 9)] + ["les.", " LES. ", "同じ行がここにもあります。", "", " \t"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    documents(spark, [(k, t, "s") for k, t in enumerate(texts)], extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()}
    seen = set()
    for k, text in enumerate(texts):
        gone, left = 0, []
        for line in text.split("\n"):
            norm = " ".join(line.lower().split())
            gone += norm in seen
            left += [] if norm in seen else [line]
            seen |= {norm} - {""}
        assert got[k]["n_removed"] == gone
        assert got[k]["kept_sha256"] == hashlib.sha256("\n".join(left).encode()).hexdigest()


def test_top_k_matches_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vectors = [(k, [rng.uniform(-2, 2) for _ in range(6)]) for k in range(260)]
    vectors += [(300 + k, [0.5] * 6) for k in range(40)] + [(k, [1.0] * 6) for k in (350, 351, 400)]
    vectors += [(500, None), (501, []), (502, [1.0, None, 1, 1, 1, 1]), (550, [float("nan")] * 6), (503, [float("inf")] * 6),
                (600, [1.0, 2.0]), (601, [2.0, 1.0]), (None, [1.0] * 6), (50, vectors[50][1]), (700, [1e300] + [0.0] * 5), (701, [3e6, 1.0, -4e9, 0, 0, 0])]
    usable = {}
    for i, v in vectors:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v):
            usable[i] = [max(-2 ** 63, min(2 ** 63 - 1, math.floor(256 * c))) for c in v]
    truth = set()
    for q, a in usable.items():
        if q % 50 == 0:
            best = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(int(float(x)) * int(float(y)) for x, y in zip(a, b)))), i)
                          for i, b in usable.items() if i != q and len(a) == len(b))[:5]
            truth |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    monkeypatch.setattr(topk, "BLOCK", 37)
    monkeypatch.setattr(topk, "QUERIES", 3)
    df = spark.createDataFrame([(i, v and [c if c is None else float(c) for c in v], 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, block int, dim int").repartition(3)
    got = [tuple(r) for r in topk.search(df).collect()]
    assert set(got) == truth and len(got) == len(truth)
    assert topk.search(df.limit(0)).collect() == []


def test_built_collisions_of_a_fixed_base_are_no_repeats(spark):
    """Texts whose bytes differ by a product of (B^a - 1), 0 modulo 2^64 for any odd B: equal fingerprints under a
    polynomial modulo 2^64, but no common string of 400 bytes."""
    signs = np.ones(1, dtype=np.int64)
    for a in (1, 2, 4, 8, 16, 32, 64, 128, 1, 2, 4, 8, 16):
        wider = np.zeros(len(signs) + a, dtype=np.int64)
        wider[a:] += signs
        wider[:len(signs)] -= signs
        signs = wider
    assert np.abs(signs).max() <= 60
    middle = ord("@") + np.zeros(len(signs), dtype=np.int64)
    one, two = (bytes((middle + d).astype(np.uint8)).decode() for d in (np.maximum(signs, 0), np.maximum(-signs, 0)))
    tail = "".join(random.Random(5).choice("abcdefghij ") for _ in range(300))
    rows = [(1, "x" * 60 + one + tail, "s"), (2, "y" * 60 + two + tail, "s")]
    assert without_repeats([t for _, t, _ in rows], 400)[0][1] == 0
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(documents(spark, rows), length=400).collect()}
    assert got == {1: 0, 2: 0}


def test_products_modulo_the_prime_are_exact():
    rng = random.Random(6)
    numbers = [0, 1, suffix_dedup.PRIME - 1, (1 << 32) - 1, 1 << 32, 1 << 60] + [rng.randrange(suffix_dedup.PRIME) for _ in range(500)]
    a, b = np.array(numbers, dtype=np.uint64), np.array(numbers[::-1], dtype=np.uint64)
    assert suffix_dedup._times(a, b).tolist() == [x * y % suffix_dedup.PRIME for x, y in zip(numbers, numbers[::-1])]
    assert suffix_dedup._powers(12345, 3000).tolist() == [pow(12345, k, suffix_dedup.PRIME) for k in range(3000)]


def test_a_block_of_text_takes_little_memory_besides_it():
    import tracemalloc

    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 123, 2000, dtype=np.uint8).tobytes() for _ in range(250)]
    every = b"".join(texts)
    tracemalloc.start()
    block = suffix_dedup.Block(texts, 101, 987654321)
    sampled, prints = block.sampled()
    starts = block.candidates(sampled)
    sent = list(suffix_dedup._outgoing(block.prints(starts, 101), 64))
    marks = {b: np.packbits(np.frombuffer(p, dtype="u8") % 2 == 0).tobytes() for b, p, _ in sent}
    found = suffix_dedup._incoming(block.prints(starts, 101), marks, 64)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(starts) == 250 * 1900 and most < 70 * len(every)
    base, prime = 987654321, suffix_dedup.PRIME
    for at in (0, 1, 70_000, 499_890):  # in the first slice of powers and in later ones
        value = sum((c + 1) * pow(base, k, prime) for k, c in enumerate(every[at:at + 5])) % prime
        value = (value ^ (value >> 32)) * 0xD6E8FEB86659FD93 % (1 << 64)
        assert int(block.prints(np.array([at]), 5)[0]) == value ^ (value >> 32)
    assert (found == (block.prints(starts, 101) % np.uint64(2) == 0)).all()


def test_memory_is_given_back_after_the_batches_of_a_task(monkeypatch):
    from dunning.llm import graph

    freed = []
    monkeypatch.setattr(graph, "_free", lambda: freed.append(1))

    def work(batches):
        for x in batches:
            yield x + 1

    assert list(graph.freeing(work)([1, 2])) == [2, 3] and freed == [1]


def test_the_stages_of_the_pipeline_hold_small_arrow_batches(spark):
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name)
    docs = documents(spark, [(k, "word " * 2000, "a") for k in range(2000)], extra=False)
    try:
        for session, wanted in (("64m", corpus_pipeline.BATCH_BYTES), ("1m", 1 << 20)):
            spark.conf.set(name, session)
            assert dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "").count()

            def sizes(batches):
                for batch in batches:
                    yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

            most = docs.select("text").mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]
            assert most <= 1.1 * wanted
    finally:
        spark.conf.set(name, given)


def test_op3_returns_the_text_that_is_left(spark, tmp_path):
    rng = random.Random(8)
    shared = prose(rng, 200, 4000)
    rows = [(1, f"{prose(rng, 30, 4000)} {shared}", "a"), (2, f"{shared} \u00e9t\u00e9", "a"), (3, prose(rng, 120, 4000), "a"), (4, None, "a"), (5, shared[:399], "a")]
    documents(spark, rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op3_suffix_array(spark, str(tmp_path))
    assert found.columns[:6] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    got = {r["doc_id"]: r for r in found.collect()}
    for (doc, _, _), (n_bytes, n_removed, n_spans, sha) in zip(rows, without_repeats([t for _, t, _ in rows], 400)):
        row = got[doc]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) == (n_bytes, n_removed, n_spans, sha)
        assert hashlib.sha256(row["text"].encode()).hexdigest() == sha and len(row["text"].encode()) == n_bytes - n_removed
    assert got[3]["text"] == rows[2][1] and got[2]["text"].endswith("\u00e9t\u00e9") and len(got[2]["text"]) < 50 and got[4]["text"] == ""


def plain_passages(rows, size):
    """doc_id -> spans of the words in windows of ``size`` words that a row of another id or text holds too."""
    def windows(text):
        words = text.lower().split()
        return [tuple(words[k:k + size]) for k in range(len(words) - size + 1)]

    holders, out = {}, {}
    for i, t, _ in rows:
        for w in windows(t or ""):
            holders.setdefault(w, set()).add((i, t))
    for i, t, _ in rows:
        gone = [False] * len((t or "").split())
        for k, w in enumerate(windows(t or "")):
            if len(holders[w]) > 1:
                gone[k:k + size] = [True] * size
        spans, at = [], 0
        for k, word in enumerate((t or "").split()):
            start = t.index(word, at)
            at = start + len(word)
            if gone[k] and k and gone[k - 1]:
                spans[-1] = (spans[-1][0], at)
            elif gone[k]:
                spans.append((start, at))
        out.setdefault(i, []).append(spans)
    return {i: sorted(x) for i, x in out.items()}


@pytest.mark.parametrize("size, block_bytes", [(51, 2 << 20), (7, 300), (1, 300)])
def test_shared_passages_match_brute_force(spark, monkeypatch, size, block_bytes):
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", block_bytes)
    rng = random.Random(11)
    shared = [prose(rng, n, 4000) for n in (size - 1, size, size + 1, size + 20)] + ["\u0130\u03a3 " * (size + 3), prose(rng, 2 * size, 1)]
    rows = [(None, shared[3], "s"), (None, shared[2] + " x", "s"), (1, None, "s"), (2, "", "s"), (3, " \n\t", "s")]
    once = prose(rng, 2 * size + 40, 4000)
    rows += [(4, f"{once}\n{once}", "s"), (5, f"own {once[:40]} text", "s"), (5, f"own {once[:40]} text", "s")]
    for k in range(40):
        parts = []
        for passage in rng.sample(shared, rng.randrange(3)):
            words = passage.split()
            parts += [prose(rng, rng.randrange(9), 4000), "".join(w.upper() + rng.choice([" ", " ", "\n", "\t "]) for w in words)]
        rows.append((10 + k, " ".join([*parts, prose(rng, rng.randrange(30), 4000)]), "s"))
    got = line_dedup.remove_repeated_units(documents(spark, rows).repartition(3), passage_words=size).collect()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append([(s["start"], s["end"]) for s in r["passages"]])
        assert r["n_passages"] == len(r["passages"]) and r["n_passage_chars"] == sum(s["end"] - s["start"] for s in r["passages"])
    truth = plain_passages(rows, size)
    assert {i: sorted(x) for i, x in found.items()} == truth
    assert sum(len(s) > 0 for x in truth.values() for s in x) > 20
    plain = line_dedup.remove_repeated_units(documents(spark, rows))
    assert sorted((r["kept_sha256"], r["n_removed"]) for r in plain.collect()) == sorted((r["kept_sha256"], r["n_removed"]) for r in got)
    assert line_dedup.remove_repeated_units(documents(spark, []), passage_words=size).collect() == []


def test_op6_reports_passages_inside_and_across_lines(spark, tmp_path):
    rng = random.Random(12)
    passage = prose(rng, 60, 4000)
    across = " ".join(w + ("\n" if k % 17 == 3 else "") for k, w in enumerate(passage.split()))
    rows = [(1, f"{prose(rng, 9, 4000)} {passage} {prose(rng, 5, 4000)}", "s"), (2, f"{prose(rng, 4, 4000)} {across}\nend", "s"),
            (3, prose(rng, 90, 4000) + "\nsame short line", "s"), (4, prose(rng, 90, 4000) + "\nsame short line", "s")]
    documents(spark, rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert [(got[k]["n_removed"], got[k]["n_passages"]) for k in (1, 2, 3, 4)] == [(0, 1), (0, 1), (0, 0), (1, 0)]
    for k in (1, 2):
        (span,) = got[k]["passages"]
        assert rows[k - 1][1][span["start"]:span["end"]].split() == passage.split()


def plain_byte_passages(texts, size):
    """For each text, the spans of bytes of the runs of words in strings of ``size`` words that another text holds as well."""
    words = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    cut = [[t[w[k][0]:w[k + size - 1][1]] for k in range(len(w) - size + 1)] for t, w in zip(texts, words)]
    holders = {}
    for n, strings in enumerate(cut):
        for x in strings:
            holders.setdefault(x, set()).add(n)
    out = []
    for w, strings in zip(words, cut):
        spans, last = [], -1
        for k, x in enumerate(strings):
            if len(holders[x]) > 1:
                spans = [*spans[:-1], (spans[-1][0], w[k + size - 1][1])] if spans and k <= last else [*spans, (w[k][0], w[k + size - 1][1])]
                last = k + size
        out.append(spans)
    return out


@pytest.mark.parametrize("size, block_bytes", [(51, 2 << 20), (12, 400), (1, 400)])
def test_suffix_dedup_finds_passages_of_words(spark, monkeypatch, size, block_bytes):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block_bytes)
    rng = random.Random(13)
    shared = [prose(rng, n, 4000) for n in (size - 1, size, size + 1, size + 25)] + ["\u00e9t\u00e9\n " * (size + 2), prose(rng, 2 * size, 1)]
    once = prose(rng, 2 * size + 30, 4000)
    texts = [None, "", " \n\t", f"{once}\n{once}", f"  {shared[3]} ", f"  {shared[3]} ", prose(rng, size, 4000) + "\u00a0x"]
    for _ in range(40):
        parts = [x for passage in rng.sample(shared, rng.randrange(3)) for x in (prose(rng, rng.randrange(1, 9), 4000), passage)]
        texts.append(rng.choice([" ", "\n"]).join([*parts, prose(rng, rng.randrange(1, 30), 4000)]))
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(documents(spark, rows), length=60, passage_words=size).collect()}
    truth = plain_byte_passages([(t or "").encode() for t in texts], size)
    for k, spans in enumerate(truth):
        assert [(s["start"], s["end"]) for s in got[k]["passages"]] == spans, k
        assert (got[k]["n_passages"], got[k]["n_passage_bytes"]) == (len(spans), sum(b - a for a, b in spans))
    assert sum(map(bool, truth)) > 20
    for k, (_, n_removed, n_spans, sha) in enumerate(without_repeats(texts, 60)):
        assert (got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == (n_removed, n_spans, sha)
    assert suffix_dedup.remove_repeats(documents(spark, []), length=60, passage_words=size).collect() == []


def test_op3_reports_passages_below_400_bytes(spark, tmp_path):
    rng = random.Random(14)
    passage = prose(rng, 60, 4000)
    assert len(passage) < 400
    rows = [(k, f"{prose(rng, 9 + k, 4000)} {passage} {prose(rng, 5, 4000)}", "s") for k in (1, 2)] + [(3, prose(rng, 200, 4000), "s")]
    documents(spark, rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op3_suffix_array(spark, str(tmp_path)).collect()}
    assert [(got[k]["n_removed"], got[k]["n_passages"], got[k]["n_passage_bytes"]) for k in (1, 2, 3)] == [(0, 1, len(passage))] * 2 + [(0, 0, 0)]


def test_packed_fingerprints_are_the_same_and_smaller():
    import zlib

    values = np.unique(np.random.default_rng(6).integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2))
    for some in (values, values[:1], values[:0], np.array([0, (1 << 64) - 1], dtype=np.uint64)):
        assert (suffix_dedup._unpacked(suffix_dedup._packed(some.tobytes())) == some).all()
    assert len(zlib.compress(suffix_dedup._packed(values.tobytes()), 1)) < 0.9 * len(zlib.compress(values.tobytes(), 1))
