"""Operators 11, 12 and 13 against brute force."""

import collections
import hashlib
import json
import math
import random
import re
import string

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from dunning.llm import secret_owners, token_alignment, vector_codes
from tests.conftest import SF_SMALL
from tests.llm.helpers import documents, prose

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

# --- operator 11 ---

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KIND_NO = {"assign": 0, "access": 1, "hex": 2, "owned": 3}


def base_spans(text):
    found = [("assign", m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [("access", m.start(), m.end(), m.group()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [("hex", m.start(), m.end(), m.group()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found, key=lambda x: (x[1], KIND_NO[x[0]]))


def bare_spans(text):
    """Bare values outside assignments, position by position."""
    out, at = [], 0
    run = re.compile("[A-Za-z0-9+/_=-]{20,}")
    while at < len(text):
        if m := ASSIGN.match(text, at):
            at = m.end()
        elif m := run.match(text, at):
            v = m.group()
            inside = re.search("password|passwd|secret|token|api_?key", v, re.I | re.A) or "AKIA" in v or re.search("[0-9a-f]{24,}", v)
            if not inside and all(re.search(x, v) for x in ("[0-9]", "[A-Z]", "[a-z]")):
                out.append(("owned", m.start(), m.end(), v))
            at = m.end()
        else:
            at += 1
    return out


def scanned(rows):
    """rows (id, text, source) -> expected columns in order, by comparing everything in memory."""
    spans = [(base_spans(t or ""), bare_spans(t or "")) for _, t, _ in rows]
    owners = collections.defaultdict(set)
    for (_, _, s), (b, o) in zip(rows, spans):
        for x in b + o:
            owners[x[3]].add(s)
    live = lambda v: bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(set(v)) >= 8)
    text = lambda xs: ",".join(f"{k}:{s}:{e}" for k, s, e, _ in sorted(xs, key=lambda x: (x[1], KIND_NO[x[0]])))
    out = []
    for (i, _, _), (b, o) in zip(rows, spans):
        every = b + [x for x in o if len(owners[x[3]]) < 3 and live(x[3])]
        n = collections.Counter(x[0] for x in b)
        out.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(text(b).encode()).hexdigest(), text(every),
                    sum(len(owners[x[3]]) < 3 and live(x[3]) for x in every), sum(len(owners[x[3]]) >= 3 for x in every)))
    return out


def test_secrets_equal_brute_force(spark):
    rng = random.Random(5)
    key = lambda n, chars=string.ascii_letters + string.digits: "".join(rng.choice(chars) for _ in range(n))
    shared, own, access, hexa = key(32), key(40), "AKIA" + key(16, string.ascii_uppercase), key(40, "0123456789abcdef")
    pieces = [f"password: {key(9)}", f'API_KEY = "{shared}"', f"apikey={own} ", "token: token: abcdefgh", "secret='abc'", f"{access}9", access[:19],
              hexa, hexa[:23], f"x{hexa}", f"bare {shared} x", f"bare {own}.", f"é😀 {key(30)} ", f"https://a.org/{key(24)}/b", "ToKeN=Ab1-_.=+/9", "\n", "''",
              f"secret{key(20)}", "paſſwd: kelvinsign", "toKen: abcdefg", "a-long-line-of-words-and-no-digit", "AKIAAKIA" + key(18, string.ascii_uppercase)]
    rows = [(1, None, "s1"), (2, "", "s2"), (None, f"token={own}", "s1"), (None, f"token={own}", None), (3, pieces[1], None), (4, pieces[1], "s1"),
            (4, pieces[1], "s1"), (5, shared, "s2"), (6, "x" * 100_000 + f" {own} " + "y" * 50_000, "s3")]
    rows += [(k, "".join(rng.choice([" ", ",", "", "é "]) + rng.choice(pieces) for _ in range(rng.randrange(12))), f"s{rng.randrange(4)}") for k in range(10, 90)]
    rows.append((7, " ".join(f"token={key(8)} {hexa}" for _ in range(700)), "s1"))  # more matches than one block of running totals
    got = sorted(map(tuple, secret_owners.scan(documents(spark, rows)).collect()), key=repr)
    assert got == sorted(scanned(rows), key=repr)
    assert any(x[6] for x in got) and any(x[7] for x in got) and any("owned" in x[5] for x in got)
    assert secret_owners.scan(documents(spark, rows[:1]).limit(0)).collect() == []


def test_secret_query_has_no_python(spark):
    from dunning.llm import queries

    df = queries.QUERIES["op11_secret_owners"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert df.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def test_ownership_counts_repositories_within_owners(spark):
    rows = [("a", "o1", 1), ("a", "o1", 1), ("a", "o1", 2), ("a", "o2", 1), ("a", None, None), ("b", "o1", 1)]
    got = {r["digest"]: (r["n_owners"], r["n_repos"]) for r in secret_owners.ownership(spark.createDataFrame(rows, "digest string, owner string, repo long")).collect()}
    assert got == {"a": (3, 4), "b": (1, 1)}


# --- operator 12 ---

def whole_alignment(texts):
    """Expected columns without id, each text encoded and cut as a whole, links token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    symbol = token_alignment.byte_of_symbol()
    docs = []
    for t in texts:
        raw = (" " + (t or "")).encode()
        ai = a.encode(" " + t, add_special_tokens=False).ids if t else []
        bi = b.encode(t) if t else []
        ab = [bytes(symbol.get(c, 0) for c in a.id_to_token(i)) for i in ai]
        bb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, bi)]
        if not t or b"".join(ab) != raw or b"".join(bb) != raw:
            docs.append(None)
            continue
        groups, i, j, x, y, g = [], 0, 0, 0, 0, ([], [])
        while i < len(ai) or j < len(bi):
            if x <= y and i < len(ai) and (x < y or not g[0]):
                g[0].append(ai[i]); x += len(ab[i]); i += 1
            else:
                g[1].append(bi[j]); y += len(bb[j]); j += 1
            if x == y and g[0] and g[1]:
                groups.append(g); g = ([], [])
        docs.append((len(ai), len(bi), groups))
    count = collections.Counter(p for d in docs if d for p in {(p, q) for g in d[2] for p in g[0] for q in g[1]})
    best = {}
    for (p, _), n in count.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, "", ""))
            continue
        links = [(p, q) for g in d[2] for p in g[0] for q in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in d[2])
        out.append((d[0], d[1], len(d[2]), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest(), text))
    return out


@pytest.mark.parametrize("known", [token_alignment.KNOWN, 100, 0])
def test_alignment_equals_whole_texts_token_by_token(spark, known):
    rng = random.Random(8)
    zoo = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n b\t c", "\n\n", "x  y", "x　 y  z", "▁", "a▁b ▁", "<|endoftext|> </s> <s> <unk>", "<0x41>",
           "naïve café 東京タワー 😀👍🏽 ", "é ́x", "don't I'll  we've", "1234567890 " * 30, "ﬁ ½ Ⅷ", "a" * 500, " " * 300 + "x", "  x\x1c y\x85 z",
           "東" * 300, "\x00 a", "word " * 400, "=" * 90 + " " + "-" * 70, "tab\tsep \tx", "​ zero ﻿ bom"]
    alphabet = "ab  \n\t.,'é東😀▁1"
    zoo += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts = zoo + [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").limit(60).collect()] + ["a  b"]
    df = documents(spark, [(k if k != 5 else None, t, "s") for k, t in enumerate(texts)]).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in token_alignment.align(df, A_FILE, B_FILE, known=known, with_groups=True).collect()}
    want = {(k if k != 5 else None): x for k, x in enumerate(whole_alignment(texts))}
    assert got == want
    assert token_alignment.align(df.limit(0), A_FILE, B_FILE).collect() == []


def test_groups_are_cut_at_common_ends():
    assert token_alignment.groups([1, 2, 3], [3, 3]) == [(2, 1), (3, 2)]
    assert token_alignment.groups([5], [1, 1, 3]) == [(1, 3)]
    assert token_alignment.groups([], []) == []


def test_long_group_is_not_expanded_token_by_token():
    aligner = token_alignment.Aligner(A_FILE, B_FILE)
    a_id, b_id, n_b = 5, 6, aligner.pair.n_b
    aligner.pair.a_bytes[a_id], aligner.pair.b_bytes[b_id], aligner.pair.a_bytes[7], aligner.pair.b_bytes[8] = b"aa", b"aaa", b"b", b"b"
    n = 30_001  # one end in common every six bytes
    text, n_a, n_b_, n_groups, codes, times = aligner.unit("a" * 6 * n, [a_id] * 3 * n, [b_id] * 2 * n)
    assert (n_a, n_b_, n_groups, times) == (3 * n, 2 * n, n, None) and set(np.frombuffer(codes, dtype=np.int64)) == {a_id * n_b + b_id} and len(codes) == 48 * n
    aligner.pair.b_bytes[9] = b"a"
    a, b = [7] + [a_id] * 50_000 + [7], [8, 9] + [b_id] * 33_333 + [8]
    text, n_a, n_b_, n_groups, codes, times = aligner.unit("b" + "a" * 100_000 + "b", a, b)
    ends = set(range(1, 100_002, 2)) & ({1, 2} | set(range(5, 100_002, 3)))
    assert n_groups == len(ends) + 1 and times is None
    aligner.pair.a_bytes[10], aligner.pair.b_bytes[9] = b"a", b"aa"  # none at all
    a, b = [10] + [a_id] * 50_000 + [10], [9] * 50_001
    text, n_a, n_b_, n_groups, codes, times = aligner.unit("a" * 100_002, a, b)
    assert n_groups == 1 and len(codes) == 16
    assert dict(zip(np.frombuffer(codes, dtype=np.int64).tolist(), np.frombuffer(times, dtype=np.int64).tolist())) == {10 * n_b + 9: 2 * 50_001, a_id * n_b + 9: 50_000 * 50_001}


# --- operator 13 ---

def trained(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows (id, vector, label) -> (id, code, error, label_error, hash), in Python integers."""
    kept = [(i, [math.floor(float(x) * scale) for x in v], lab) for i, v, lab in rows
            if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    size = len(kept[0][1]) // parts
    cut = [[v[p * size:(p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    mark = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    total = collections.Counter()
    for (_, _, lab), e in zip(kept, errors):
        total[lab] += e
    clip = lambda x: min(x, (1 << 63) - 1)
    return [(i, "".join(f"{k:02x}" for _, k in f), clip(e), clip(total[lab]), mark) for (i, _, lab), f, e in zip(kept, found, errors)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *[F.lit(1).alias(c) for c in ("id", "v", "of", "dim", "part", "n")])


@pytest.mark.parametrize("spread", [1.0, 1e4, 3e9, 1e12])
def test_vector_codes_equal_integer_arithmetic(spark, spread):
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-1, 1) * spread for _ in range(24)], rng.choice([None, 0, 1, 2])) for k in range(150)]
    rows += [(500, rows[3][1], 1), (500, rows[3][1], 1), (501, [0.0] * 24, 1), (None, rows[7][1], 2), (502, None, 1), (503, [], 1), (504, [1.0] * 23, 1),
             (505, [None] + [1.0] * 23, 1), (506, [float("nan")] * 24, 1), (507, [float("inf")] * 24, 0)]
    rng.shuffle(rows)
    got = sorted(map(tuple, vector_codes.compress(vectors(spark, rows).repartition(3)).collect()), key=repr)
    assert got == sorted(trained(rows), key=repr)


def test_vector_codes_of_few_rows_ties_and_lengths(spark):
    few = [(k, [float(k)] * 8, None) for k in range(5)] + [(2, [9.0] * 8, None)]
    assert sorted(map(tuple, vector_codes.compress(vectors(spark, few)).collect())) == sorted(trained(few))
    long = [(k, [0.25 * k] * 16, None) for k in range(3)]
    both = sorted((r["vec_id"], r["codebooks_sha256"], r["code"], r["error"]) for r in vector_codes.compress(vectors(spark, few + long)).collect())
    assert both == sorted((x[0], x[4], x[1], x[2]) for x in trained(few) + trained(long))
    assert vector_codes.compress(vectors(spark, few).limit(0)).collect() == []
    with pytest.raises(ValueError):
        vector_codes.compress(vectors(spark, few), entries=257)


def test_limb_products_are_exact():
    rng = np.random.default_rng(1)
    for bits in (3, 12, 13, 25, 29):
        x, c = (rng.integers(-(1 << bits), 1 << bits, size=(n, 8)) for n in (40, 16))
        assert vector_codes.products(x, c).tolist() == [[sum(int(p) * int(q) for p, q in zip(a, b)) for b in c] for a in x]
    assert all(np.abs(limb).max() <= 1 << vector_codes.LIMB for limb in vector_codes._limbs(np.array([-(1 << 62), (1 << 62) - 1, -1, 0])))


def test_prose_has_no_secret(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, 200), "s") for k in range(20)]
    assert {tuple(r)[1:4] + (r["spans"],) for r in secret_owners.scan(documents(spark, rows)).collect()} == {(0, 0, 0, "")}


def test_byte_symbols_cover_all_bytes():
    vocabulary = json.load(open(A_FILE))["model"]["vocab"]
    symbol = token_alignment.byte_of_symbol()
    assert sorted(symbol.values()) == list(range(256)) and {c for t in vocabulary for c in t} <= set(symbol) | set("<|endoftext|>")


def test_units_aligned_together_are_units_aligned_alone():
    aligner, rng = token_alignment.Aligner(A_FILE, B_FILE), random.Random(5)
    letters = "abcdefgxyzäßжд漢字é🙂0123456789.,;:'\"-_/<|>#"
    clean = [" " + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(800)]
    odd = [" ", " x ", " \n", " a\nb", " ﬁn", " é", " ▁", " a▁b", " \x00", " <|endoftext|>", " </s>", " <0x41>", " " + "=" * 60, " a\t"]
    alone = lambda units: [aligner.unit(u, *(ids[0] for ids in aligner.pair.encode([u]))) for u in units]
    assert aligner.pair.joins
    for units in (clean, odd, clean[:300] + odd + clean[300:], clean[:1], []):
        assert aligner.aligned(list(units)) == alone(units)
    assert sum(x is not None for x in alone(clean)) > 400
    # units of plain words need no call each
    words = [f" word{k}" for k in range(500)]
    assert aligner.together(words) == alone(words)
