"""Operators 4, 5, 7, 8, 9 and 10 and the pipeline."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from dunning.llm import bpe, html_text, mixing, quality, queries, sharding, toxicity
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.helpers import documents, edit_distance, jaccard_components, prose, without_repeats

PAGES = [
    (1, "http://a.org/1", "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li>x</ul></nav><div class=ad>Buy</div>"
     "<article><h1>Head &amp; line</h1><p>One  two\n three <b>four<br>five<p>Next &lt;b&gt; <span class='ad'>buy</span>six</article><footer>&copy;</footer>",
     "Head & line\nOne two three four five\nNext <b> six"),
    (2, None, None, ""), (3, "http://a.org/3", "", ""), (4, "http://a.org/4", "no markup &eacute;", "no markup é"),
    (5, "x", "<!-- never <p>closed", ""), (6, "x", "</p></div>stray", "stray"),
    (7, "http://b.org", "<main><header><h1>T</h1></header><p>a<form>f<input></form><section class='comments'><p>c</section></main><aside>s</aside>", "T\na"),
    (8, "http://b.org", "<table><tr><td>1<td>2<tr><td>3</table><ul><li>a<li>b</ul>", "1\n2\n3\na\nb"),
    (8, "http://b.org", "<table><tr><td>1<td>2<tr><td>3</table><ul><li>a<li>b</ul>", "1\n2\n3\na\nb"),
    (9, "http://b.org", "<div>" * 3000 + "deep", "deep"),
]


def test_main_text_cases(spark):
    df = spark.createDataFrame([(i, u, h, 1, 2) for i, u, h, _ in PAGES], "page_id long, url string, html string, host int, path int")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_text.main_text(df).collect()))
    assert got == sorted((i, t, len(t)) for i, _, _, t in PAGES)
    assert html_text.main_text(df.limit(0)).collect() == []


def test_style_tree_removes_what_pages_of_a_host_share(spark):
    rng = random.Random(1)
    def page(k):
        return (f"<body><div class=top>Welcome to our site</div><div class=body><div class=para>{prose(rng, 30)}</div>"
                f"<div class=para>{prose(rng, 20)}</div></div><div class=bottom>All rights reserved</div></body>")
    rows = [(k, "https://same.org/%d" % k, page(k)) for k in range(12)]
    copies = [(100 + k, "https://copies.org/%d" % k, "<article><p>the very same article</article>") for k in range(6)]
    alone = [(200, "https://alone.org/", page(99))]
    df = spark.createDataFrame(rows + copies + alone, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    for k, _, html in rows:
        assert got[k] == "\n".join(re.findall("class=para>([^<]*)", html))
    assert all(got[100 + k] == "the very same article" for k in range(6))
    assert got[200].startswith("Welcome")


def test_main_text_is_the_article_of_the_given_pages(spark):
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op4_style_tree"](spark, SF_SMALL).collect()}
    import html as H
    for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect():
        body = re.search("<article>(.*)</article>", r["html"], re.S).group(1)
        parts = [" ".join(H.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)


def test_listed_words_are_whole_classes_and_spare_the_article(spark):
    cases = [("<body><div class='site has-sidebar'><p>the whole text</p></div>", "the whole text"),
             ("<article class='post comments-open'><h1>t</h1><p>a story</p></article>", "t\na story"),
             ("<article><p>a story of some words</p><h2 id='related-work'>x</h2><h2 id='related'>y</h2><section id='notice-period'>z</section>"
              "<div class='social-impact'>v</div></article>", "a story of some words\nx\ny\nz\nv"),
             ("<div id='sidebar'><article><p>a</p></article></div><div class='menu'>much more text than that</div>", "a"),
             ("<div class='site overlay'><p>most of the text is here</p></div><p>little</p>", "most of the text is here\nlittle"),
             ("<p><span class='notice'>a marked phrase holds the text</span> end</p>", "a marked phrase holds the text end"),
             ("<form action=x><div class=page><article><p>a story</p></article></div></form>", "a story"),
             ("<nav><a>only</a></nav><footer>links</footer>", "only\nlinks"),
             ("<div class='menu'>one</div><div class='banner'>two</div>", "one\ntwo"),
             ("<div class='x Sidebar'>gone</div><div id='comments'>gone too</div><p>the text that stays on the page</p>", "the text that stays on the page"),
             ("<article><p>a story of some words</p><section class='comments'><article class='comment'>c</article></section></article>", "a story of some words")]
    df = spark.createDataFrame([(k, f"http://h{k}.org", h) for k, (h, _) in enumerate(cases)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert got == {k: t for k, (_, t) in enumerate(cases)}


def test_style_tree_decides_below_and_beside_the_article(spark):
    rng = random.Random(4)
    rows, truth = [], {}

    def add(host, html, text):
        truth[len(rows)] = text
        rows.append((len(rows), f"http://{host}/{len(rows)}", html))

    for _ in range(12):
        title, story, more = prose(rng, 6, 900), prose(rng, 60, 900), prose(rng, 25, 900)
        box = "<div class=box>Join our many readers today</div>"
        add("box.org", f"<article><h1>{title}</h1><p>{story}</p>{box}</article>", f"{title}\n{story}")
        add("beside.org", f"<article><p>{story}</p></article><div class=rest>{more}</div><div class=end>Same on all pages</div>", f"{story}\n{more}")
        add("cards.org", f"<div class=body><p>{story}</p></div><article class=card><p>{title}</p></article><article class=card><p>{more}</p></article>",
            f"{story}\n{title}\n{more}")
    copy = prose(rng, 60, 900)
    for k in range(6):
        add("copies.org", f"<article><p>{copy}</p><span>seen {k}</span><div class=box>Join us</div></article>", f"{copy}\nseen {k}\nJoin us")
    add("alone.org", f"<article><p>{copy}</p></article><div class=rest>beside it</div>", copy)
    add("card.org", f"<div class=body><p>{copy}</p></div><article><p>a card</p></article>", f"{copy}\na card")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()} == truth


def test_automaton_on_trie_is_the_edit_distance():
    rng = random.Random(2)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 13))) for _ in range(60)}
    matcher = toxicity.Matcher(terms)
    for _ in range(1500):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(4, 13)))
        if word in terms:
            continue
        truth = {(t, d) for t in terms if (d := edit_distance(t, word)) <= toxicity.allowed(len(t)) and toxicity.allowed(len(t))}
        assert set(matcher.look_up(word)) == truth


def plain_matches(terms, token):
    """(term, edits) of a token by the rules of the module's docstring, comparing every word with every term."""
    def strip(text):
        return re.sub(r"^[\W_]+|[\W_]+$", "", text)

    def near(word):
        return {(t, d) for t in terms if abs(len(t) - len(word)) < 3 and (d := edit_distance(t, word)) <= toxicity.allowed(len(t)) and toxicity.allowed(len(t))}

    word = strip(token)
    if word in terms:
        return {(word, 0)}
    if not word.isalpha():
        plain = re.sub(r"[\W_]+", "", token.translate(toxicity.LOOKALIKE))
        if plain in terms:
            return {(plain, 1)}
    parts = [x for x in re.split(r"[\W_]+", word) if x]
    return {(x, 0) for x in parts if x in terms} or near(word) or set().union(*map(near, parts))


def test_toxicity_score_equals_plain_comparison():
    rng = random.Random(31)
    terms = {"horridword": 0.9, "vile": 0.7, "nasty": 0.8, "abominations": 0.6}
    lexicon = toxicity.Lexicon(terms, {"vile": 0.65}, {"nasty": 0.5}, 0.3)
    matcher = toxicity.Matcher(terms, remembered=40)
    pieces = ["horridword", "horidword", "hrrdword", "vile", "vole", "nasty", "nastyy", "n4sty", "abomintion", "bominations", "plain", "words", "said", '"', "q" * 90]
    for _ in range(150):
        tokens = ["".join(rng.choice(pieces) + rng.choice(["", "", ".", "/", "_", "-"]) for _ in range(rng.choice([1, 1, 1, 2, 12])))
                  for _ in range(rng.randrange(0, 20))]
        best = {}
        found = [(at, t, e) for at, token in enumerate(tokens) for t, e in plain_matches(terms, token)]
        lone = len({t for at, t, e in found if not e and not toxicity.is_quoted(tokens, at)}) < 2
        for at, t, e in found:
            p = lexicon.alone.get(t, terms[t]) if lone else terms[t]
            p *= (lexicon.misspelled.get(t, toxicity.UNSEEN) if e else 1) * (lexicon.quoted if toxicity.is_quoted(tokens, at) else 1)
            best[t] = max(best.get(t, 0), p)
        truth = 1.0
        for p in best.values():
            truth *= 1 - p
        assert abs(toxicity.score(lexicon, toxicity.matches(matcher, " ".join(tokens))) - (1 - truth)) < 1e-12, tokens


def test_toxicity_cuts_no_token_and_no_term():
    matcher = toxicity.Matcher({"horridword", "abominations", "x" * 60})
    for token in ("horridword.next", "x.horridword/" + "y" * 500, "horridword" + "," * 200_000 + "z", "_" * 100_000 + "horridword"):
        assert matcher.look_up(token) == [("horridword", 0)]
    assert matcher.look_up("x" * 59) == [("x" * 60, 1)] and matcher.look_up("x" * 60) == [("x" * 60, 0)]
    assert toxicity.Matcher({"ninechars"}).look_up("ninechr") == [("ninechars", 2)]  # seven letters, two of nine missing


def labelled(rng, n):
    rows, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        words = prose(rng, 60, 3000).split()
        if toxic:
            for _ in range(1 + k % 3):
                words.insert(rng.randrange(60), rng.choice(["horridword", "nastyterm", "vileinsult"]))
        rows.append((k, " ".join(words), "s"))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity_learns_finds_misspellings_and_quotes(spark):
    rng = random.Random(8)
    rows, labels = labelled(rng, 400)
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "you horrid-word", "s"), (1003, "you horidword you nastytermm", "s"),
             (1004, 'he said "horridword" once', "s"), (1005, "h0rr1dw0rd and v1leinsult", "s"), (None, "fine text", "s"), (3, rows[3][1], "s")]
    labels += [(1000, 0), (1001, None), (None, 1), (99999, 1), (4, 0)]
    docs = documents(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, marks).collect()}
    assert len(got) == len({r[0] for r in rows})
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert got[1000]["score"] == got[1001]["score"] == 0 and got[1000]["held_out"] in (True, False)
    assert all(got[k]["predicted"] == int(k % 4 == 0) for k in range(400))
    assert got[1003]["predicted"] == 1 and got[1005]["predicted"] == 1
    assert got[1004]["score"] < got[0]["score"]
    assert [r["score"] for r in toxicity.classify(docs, marks.where("toxic = 0")).collect()] == [0.0] * len(rows)
    assert toxicity.classify(documents(spark, []), marks).collect() == []


def test_toxicity_held_out_accuracy(spark):
    got = queries.QUERIES["op5_toxicity"](spark, SF_MID).join(spark.read.parquet(f"{SF_MID}/labels.parquet"), "doc_id")
    rows = got.where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) >= 0.9
    assert all(not r["predicted"] for r in rows if not r["toxic"])


def test_mixing_hits_target_weights(spark):
    rows = [(k, "t", "big" if k % 3 else ("mid" if k % 6 else None)) for k in range(6000)] + [(-1, "t", "rare"), (-1, "t", "rare"), (None, "t", "rare")]
    docs = documents(spark, rows)
    weights = {"big": 1, "mid": 2, "rare": 0.05, "absent": 5}
    got = mixing.mix(docs, weights=weights).collect()
    by = collections.Counter(r["source"] for r in got)
    assert set(by) <= {"big", "mid", "rare"}  # the null source has no weight
    total = len(got)
    shares = {"big": 1 / 3.05, "mid": 2 / 3.05}
    for s, share in shares.items():
        assert abs(by[s] / total - share) < 0.03
    assert abs(total - len(rows)) < 5 * math.sqrt(len(rows)) * 2
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(docs, "source", weights, 1.0).collect()}
    assert rates["rare"] == pytest.approx(0.05 / 3.05 * len(rows) / 3) and rates[None] == 0
    assert [r["n_copies"] for r in got if r["doc_id"] == -1] and len({r["n_copies"] for r in got if r["doc_id"] == -1}) == 1
    keys = [r["shuffle_key"] for r in got]
    assert keys == sorted(keys) and all(r["lang"] == "en" for r in got[:5])
    again = mixing.mix(docs.repartition(5), weights=weights).collect()
    assert collections.Counter((r["doc_id"], r["n_copies"]) for r in got) == collections.Counter((r["doc_id"], r["n_copies"]) for r in again)
    assert mixing.mix(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs, weights={"big": -1})


def test_poisson_inversion(spark):
    grid = spark.range(20000).select(((F.col("id") + 0.5) / 20000).alias("u"))
    for rate in (0.0, 0.3, 4.0, 16.0):
        n = grid.select(mixing.poisson(mixing.distribution(F.lit(rate)), F.col("u")).alias("k")).agg(F.avg("k"), F.var_pop("k")).first()
        assert n[0] == pytest.approx(rate, abs=0.01) and n[1] == pytest.approx(rate, abs=0.05)


def quality_truth(text):
    words = (text or "").encode().split()
    raw = [w.decode() for w in words]
    windows = collections.Counter(tuple(raw[i:i + 5]) for i in range(len(raw) - 4))
    covered = set()
    for i in range(len(raw) - 4):
        if windows[tuple(raw[i:i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    n = len(raw)
    return (n, sum(map(len, raw)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def test_quality_measures_and_cascade(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "a" * 500, "x y z " * 50, "é b \x0bc\n\n \nline\nline\nline", "# * $ " * 30, "WORDS IN CAPITALS " * 2 + prose(rng, 8).upper()]
    texts += [prose(rng, rng.randrange(1, 60), rng.choice([3, 8, 500])) for _ in range(40)]
    texts += ["\n".join(prose(rng, 6, 500) for _ in range(5)) + "\n" + "same line of words\n" * 2 for _ in range(5)]
    docs = documents(spark, list(zip(range(len(texts)), texts, "s" * len(texts))) + [(0, None, "s")])
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == quality_truth(t), t
        assert r["kept"] == (not r["base_failed"] and r["rejected_by"] is None)
    one = {name: {r["doc_id"] for r in quality.judge(docs, rules={name: rule}).where("rejected_by is not null").collect()}
           for name, rule in quality.RULES.items()}
    assert {k for k, r in got.items() if r["rejected_by"]} == set().union(*one.values())  # any order, same verdict
    assert quality.judge(documents(spark, [])).collect() == []


def test_cascade_counts_rejections_of_the_rows_that_are_left():
    sets = [(frozenset("a"), 10), (frozenset("ab"), 30), (frozenset("b"), 5), (frozenset("c"), 8), (frozenset(), 100)]
    # a first (40 rows a second); b then has 5 of its 35 left and c, at twice the cost, 8: 5 a second against 4
    assert quality.greedy_order(sets, {"a": 1.0, "b": 1.0, "c": 2.0}) == ["a", "b", "c"]
    assert quality.greedy_order(sets, {"a": 1.0, "b": 1.0, "c": 1.0}) == ["a", "c", "b"]
    assert quality.greedy_order(sets, {"a": 9.0, "b": 1.0, "c": 1.0}) == ["b", "c", "a"]
    assert quality.greedy_order([], {"b": 1.0, "a": 1.0, "c": 0.5}) == ["c", "a", "b"]


def test_cascade_is_ordered_on_rows_that_pass_the_base_rule(spark):
    rng = random.Random(41)
    # the costly rule rejects most rows, but only rows that the base rule has rejected before
    texts = ["short text"] * 300 + [prose(rng, 30, 500) for _ in range(60)] + [prose(rng, 30, 500) + " ###" for _ in range(60)]
    docs = documents(spark, [(None if k % 2 else k, t, "s") for k, t in enumerate(texts)])
    slow = " or ".join(f"size(filter(words, w -> rlike(w, '^(s{k}|t)ext$'))) > 0" for k in range(6))
    assert quality.order_rules(docs, "doc_id", "text", {"short": slow, "marked": "n_symbols > 2"}, 10_000) == ["marked", "short"]
    assert quality.order_rules(docs, "doc_id", "text", {}, 10_000) == []


def test_quality_keeps_labelled_good_documents(spark):
    rows = quality.judge(spark.read.parquet(f"{SF_MID}/documents.parquet")).join(spark.read.parquet(f"{SF_MID}/labels.parquet"), "doc_id").collect()
    assert all(r["kept"] or r["base_failed"] for r in rows if r["quality"] == 1)
    assert sum(not r["kept"] for r in rows if r["quality"] == 0) >= 0.8 * sum(r["quality"] == 0 for r in rows)


def test_quality_runs_no_python(spark):
    for plan in (quality.judge(spark.read.parquet(f"{SF_SMALL}/documents.parquet")),
                 sharding.stratified_shards(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", text)


def test_shards_are_even_and_keep_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    rng = random.Random(7)
    rows = [(k, f"text {k}" if k % 5 else rng.choice([None, "", "same"]), rng.choice(["hot"] * 5 + ["b", "c", None])) for k in range(1003)]
    rows += [(5, "same", "b")] * 9 + [(None, "é", "c")] * 2
    got = sharding.stratified_shards(documents(spark, rows).repartition(4), shards=16).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    counts = [len(by[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    sizes = collections.Counter(r[2] for r in rows)
    for s in sizes:
        found = [sum(r["source"] == s for r in x) for x in by.values()]
        assert max(found) - min(found) <= 2
    import zlib
    truth = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == truth
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    assert sharding.stratified_shards(documents(spark, [])).collect() == []


def tiktoken_encoding():
    import tiktoken
    path, pattern = queries.vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_vocabulary(path).ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, monkeypatch):
    rng = random.Random(0)
    texts = [None, "", " ", "a" * 3000, " " * 300 + "x", "\n\n \n x", "é" * 200, "<|endoftext|>", "don't  we'll\t\r\nx  y\x1cz"]
    texts += ["".join(rng.choice("ab éüßñ\n 1'日本🎉.!") for _ in range(rng.randrange(300))) for _ in range(150)]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(None, "null id", "s")] * 2
    enc = tiktoken_encoding()
    got = bpe.encode_and_decode(documents(spark, rows), *queries.vocabulary(), with_ids=True).collect()
    assert len(got) == len(rows)
    table = dict((i, t or "") for i, t, _ in rows)
    for r in got:
        ids = enc.encode_ordinary(table[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(table[r["doc_id"]].encode()).hexdigest()
    ids = bpe.token_ids(documents(spark, rows), *queries.vocabulary())
    assert {r["doc_id"]: r["text"] for r in bpe.decode_ids(ids, queries.vocabulary()[0]).collect()} == table
    assert bpe.encode_and_decode(documents(spark, []), *queries.vocabulary()).collect() == []
    monkeypatch.setattr(bpe, "LONG_TEXT", 40)
    encoder = bpe.Encoder(*queries.vocabulary())
    assert [r[0] for r in encoder.many([t or "" for t in texts])] == [len(enc.encode_ordinary(t or "")) for t in texts]


def test_long_and_short_segment_trees_agree():
    vocab = bpe.load_vocabulary(queries.vocabulary()[0])
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"abcdeth in") for _ in range(rng.randrange(2, 33))) for _ in range(500)]
    assert bpe.encode_rows(vocab, pieces, 32) == [bpe.encode_long(vocab, p) for p in pieces]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P
    rng = random.Random(12)
    rows, labels = labelled(rng, 200)
    long = prose(rng, 120, 10 ** 6)
    rows += [(500, rows[1][1], "t"), (501, rows[1][1] + " more", "t"), (502, prose(rng, 30) + long, "t"), (503, prose(rng, 25) + long + " é", "u"),
             (504, None, None), (505, "", "u"), (None, "a text without id", "u"), (None, "a text without id", "u"), (506, "twice the same row", "u"),
             (506, "twice the same row", "u")]
    docs = documents(spark, rows)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)

    def step(k, df):
        out = P.STAGES[k][1](spark, df, sf)
        out.write.parquet(str(tmp_path / f"stage{k}"))
        return spark.read.parquet(str(tmp_path / f"stage{k}"))

    a = step(0, docs)
    assert a.columns == docs.columns
    assert sorted(r["doc_id"] for r in a.collect() if r["doc_id"] is not None) == sorted(i for i, _, _ in rows if i is not None and not (i < 200 and i % 4 == 0))
    b = step(1, a)
    left = [(r["doc_id"], r["text"], None) for r in a.collect()]
    truth = jaccard_components(left)
    assert sorted(r["doc_id"] for r in b.collect() if r["doc_id"] is not None) == sorted(i for i, (_, c) in truth.items() if i == c)
    assert sum(r["doc_id"] is None for r in b.collect()) == 1 and b.columns == docs.columns
    c = step(2, b)
    before, after = ({r["doc_id"]: r for r in x.collect()} for x in (b, c))
    removed = without_repeats([r["text"] for r in before.values()], P.LENGTH)
    for (i, r), (n, gone, _, sha) in zip(before.items(), removed):
        assert hashlib.sha256(after[i]["text"].encode()).hexdigest() == sha and after[i]["n_chars"] == len(after[i]["text"])
        assert after[i]["source"] == r["source"]
    assert sum(x[1] for x in removed) > 0 and c.columns == docs.columns
    d = step(3, c)
    assert d.columns == docs.columns and {r["doc_id"] for r in d.collect()} <= set(after)
    e = P.STAGES[4][1](spark, d, sf).collect()
    enc = tiktoken_encoding()
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in e) == collections.Counter(
        (r["doc_id"], tuple(enc.encode_ordinary(r["text"]))) for r in d.collect())


def test_pipeline_cuts_passages_of_51_short_words(spark):
    import corpus_pipeline as P
    rng = random.Random(13)
    for width in (1, 3, 6):  # passages of 101, 203 and 356 bytes
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(width))
        passage, shorter = (" ".join(word() for _ in range(n)) for n in (51, 45))
        rows = [(k, f"{prose(rng, 30, 10 ** 6)} . {passage} ; {prose(rng, 20, 10 ** 6)}", "s") for k in range(2)]
        rows += [(10 + k, f"{prose(rng, 30, 10 ** 6)} . {shorter} ; {prose(rng, 20, 10 ** 6)}", "s") for k in range(2)]
        rows += [(20 + k, f"{prose(rng, 30, 10 ** 6)} . {'長い文' * 50} ; {prose(rng, 20, 10 ** 6)}", "s") for k in range(2)]
        got = {r["doc_id"]: r["text"] for r in P.cut_repeats(spark, documents(spark, rows), "").collect()}
        for k in range(2):
            assert passage not in got[k] and len(got[k].split()) <= 52
            assert got[10 + k] == rows[2 + k][1]
            assert "長い文" not in got[20 + k]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []


def test_rows_without_an_id_draw_by_their_text(spark):
    docs = documents(spark, [(None, f"text {k}", "s") for k in range(300)] + [(k, f"text {k}", "t") for k in range(300)])
    got = collections.Counter((r["doc_id"] is None, r["text"]) for r in mixing.mix(docs, weights={"s": 3.0, "t": 1.0}).collect())
    drawn = [got[True, f"text {k}"] for k in range(300)]
    assert 380 < sum(drawn) < 520 and len(set(drawn)) > 3  # 450 expected, no common number
    assert sum(n for (none, _), n in got.items() if not none) < 200
