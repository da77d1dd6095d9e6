"""Toxicity scores: a weighted lexicon learned from labels, matched by Levenshtein
automata on a trie, with context windows that tell quotation from abuse.

Learning (a bounded sample of labelled rows, ``max_rows``): one row per family of
near copies stays (equal smallest 5-word shingle under either of two hashes),
then every word's toxic and clean document counts are taken. For words of equal
document frequency, the number with t toxic documents is compared with what a
binomial of the base rate gives; the surplus is the share of real terms at
(frequency, t), a local false-discovery rate. A word whose share is at least
``LEAST`` becomes a term with that probability. A second pass over the sample
measures how often documents are toxic that hold one term alone (by term), or no
plain exact match but a misspelled one (by term) or a quoted one (overall).

Scoring: each distinct word of a text runs as a Levenshtein automaton (its
states are bit masks, one mask per error) along the trie of the terms, after
sets of term parts have excluded most words: one of k + 1 parts of a term must
be intact if k edits suffice. Allowed edits of a term: 0 below five letters, 1 below nine,
else 2. A match counts as quoted if a quotation mark opens before and closes
after it inside the window, or a word of report stands in the window. The score
is 1 - prod(1 - p) over the matched terms, each with its best match.

Scale: whole texts are scored in one map over the scan, no shuffle of texts;
what travels is the sample's word counts. The lexicon holds words of the sample
only, so it is bounded by ``max_rows``, whatever the table. A worker's word table is bounded.

Words: a text is cut at white space; a token counts as the word between its outer
marks and, where marks stand inside, as the words between these too. No length is cut.

Defined results: null, empty and word-less texts score 0; null labels and labels
of unknown ids teach nothing; a document labelled twice counts as toxic if one
label says so; without toxic labels every score is 0; repeated rows get equal
scores; very long texts and tokens are scored whole, in time linear in their length
for a given lexicon; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunning.llm.graph import freeing

MAX_ROWS = 50_000     # labelled rows that learning uses at most
LEAST = 0.5           # least share of real terms at a word's counts
UNSEEN = 0.6          # toxic share of a term's misspellings if the sample has none
WINDOW = 6            # words of context on either side
KNOWN_MAX = 400_000   # words that a worker remembers
LONG_TOKEN = 64       # longer tokens are looked up each time, not remembered

# Quotation marks, words of report and digit-for-letter spellings.
QUOTES = "\"“”„«»‹›"
REPORT = {"said", "says", "called", "calls", "wrote", "writes", "quote", "quoted", "quotes", "quoting", "word", "term"}
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")

MARKS = re.compile(r"[\W_]+")


def bare(token: str) -> str:
    """A token without its outer marks."""
    if token.isalnum():
        return token
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while a < b and not token[b - 1].isalnum():
        b -= 1
    return token[a:b]


def allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


@dataclass
class Lexicon:
    """Terms with their probability, and what the second pass measured."""

    terms: dict[str, float] = field(default_factory=dict)
    alone: dict[str, float] = field(default_factory=dict)       # the only term of a document
    misspelled: dict[str, float] = field(default_factory=dict)
    quoted: float = 0.5


def automaton_matches(trie: dict, word: str, most: int) -> list[tuple[str, int]]:
    """Terms within their allowed edits of ``word``: the word's Levenshtein automaton
    run along the trie. ``state[e]`` has bit i set if the path so far matches the
    first i letters of the word with e edits; an empty state ends the branch."""
    n = len(word)
    full = (1 << (n + 1)) - 1
    at: dict[str, int] = {}
    for i, letter in enumerate(word):
        at[letter] = at.get(letter, 0) | 1 << i
    found = []
    stack = [(trie, tuple((1 << (e + 1)) - 1 & full for e in range(most + 1)))]
    while stack:
        node, state = stack.pop()
        for letter, child in node.items():
            if letter == "":
                for e, mask in enumerate(state):
                    if mask >> n & 1:
                        if e <= allowed(len(child)):
                            found.append((child, e))
                        break
                continue
            here, new, before, below = at.get(letter, 0), [], 0, 0
            for mask in state:
                below = ((mask & here) << 1 | before | before << 1 | below << 1) & full
                new.append(below)
                before = mask
            if new[-1]:
                stack.append((child, tuple(new)))
    return found


class Matcher:
    """Looks words up in a lexicon; remembers a bounded number of them."""

    def __init__(self, terms, remembered: int = KNOWN_MAX):
        self.terms = set(terms)
        self.trie: dict = {}
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        self.middles: dict[int, set[str]] = {}
        for term in self.terms:
            edits = allowed(len(term))
            if not edits:
                continue
            node = self.trie
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = term
            cuts = [len(term) * k // (edits + 1) for k in range(edits + 2)]
            parts = [term[a:b] for a, b in zip(cuts, cuts[1:])]
            self.heads.setdefault(len(parts[0]), set()).add(parts[0])
            self.tails.setdefault(len(parts[-1]), set()).add(parts[-1])
            if edits == 2:
                self.middles.setdefault(len(parts[1]), set()).add(parts[1])
        self.longest = max(map(len, self.terms), default=0)
        self.found: dict[str, list[tuple[str, int]]] = {}  # matches of tokens that have some
        self.hit: set[str] = set()
        self.clean: set[str] = set()
        self.remembered = remembered

    def possible(self, word: str) -> bool:
        return (any(word[:k] in parts for k, parts in self.heads.items())
                or any(word[-k:] in parts for k, parts in self.tails.items())
                or any(word[i:i + k] in parts for k, parts in self.middles.items() for i in range(len(word) - k + 1)))

    def near(self, word: str) -> list[tuple[str, int]]:
        """(term, edits) of a word, with at least one edit."""
        # a term of nine letters is the shortest that allows two edits: seven letters may be left of it
        if 4 <= len(word) <= self.longest + 2 and self.possible(word):
            return automaton_matches(self.trie, word, 2 if len(word) >= 7 else 1)
        return []

    def look_up(self, token: str) -> list[tuple[str, int]]:
        """(term, edits) of a token as it stands between spaces, lower case: the word itself, its plain
        spelling, the words between its inner marks, else what is near the word, else near those."""
        word = bare(token)
        if word in self.terms:
            return [(word, 0)]
        if word.isalpha():
            return self.near(word)
        plain = MARKS.sub("", token.translate(LOOKALIKE))
        if plain in self.terms:
            return [(plain, 1)]
        parts = set() if word.isalnum() else set(MARKS.split(word))
        return sorted((part, 0) for part in parts & self.terms) or self.near(word) or sorted({m for part in parts for m in self.near(part)})

    def hits(self, tokens: list[str]) -> dict[str, list[tuple[str, int]]]:
        """Matches by token."""
        distinct = set(tokens)
        if len(self.clean) + len(self.found) > self.remembered:
            self.clean.clear()
            self.found.clear()
            self.hit.clear()
        out = {token: self.found[token] for token in distinct & self.hit}
        for token in distinct - self.clean - self.hit:
            match = self.look_up(token)
            if match:
                out[token] = match
            if len(token) <= LONG_TOKEN:
                if match:
                    self.found[token] = match
                    self.hit.add(token)
                else:
                    self.clean.add(token)
        return out


def tokens_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def is_quoted(tokens: list[str], at: int) -> bool:
    lo, hi = max(0, at - WINDOW), min(len(tokens), at + WINDOW + 1)
    before = any(q in t for t in tokens[lo:at] for q in QUOTES) or tokens[at][:1] in QUOTES
    after = any(q in t for t in tokens[at + 1:hi] for q in QUOTES) or tokens[at][-1:] in QUOTES
    return before and after or any(bare(t) in REPORT for t in tokens[lo:hi])


def matches(matcher: Matcher, text: str | None) -> dict[tuple[str, int, bool], int]:
    """(term, edits, quoted) -> number of matches in a text."""
    tokens = tokens_of(text)
    found = matcher.hits(tokens)
    out: Counter = Counter()
    if found:
        for at, token in enumerate(tokens):
            if token in found:
                quoted = is_quoted(tokens, at)
                for term, edits in found[token]:
                    out[term, edits, quoted] += 1
    return out


def score(lexicon: Lexicon, found) -> float:
    best: dict[str, float] = {}
    alone = len({term for term, edits, quoted in found if not edits and not quoted}) < 2
    for term, edits, quoted in found:
        p = lexicon.alone.get(term, lexicon.terms[term]) if alone else lexicon.terms[term]
        if edits:
            p *= lexicon.misspelled.get(term, UNSEEN)
        if quoted:
            p *= lexicon.quoted
        best[term] = max(best.get(term, 0.0), p)
    return 1.0 - math.prod(1.0 - p for p in best.values())


def _families(batches):
    """(id, toxic, key1, key2): smallest 5-word shingle of each text under two hashes."""
    import xxhash

    for batch in batches:
        keys = []
        for text in batch.column(2).to_pylist():
            words = tokens_of(text)
            grams = {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}
            keys.append([min(xxhash.xxh3_64_intdigest(g, seed=s) for g in grams) - (1 << 63) for s in (1, 2)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k[0] for k in keys], pa.int64()),
                                          pa.array([k[1] for k in keys], pa.int64())], names=["id", "toxic", "key1", "key2"])


def _word_counts(batches):
    counts: dict[str, list[int]] = {}

    def flush():
        rows = [(w, c[1], c[0]) for w, c in counts.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in
                                           ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))], names=["word", "t", "c"])

    for batch in batches:
        for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for word in {bare(x) for x in set(tokens_of(text))}:
                if len(word) >= 2:
                    counts.setdefault(word, [0, 0])[toxic] += 1
            if len(counts) > 500_000:
                yield flush()
    yield flush()


def _real_shares(cells: list, base: float) -> dict[tuple[int, int], float]:
    """Share of real terms among words with t toxic of d documents, by (d, t): one minus
    the words that a binomial of the base rate expects over the words seen, for this or
    more toxic documents. High frequencies are pooled (frequency classes a tenth apart)."""
    pools: dict[int, list] = {}
    for d, t, n in cells:
        pools.setdefault(d if d < 20 else 20 + int(math.log(d / 20) / math.log(1.1)), []).append((d, t, n))
    out = {}
    for pool in pools.values():
        words: Counter = Counter()
        for d, _, n in pool:
            words[d] += n
        for d, t, _ in pool:
            if t < 2 or t / d < 2 * base:
                continue
            z = t / d
            expected = sum(n * _tail(k, max(1, math.ceil(z * k)), base) for k, n in words.items())
            seen = sum(n for k, s, n in pool if s / k >= z)
            out[d, t] = max(0.0, 1 - expected / seen) * (t + 0.5 * base) / (d + 0.5)
    return out


def _tail(n: int, least: int, p: float) -> float:
    """P(X >= least) for a binomial (n, p); above 20 its Chernoff bound, which is never too small."""
    if n < 20:
        return sum(math.comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(least, n + 1))
    share = least / n
    if share <= p:
        return 1.0
    rest = (1 - share) * math.log((1 - share) / (1 - p)) if share < 1 else 0.0
    return math.exp(-n * (share * math.log(share / p) + rest))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = MAX_ROWS) -> Lexicon:
    """Lexicon from at most ``max_rows`` labelled rows, chosen by a hash of the id."""
    spark = docs.sparkSession
    marked = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(max_rows).toPandas()  # bounded by max_rows

    def rows(ids: pd.DataFrame) -> DataFrame:
        side = F.broadcast(spark.createDataFrame(ids, "id long, toxic int"))  # bounded by max_rows
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        return texts.join(side, "id").select("id", "toxic", "text")

    if not (chosen["toxic"] > 0).any() or not (chosen["toxic"] <= 0).any():
        return Lexicon()
    chosen["toxic"] = (chosen["toxic"] > 0).astype("int32")
    families = rows(chosen).mapInArrow(freeing(_families), "id long, toxic int, key1 long, key2 long").toPandas()
    families = families.sort_values("id").drop_duplicates("key1").drop_duplicates("key2")[["id", "toxic"]].drop_duplicates("id")
    n_toxic, n = int(families["toxic"].sum()), len(families)
    if not 0 < n_toxic < n:
        return Lexicon()

    words = (rows(families).mapInArrow(freeing(_word_counts), "word string, t long, c long").groupBy("word")
             .agg(F.sum("t").alias("t"), F.sum("c").alias("c")).withColumn("d", F.col("t") + F.col("c")).persist())
    cells = [(r["d"], r["t"], r["n"]) for r in words.groupBy("d", "t").agg(F.count(F.lit(1)).alias("n")).collect()]
    shares = {k: v for k, v in _real_shares(cells, n_toxic / n).items() if v >= LEAST}  # cells: bounded by max_rows
    if not shares:
        words.unpersist()
        return Lexicon()
    keep = F.broadcast(spark.createDataFrame([(*k, v) for k, v in shares.items()], "d long, t long, share double"))
    terms = words.join(keep, ["d", "t"]).orderBy(F.desc("share"), F.desc("t"), "word").collect()  # words of the sample
    lexicon = Lexicon({r["word"]: r["share"] for r in terms})
    words.unpersist()

    names = list(lexicon.terms)

    def second(batches):
        matcher, seen = Matcher(names), Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = matches(matcher, text)
                plain = {t for t, e, q in found if not e and not q}
                if len(plain) == 1:
                    seen["alone", plain.pop(), toxic] += 1
                elif not plain and any(not e for _, e, _ in found):
                    seen["quoted", "", toxic] += 1
                elif not plain:
                    for term in {t for t, _, _ in found}:
                        seen["misspelled", term, toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
                                          pa.array([k[2] for k in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())],
                                         names=["kind", "term", "toxic", "n"])

    measured: dict[str, dict[str, list[int]]] = {"alone": {}, "quoted": {}, "misspelled": {}}
    for r in (rows(families).mapInArrow(freeing(second), "kind string, term string, toxic long, n long").groupBy("kind", "term", "toxic")
              .agg(F.sum("n").alias("n")).collect()):  # four rows a term at most
        measured[r["kind"]].setdefault(r["term"], [0, 0])[r["toxic"]] += r["n"]

    def share(kind: str, term: str, prior: float, weight: float) -> float:
        """Toxic share of the documents counted for a term, with ``weight`` documents of the prior share."""
        clean, toxic = measured[kind].get(term, (0, 0))
        return (toxic + weight * prior) / (toxic + clean + weight)

    lexicon.quoted = share("quoted", "", 0.5, 1)
    lexicon.misspelled = {t: share("misspelled", t, UNSEEN, 1) for t in measured["misspelled"]}
    clean, toxic = (sum(c[k] for c in measured["alone"].values()) for k in (0, 1))
    overall = (toxic + 0.75) / (toxic + clean + 1)
    lexicon.alone = {t: share("alone", t, overall, 2) for t in lexicon.terms}
    return lexicon


def score_column(lexicon: Lexicon, text_col: str, remembered: int = KNOWN_MAX):
    """Column of scores (0 to 1) of a text column. A worker remembers ``remembered`` words at most."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from freeing(scored)(batches)

    def scored(batches):
        matcher = Matcher(lexicon.terms, remembered)
        for texts in batches:
            yield pd.Series([score(lexicon, matches(matcher, t)) for t in texts], dtype="float64")

    return F.coalesce(scores(F.col(text_col).cast("string")), F.lit(0.0))


def held_out(id_col: str):
    """True for rows that learning must not use: crc32 of the id as text divisible by 5 (or no id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted`` (1 if score >= 0.5).
    The lexicon is learned from the labels of rows that are not held out."""
    lexicon = learn(docs, labels.where(~held_out(id_col)), id_col, text_col, label_col)
    scored = docs.select(id_col, held_out(id_col).alias("held_out"), score_column(lexicon, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
