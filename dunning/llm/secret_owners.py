"""Secret scan by corpus-wide ownership frequency.

Every text is searched for credential-shaped values: three kinds of *base* spans
(``assign``, ``access``, ``hex``) and *bare* values, long runs of base64 and
identifier characters outside assignments. The 128-bit digests of all values are
aggregated over the corpus: distinct (owner, repository) pairs first, then
repositories per (digest, owner), then owners and repositories per digest. A value
that ``EXAMPLE_OWNERS`` owners or more hold is a widely copied example; one of
fewer owners that looks live (``LIVE``) is an owner-specific credential. Base spans
stay whatever the verdict; bare values are added as spans of kind ``owned`` if
they are owner-specific and look live. A document stands for a repository and its
source for the owner unless other columns are named.

Positions come from the pieces between matches: ``split`` and ``regexp_extract_all``
of one pattern alternate, so the end of a match is a running total of lengths.
Totals are taken in blocks of ``RUN`` matches, so a text of very many matches costs
little more than one pass.

Scale: one scan of the texts; what it finds (no text) is written to the shared
checkpoint folder under a row number, and all else works on that. A value that
a third of all rows hold is one row per task before each exchange of the counts; its
rows meet the verdict in a plain equi join that adaptive execution splits. No
Python runs anywhere.

Defined results: a null or empty text has no spans; a null id or owner is a
repository or owner of its own; repeated rows count as one repository and each
get the same result; an empty table gives an empty result; other columns are
ignored; texts of any length are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunning.llm.graph import cut


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base patterns (leftmost matches, too short ones dropped afterwards).
WORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
PREFIX = rf"""({WORDS})["']?\x20*[:=]\x20*["']?"""
ASSIGN = PREFIX + "([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"  # "AKIA" and a run, 20 characters in all: a longer match never starts inside a shorter one
HEX = "[0-9a-f]{24,}"

#: A bare value: a run outside assignments (the first branch takes assignments away).
BARE = rf"""(?:{PREFIX}[A-Za-z0-9+/_.=-]+)|([A-Za-z0-9+/_=-]{{20,}})"""
#: What a bare value must not contain, so that it never overlaps a base span.
BASE_INSIDE = f"{WORDS}|AKIA|{HEX}"
#: A value looks live if it holds a digit, letters, and this many different characters.
LIVE_CHARACTERS = 8
#: A bare value must also mix cases, which words joined by dashes or slashes rarely do.
MIXED = ("[0-9]", "[A-Z]", "[a-z]")
EXAMPLE_OWNERS = 3
RUN = 256
KINDS = ("assign", "access", "hex", "owned")


def _ends(lengths: Column) -> Column:
    """Running totals of an array of longs, block by block."""
    zero, empty = F.lit(0).cast("long"), F.array().cast("array<long>")
    size = F.size(lengths)
    block = lambda k: F.slice(lengths, k * RUN + 1, F.lit(RUN))

    def running(items: Column, start: Column) -> Column:
        return F.aggregate(items, empty, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), start) + x)))

    numbers = F.sequence(F.lit(0), F.floor((size - 1) / RUN).cast("int"))
    totals = F.transform(numbers, lambda k: F.aggregate(block(k), zero, lambda acc, x: acc + x))
    before = F.concat(F.array(zero), running(totals, zero))
    return F.flatten(F.transform(numbers, lambda k: running(block(k), F.get(before, k))))


def _found(rows: DataFrame, kind: str, pattern: str, group: int, keep) -> DataFrame:
    """Adds column ``kind``: array of (start, no, end, value), matches of ``pattern`` whose ``group`` passes ``keep``."""
    n, matches, values, ends = KINDS.index(kind), f"_{kind}_m", f"_{kind}_v", f"_{kind}_e"
    some = F.size(matches) > 0
    rows = rows.withColumn(matches, F.regexp_extract_all("_text", F.lit(pattern), 0))
    rows = rows.withColumn(values, F.when(some, F.regexp_extract_all("_text", F.lit(pattern), F.lit(group)) if group else F.col(matches)))
    pieces = F.split("_text", F.lit(pattern), -1)
    lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: (F.char_length(p) + F.char_length(m)).cast("long"))
    rows = rows.withColumn(ends, F.when(some, lengths))
    rows = rows.withColumn(ends, F.when(some, _ends(F.col(ends))))
    spans = F.transform(matches, lambda m, i: F.struct((F.get(ends, i) - F.char_length(m)).alias("start"), F.lit(n).alias("no"),
                                                       F.get(ends, i).alias("end"), F.get(values, i).alias("value")))
    none = F.array().cast("array<struct<start:bigint,no:int,end:bigint,value:string>>")
    return rows.withColumn(kind, F.when(some, F.filter(spans, lambda x: keep(x["value"]))).otherwise(none)).drop(matches, values, ends)


def _live(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, F.lit("")))) >= LIVE_CHARACTERS)


def _bare(value: Column) -> Column:
    mixed = F.lit(True)
    for x in MIXED:
        mixed = mixed & value.rlike(x)
    return (value != "") & mixed & ~value.rlike(BASE_INSIDE)


def _text_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["no"]), x["start"], x["end"])), ",")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
               repo_col: str | None = None) -> DataFrame:
    """One row per document, written to the shared folder: ``row``, ``id``, ``owner``, ``repo``, counts and digest of
    the base spans, and ``items``: (start, no, end, digest, live) of base and bare values."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(owner_col).alias("owner"), F.col(repo_col or id_col).alias("repo"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = _found(rows, "assign", ASSIGN, 2, lambda v: F.char_length(v) >= 6)
    rows = _found(rows, "access", ACCESS, 0, lambda v: F.lit(True))
    rows = _found(rows, "hex", HEX, 0, lambda v: F.lit(True))
    rows = _found(rows, "owned", BARE, 2, _bare)
    rows = rows.withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))
    item = lambda x: F.struct(x["start"].alias("start"), x["no"].alias("no"), x["end"].alias("end"),
                              F.unhex(F.md5(x["value"])).alias("digest"), _live(x["value"]).alias("live"))
    return cut(rows.select(
        F.monotonically_increasing_id().alias("row"), "id", "owner", "repo",
        F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), F.transform(F.concat("base", "owned"), item).alias("items")))


def ownership(items: DataFrame) -> DataFrame:
    """(digest, n_owners, n_repos) of rows (digest, owner, repo): distinct owners and (owner, repository) pairs."""
    each = items.select("digest", "owner", "repo").distinct().groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None,
         example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per document: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` (base spans and those of kind
    ``owned``), ``n_live`` (spans of owner-specific values that look live), ``n_examples`` (spans of widely copied values)."""
    found = candidates(docs, id_col, text_col, owner_col, repo_col)
    items = found.select("row", "owner", "repo", F.explode("items").alias("x")).select("row", "owner", "repo", "x.*")
    judged = items.join(ownership(items), "digest").withColumn("example", F.col("n_owners") >= example_owners)
    judged = judged.withColumn("specific", F.col("live") & ~F.col("example"))
    stays = judged.where((F.col("no") < KINDS.index("owned")) | F.col("specific"))
    per_row = stays.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "no", "end"))).alias("s"),
        F.count_if("specific").alias("n_live"), F.count_if("example").alias("n_examples"))
    none = F.lit(0).cast("long")
    return (found.drop("owner", "repo", "items").join(per_row, "row", "left")
            .select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256",
                    F.coalesce(_text_of(F.col("s")), F.lit("")).alias("spans"),
                    F.coalesce("n_live", none).alias("n_live"), F.coalesce("n_examples", none).alias("n_examples")))


def _sql_quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_spans(kind: str, pattern: str, group: int, keep: str) -> str:
    q = _sql_quoted(pattern)
    return f"""
{kind}_m AS (SELECT r, text, regexp_extract_all(text, {q}) AS m, regexp_extract_all(text, {q}, {group}) AS v,
    string_split_regex(text, {q}) AS p FROM t WHERE regexp_matches(text, {q})),
{kind}_e AS (SELECT r, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(v) AS v, unnest(p[1:len(m)]) AS p FROM {kind}_m),
{kind} AS (SELECT r, {KINDS.index(kind)} AS no, '{kind}' AS kind, v, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e
    FROM (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM {kind}_e) WHERE {keep}),"""


_MIXED_SQL = " AND ".join(f"regexp_matches(v, '{x}')" for x in MIXED)
ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
{_sql_spans("assign", ASSIGN, 2, "length(v) >= 6")}
{_sql_spans("access", ACCESS, 0, "true")}
{_sql_spans("hex", HEX, 0, "true")}
{_sql_spans("owned", BARE, 2, f"v <> '' AND {_MIXED_SQL} AND NOT regexp_matches(v, {_sql_quoted(BASE_INSIDE)})")}
every AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex UNION ALL SELECT * FROM owned),
held AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS n_owners FROM every JOIN t USING (r) GROUP BY v),
judged AS (SELECT r, no, kind, s, e, n_owners >= {EXAMPLE_OWNERS} AS example,
    n_owners < {EXAMPLE_OWNERS} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
    AND len(list_distinct(string_split(v, ''))) >= {LIVE_CHARACTERS} AS specific FROM every JOIN held USING (v)),
per AS (SELECT r, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e) FILTER (no < 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e) AS spans,
    count(*) FILTER (specific) AS n_live, count(*) FILTER (example) AS n_examples
  FROM judged WHERE no < 3 OR specific GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
  coalesce(n_examples, 0) AS n_examples
FROM t LEFT JOIN per USING (r)
"""
