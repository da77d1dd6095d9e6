"""Main text of web pages by a site style tree.

Pages of one host are merged: nodes with the same path of (tag, classes) are one
node of the host's style tree. A node's presentation styles (the sequence of its
child tags) and its content features (the texts of its blocks) are counted over
the host's pages, and with m pages

  presentation = H(styles) / log m              (all alike: 0, all different: 1)
  content      = 1 - mean(log pages of a feature) / log m   (everywhere: 0)
  importance   = GAMMA * content of the blocks below + (1 - GAMMA) * presentation

weights the content by characters. A branch seen on at least ``MIN_PAGES`` pages
with importance below ``LEAST`` is a template: it is removed from each page.
Elements and roles that are no article by HTML itself (navigation, header and
footer of the page, asides, forms, scripts, ...) have importance 0 on every page.
A listed word (ad, comments, cookie, ...) that is a whole class or id lowers the
importance of its branch to 0 too, which also serves hosts of one page; but not of
headings by their id, nor of a branch that holds the page's one article or, unless
that article stands elsewhere, more than half of the text (a form counts as such a
word, as some sites wrap the page in one).

Below an <article> or <main> the tree decides as elsewhere, with a test on the
whole: where the article's own node is of low importance (copies of one article
on a host) its branches stay. What lies beside a marked article is left out when
the marked blocks hold at least half of the remaining text, unless the tree has
seen its branch on ``MIN_PAGES`` pages and found it important. If nothing would be
left, the statistics are disregarded, then the words, then the elements.

Scale: pages are parsed where they are scanned; only (host, path, hashes) rows,
written to the shared folder, are counted, with partial sums in each task, so a host with a third of all pages
is counted by all tasks. Entropies are sums of c log c, so no node's features
are gathered. Each page then gets the paths of its own low branches, and is
parsed once more for its text; the html is shuffled once for that join.

Defined results: a null or empty html, or one without text, gives an empty
string; a null url is a host of its own; a null id is passed through; repeated
rows count as pages and get equal texts; unclosed and stray tags are repaired as
browsers do (implied ends); an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import html as html_lib
import os
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunning.llm.graph import shared_folder

MIN_PAGES = 3
LEAST = 0.25
GAMMA = 0.9
DEPTH = 64  # levels that paths tell apart

# Fixed values of HTML: elements without content, elements that are raw text, blocks, implied ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
BLOCK = frozenset(("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
                   "ul caption option select button").split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
# Elements, roles and class or id words that HTML authors use for what is no article.
NOISE_TAGS = frozenset("head nav footer aside form button select menu dialog fieldset".split()) | RAW
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar "
                         "navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal overlay newsletter "
                         "subscribe subscription comment comments disqus reply replies share sharing social related recommended widget toolbar "
                         "pagination pager login signup skip").split())
COMMENT_WORDS = frozenset("comment comments reply replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PAGE_PARTS = frozenset("html body main".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")


@dataclass
class Node:
    tag: str
    path: str
    noise: bool            # by an element, a role or a word
    hard: bool             # by an element or a role
    article: str           # path of the outermost <article> or <main> round it
    number: int = 0        # order of the start tags
    chars: int = 0         # of the text below, where the node is watched


@dataclass
class Block:
    path: str
    noise: bool
    hard: bool
    article: str
    text: str

    @property
    def main(self) -> bool:
        return bool(self.article)


def _hard_noise(tag: str, attributes: dict[str, str], parent: Node) -> bool:
    if tag in NOISE_TAGS:
        return tag != "form"
    if tag in PAGE_PARTS or tag == "article":
        return False
    if tag == "header":
        return not parent.article
    return ("hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower()
            or attributes.get("role", "").lower() in NOISE_ROLES)


def _listed(tag: str, attributes: dict[str, str]) -> bool:
    """Whether a whole class or id says that the branch is no article (or it is a form)."""
    if tag == "form":
        return True
    if tag in PAGE_PARTS or tag == "header":
        return False
    names = set(attributes.get("class", "").lower().split())
    if tag not in HEADINGS:
        names.update(attributes.get("id", "").lower().split())
    return bool(names & (COMMENT_WORDS if tag == "article" else NOISE_WORDS))


def parse(html: str | None) -> tuple[list[Block], dict[str, list[str]]]:
    """The text blocks of a page in order, and the child tags of each path."""
    blocks, styles, spared = _parse(html, frozenset())
    return _parse(html, spared)[:2] if spared else (blocks, styles)


def _parse(html: str | None, spare: frozenset[int]) -> tuple[list[Block], dict[str, list[str]], frozenset[int]]:
    """Blocks, child tags, and the numbers of the listed nodes that hold the one article or most of the text;
    nodes of ``spare`` are not listed."""
    blocks: list[Block] = []
    styles: dict[str, list[str]] = {}
    stack: list[Node] = [Node("", "", False, False, "")]
    watched: list[tuple[int, Node]] = []                # (depth, node) of open listed nodes and outermost articles
    listed: list[Node] = []
    articles: list[tuple[Node, list[int]]] = []         # with the listed nodes round them
    total = 0
    text: list[str] = []
    owner = stack[0]

    def flush() -> None:
        if text:
            joined = " ".join(html_lib.unescape("".join(text)).split())
            text.clear()
            if joined:
                blocks.append(Block(owner.path, owner.noise, owner.hard, owner.article, joined))

    def close(depth: int) -> None:
        if any(n.tag in BLOCK for n in stack[depth:]):
            flush()
        del stack[depth:]
        while watched and watched[-1][0] >= depth:
            watched.pop()

    def add(raw: str) -> None:
        nonlocal owner, total
        top = stack[-1]
        if raw and not top.hard:
            n = len(raw.strip())
            total += n
            for _, node in watched:
                node.chars += n
        base = next(n for n in reversed(stack) if n.tag in BLOCK or not n.tag)
        if raw and (base.noise or not top.noise):  # else a marked phrase inside a block
            if base is not owner:
                flush()
                owner = base
            text.append(raw)

    source, at, number = html or "", 0, 0
    while at < len(source):
        found = TOKEN.search(source, at)
        if not found:
            add(source[at:])
            break
        add(source[at:found.start()])
        at = found.end()
        ending, tag, rest = found.group(1), (found.group(2) or "").lower(), found.group(3) or ""
        if not tag:
            continue
        if ending:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                close(depth)
            continue
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
        limit = {"table", "ul", "ol", "dl", "article", "section", "div", "main", "body", "aside", "nav", "select"} - {tag}
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in shut:
                close(depth)
            elif stack[depth].tag in limit:
                break
        if tag in BLOCK:
            flush()
        if tag == "br":
            add(" ")
        parent = stack[-1]
        attributes = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(rest)}
        classes = sorted(re.sub(r"\d+", "0", attributes.get("class", "")).split())
        path = parent.path + "/" + ".".join([tag, *classes]) if len(stack) <= DEPTH else parent.path  # deeper nodes merge
        number += 1
        hard = parent.hard or _hard_noise(tag, attributes, parent)
        word = number not in spare and _listed(tag, attributes)
        marks = tag in ("article", "main") and not parent.article
        node = Node(tag, path, parent.noise or hard or word, hard, parent.article or (path if marks else ""), number)
        styles.setdefault(parent.path, [])
        if styles[parent.path][-1:] != [tag]:
            styles[parent.path].append(tag)
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:  # raw text: no tags inside
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if (word or marks) and not hard:
            if marks and not word:
                articles.append((node, [n.number for _, n in watched]))
            if word:
                listed.append(node)
            watched.append((len(stack), node))
        stack.append(node)
    flush()
    if len(articles) == 1 and articles[0][0].chars:
        spared = {n.number for n in listed}.intersection(articles[0][1])
        spared |= {n.number for n in listed if 2 * n.chars > total and n.article == articles[0][0].path}
    else:
        spared = {n.number for n in listed if 2 * n.chars > total}
    return blocks, styles, frozenset(spared)


def _prefixes(path: str) -> list[str]:
    parts = path.split("/")[1:]
    return ["/" + "/".join(parts[:k]) for k in range(1, len(parts) + 1)]


def host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found.group(1).lower() if found else ""


def _nodes(batches):
    """(key, host, path, style, features, chars): a row per page and path."""
    import xxhash

    schema = pa.schema([("key", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("style", pa.int64()),
                        ("features", pa.list_(pa.int64())), ("chars", pa.int64())])
    signed = lambda x: x - (1 << 63)
    for batch in batches:
        rows = []
        for key, url, html in zip(*(c.to_pylist() for c in batch.columns)):
            blocks, styles = parse(html)
            texts: dict[str, dict[int, int]] = {}
            for b in blocks:
                texts.setdefault(b.path, {})[signed(xxhash.xxh3_64_intdigest(b.text.lower()))] = len(b.text)
            for path in {p for q in (*styles, *texts) for p in _prefixes(q)}:
                found = texts.get(path, {})
                rows.append((key, host_of(url), path, signed(xxhash.xxh3_64_intdigest(" ".join(styles.get(path, [])))),
                             list(found), sum(found.values())))
        columns = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def style_tree(nodes: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of every node of the hosts' style trees."""
    at = ["host", "path"]
    clog = F.sum(F.col("c") * F.log("c")).alias("clogc")
    styles = (nodes.groupBy(*at, "style").agg(F.count(F.lit(1)).alias("c"), F.sum("chars").alias("chars"))
              .groupBy(*at).agg(F.sum("c").alias("pages"), F.sum("chars").alias("chars"), clog))
    log_m = F.log("pages")
    styles = styles.select(*at, "pages", "chars", F.when(F.col("pages") > 1, (log_m - F.col("clogc") / F.col("pages")) / log_m)
                           .otherwise(F.lit(1.0)).alias("presentation"))
    features = (nodes.select(*at, F.explode("features").alias("feature")).groupBy(*at, "feature").agg(F.count(F.lit(1)).alias("c"))
                .groupBy(*at).agg(F.sum("c").alias("n"), clog).select(*at, (F.col("clogc") / F.col("n")).alias("spread")))
    own = (styles.join(features, at, "left")
           .withColumn("content", F.when((F.col("pages") > 1) & F.col("spread").isNotNull(), 1 - F.col("spread") / log_m).otherwise(F.lit(1.0))))
    parts = F.split(F.substring("path", 2, 1 << 20), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))
    below = (own.select("host", F.explode(ancestors).alias("path"), "chars", (F.col("content") * F.col("chars")).alias("weighted"))
             .groupBy(*at).agg(F.sum("chars").alias("below"), F.sum("weighted").alias("weighted")))
    return (own.join(below, at)
            .select(*at, "pages", (GAMMA * F.when(F.col("below") > 0, F.col("weighted") / F.col("below")).otherwise(F.lit(0.0))
                                   + (1 - GAMMA) * F.col("presentation")).alias("importance")))


def page_text(html: str | None, low: list[str] | None, high: list[str] | None = None) -> str:
    """The text without noise and branches ``low``; ``high`` are paths beside articles that the tree finds important."""
    every = parse(html)[0]
    blocks = [b for b in every if not b.noise]
    branches, known = set(low or ()), set(high or ())

    def stays(b: Block) -> bool:
        if b.article in branches:  # copies of one article
            return True
        return not branches.intersection(p for p in _prefixes(b.path) if len(p) > len(b.article))

    kept = [b for b in blocks if stays(b)]
    marked = [b for b in kept if b.main]
    if 2 * sum(len(b.text) for b in marked) >= sum(len(b.text) for b in kept):
        kept = [b for b in kept if b.main or b.path in known] if marked else kept
    fallback = [b for b in blocks if b.main] or blocks or [b for b in every if not b.hard] or every
    return "\n".join(b.text for b in (kept or fallback))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              min_pages: int = MIN_PAGES, least: float = LEAST) -> DataFrame:
    """One row per page: id, url, ``text`` (blocks joined by \\n), ``n_chars`` (code points)."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("key", F.xxhash64("id", "url", "html"))
    nodes = rows.select("key", "url", "html").mapInArrow(
        _nodes, "key long, host string, path string, style long, features array<long>, chars long")
    # read by four aggregates and the join: parsed once, kept as a small table in the shared folder
    folder = os.path.join(shared_folder(pages.sparkSession), f"style-tree-{uuid.uuid4().hex}")
    nodes.write.parquet(folder)
    nodes = pages.sparkSession.read.parquet(folder)
    known = (style_tree(nodes).where(F.col("pages") >= min_pages).select("host", "path", (F.col("importance") < least).alias("is_low"))
             .where(F.col("is_low") | ~F.col("path").rlike(r"/(article|main)([./]|$)")))
    own = (nodes.join(known, ["host", "path"]).where("is_low or chars > 0").groupBy("key")
           .agg(F.collect_set(F.when(F.col("is_low"), F.col("path"))).alias("low"),
                F.collect_set(F.when(~F.col("is_low"), F.col("path"))).alias("high")))

    out = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, T.StringType()),
                        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [page_text(*page) for page in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=out.names)

    return rows.join(own, "key", "left").select("id", "url", "html", "low", "high").mapInArrow(run, out)
