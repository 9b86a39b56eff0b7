"""Main text of HTML pages by the maximum-scoring subsequence of tokens.

A page becomes a sequence of words (each scores positive) and tags (each scores negative); one linear
scan finds the contiguous region with the highest sum. The weights are learnt from labelled pages:
those that mark their own main text (`<article>`, `<main>`, role=main, itemprop=articleBody). A tag's
weight is how much rarer it is, per word, inside labelled main text than elsewhere. Regions that
markup names as something else (menus, headers, footers, asides, adverts, notices, forms, comments,
scripts, styles) score nothing and give no text, unless they hold the page's own main text (see tokens()).
Elements end where HTML has them end: p, li, dt, dd and parts of tables without end tags too.

The weights are fitted on at most `sample` different pages of up to MOST_BYTES each, chosen by a hash of
the page (documented bounds); all pages are extracted, whole.

Text: character references decoded; white space inside a block (`<br>` included) becomes one space,
trimmed; blocks are joined in page order by two line feeds.

Defined cases: null, empty and markup-only pages give the empty text; unclosed tags, comments and
scripts end with the page; of equal regions the first is taken; null ids and repeated rows are kept
row by row; an empty table gives an empty result; other input columns aren't read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import ship

SAMPLE_PAGES, MOST_BYTES = 2000, 200_000
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|title|object|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z!?][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
OUT = frozenset("nav header footer aside form menu dialog button head label fieldset".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class and id names by which markup says that an element isn't main text, and those that may stand beside them.
OUT_WORDS = frozenset("ad ads advert adverts advertisement advertisements adsbygoogle banner sponsor sponsored promo promos cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments respond replies disqus share sharing social related recommended newsletter subscribe signup login search widget pagination pager toolbar skip".split())
ASIDE_WORDS = frozenset("comment comments respond replies disqus related recommended".split())
BESIDE = frozenset("site page main global top bottom left right box bar block container wrapper wrap list section area link links post posts article articles story stories item items form inner outer primary secondary user reader reading entry js wp the to fixed sticky mobile desktop button buttons icon icons media text message slot unit col column row".split())
SPLIT = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|aria-label)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Elements that may enclose the whole page: never left out for their names.
WHOLE = frozenset(("html", "body", "main", "article"))
MARKED = re.compile(r"itemprop\s*=\s*[\"']?articleBody|role\s*=\s*[\"']?main\b", re.I)
NAMED, ASIDE, HARD = 1, 2, 3
TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
_LISTS = ("ul", "ol", "menu", "dl", "table", "td", "th", "article", "section", "main", "aside", "nav", "blockquote")
#: What the start of an element ends, and the elements that keep it from doing so.
ENDS = {
    "li": (("li",), _LISTS), "dd": (("dd", "dt"), _LISTS), "dt": (("dd", "dt"), _LISTS), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("tr", "td", "th"), ("table",)),
    **{t: (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)) for t in ("tbody", "thead", "tfoot")},
}
#: Weights of tags that no labelled page has: inside a block, of a block.
INLINE_TAG, DEFAULT_TAG, MOST = -0.25, -2.0, 40.0


@lru_cache(4096)
def _named(value: str) -> int:
    """What class or id names say: a name must consist of known words, so `related-work` or `side-by-side` say nothing."""
    sure = 0
    for name in value.split():
        parts = {p.lower() for p in SPLIT.split(name) if p and not p.isdigit()}
        if parts & OUT_WORDS and parts <= OUT_WORDS | BESIDE:
            sure = max(sure, ASIDE if parts & ASIDE_WORDS else NAMED)
    return sure


def _out(tag: str, attributes: str) -> int:
    """How sure markup is that an element isn't main text: 0, NAMED, ASIDE (what readers add or are led to) or HARD."""
    if tag in OUT:
        return NAMED if tag == "form" else HARD
    if tag in WHOLE or not attributes:
        return 0
    sure = 0
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return HARD
        if name == "role" and value.lower() in OUT_ROLES:
            return HARD
        if name in ("class", "id") and (named := _named(value)):
            sure = max(sure, named)
    return sure


class _Open:
    """The elements that are open, outermost first, with HTML's implied ends."""

    def __init__(self):
        self.stack: list[list] = []  # [tag, first token, end, token of its own end tag or None, how far out]
        self.at: dict[str, list[int]] = {}  # tag, or "" for any block -> its places in the stack

    def last(self, *tags: str) -> int:
        return max(self.at[t][-1] if self.at.get(t) else -1 for t in tags)

    def push(self, element: list) -> None:
        for key in (element[0], "") if element[0] in BLOCKS else (element[0],):
            self.at.setdefault(key, []).append(len(self.stack))
        self.stack.append(element)

    def pop_to(self, place: int, token: int) -> None:
        while len(self.stack) > place:
            element = self.stack.pop()
            element[2] = token
            for key in (element[0], "") if element[0] in BLOCKS else (element[0],):
                self.at[key].pop()

    def start(self, tag: str, token: int) -> None:
        """Ends what the start of `tag` ends."""
        if tag in ENDS:
            closes, within = ENDS[tag]
            place = min((p for t in closes if (p := self.last(t)) > self.last(*within)), default=-1)
            if place >= 0:
                self.pop_to(place, token)
        if tag in BLOCKS and tag not in TABLE and (place := self.last("p")) > self.last("table", "td", "th", "caption", "button"):
            self.pop_to(place, token)

    def end(self, tag: str, token: int) -> None:
        place = self.last(tag)
        if place > (self.last("table") if tag in TABLE and tag != "table" else self.last("table", "td", "th", "caption") if tag in BLOCKS and tag not in (*TABLE, "body", "html") else -1 if tag in BLOCKS else self.last("")):
            self.stack[place][3] = token
            self.pop_to(place, token)


def tokens(page: str) -> list[tuple[str, str]]:
    """(tag, text) in page order: text runs have the tag "", tags have their name ("/p" where they end).

    What stands in elements that aren't main text is left out, but never the page's own main text: the
    longest `<main>` (or element marked as it) or, without one, the longest `<article>` if it isn't one of
    many small ones beside longer text. Of an element that holds it only what stands before is left out,
    and nothing where a name alone says that it isn't main text and its end tag is there. On a page without
    main text of its own such names count a quarter: what they would leave out stays if it is over four
    times the rest.
    """
    toks: list[tuple[str, str]] = []
    words = [0]  # before each token
    gone: list[list] = []  # elements that aren't main text
    mains, articles = [], []
    open_ = _Open()
    for m in TOKEN.finditer(page):
        tag, i = m[3], len(toks)
        if tag is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                toks.append(("", s))
                words.append(words[-1] + len(s.split()))
            continue
        tag = tag.lower()
        if m[2]:
            open_.end(tag, i)
            toks.append(("/" + tag, ""))
        else:
            open_.start(tag, i)
            out = 0 if tag in VOID else _out(tag, m[4])
            element = [tag, i, i + 1, None, out]
            if out:
                gone.append(element)
            if tag not in VOID and not m[4].rstrip().endswith("/"):
                open_.push(element)
                if tag == "main" or m[4] and not out and MARKED.search(m[4]):
                    mains.append(element)
                elif tag == "article":
                    articles.append(element)
            toks.append((tag, m[4]))
        words.append(words[-1])
    open_.pop_to(0, len(toks))
    if not gone:
        return toks

    sure = _depth(gone, len(toks))
    size = lambda e: words[e[2]] - words[e[1]]
    free = sum(words[i + 1] - words[i] for i in range(len(toks)) if not sure[i])
    own = max(mains, key=size, default=None)
    if (own is None or not size(own)) and articles:
        own = max(articles, key=lambda e: size(e) * (1, 2, 0.25, 2)[sure[e[1]]] if sure[e[1]] else size(e) * 4)
        if sure[own[1]] and size(own) * (1, 2, 0.25, 2)[sure[own[1]]] <= free:
            own = None
    if own is None and sum(words[i + 1] - words[i] for i in range(len(toks)) if sure[i] == NAMED) > 4 * free:
        gone = [e for e in gone if e[4] != NAMED]
    kept = []
    for e in gone:
        last = e[2] + (e[3] is not None)
        if own is not None and e[1] < own[1] < e[2]:
            if e[4] != HARD and e[3] is not None and e[0] != "form":
                continue
            last = own[1]
        kept.append([*e[:2], last, None, e[4]])
    left = _depth(kept, len(toks))
    return [t for t, k in zip(toks, left) if not k]


def _depth(elements: list[list], n: int) -> list[int]:
    """For each token how surely the elements around it aren't main text, 0 where there are none."""
    out, ends = [0] * n, [0, 0, 0, 0]
    begin: dict[int, list[list]] = {}
    for e in elements:
        begin.setdefault(e[1], []).append(e)
    for i in range(n):
        for e in begin.get(i, ()):
            ends[e[4]] = max(ends[e[4]], e[2])
        out[i] = HARD if i < ends[HARD] else ASIDE if i < ends[ASIDE] else NAMED if i < ends[NAMED] else 0
    return out


def region(toks: list[tuple[str, str]], word: float, tags: dict[str, float]) -> tuple[int, int]:
    """The contiguous token range with the highest sum; of equals the first, empty when none is positive."""
    best, best_at, now, start = 0.0, (0, 0), 0.0, 0
    for i, (tag, text) in enumerate(toks):
        if now <= 0:
            now, start = 0.0, i
        if tag:
            w = tags.get(tag)
            now += w if w is not None else DEFAULT_TAG if tag.lstrip("/") in BLOCKS else INLINE_TAG
        else:
            now += word * len(text.split())
        if now > best:
            best, best_at = now, (start, i + 1)
    return best_at


def blocks(toks: list[tuple[str, str]]) -> str:
    done, now = [], []
    for tag, text in toks:
        if not tag:
            now.append(text)
        elif tag == "br":
            now.append(" ")
        elif tag.lstrip("/") in BLOCKS:
            done.append(now)
            now = []
    done.append(now)
    return "\n\n".join(x for x in (" ".join(html.unescape("".join(b)).split()) for b in done) if x)


def count_labelled(page: str) -> Counter | None:
    """Tokens inside and outside the main text that a page marks itself; None for pages without marks."""
    seen, inside, depth = Counter(), None, 0
    for tag, text in tokens(page):
        name = tag.lstrip("/")
        marks = name in ("article", "main") or not tag.startswith("/") and tag and re.search(r"itemprop\s*=\s*[\"']?articleBody|role\s*=\s*[\"']?main", text, re.I)
        if marks and not tag.startswith("/") and inside is None:
            inside, depth = name, 0
            seen[("out", tag)] += 1
            seen["marked"] += 1
            continue
        if inside and name == inside:
            depth += -1 if tag.startswith("/") else 1
            if depth < 0:
                inside = None
        key = "in" if inside else "out"
        if tag:
            seen[(key, tag)] += 1
        else:
            seen[(key, "")] += len(text.split())
    return seen if seen["marked"] else None


def fit_weights(pages: list[str]) -> tuple[float, dict[str, float]]:
    """Word weight and tag weights; without labelled pages every word scores 1 and every tag as an unseen one."""
    seen = Counter()
    for p in pages:
        seen.update(count_labelled(p) or {})
    return weights_of(seen)


def weights_of(seen: Counter) -> tuple[float, dict[str, float]]:
    words_in = seen[("in", "")]
    if not words_in:
        return 1.0, {}
    words_out = seen[("out", "")] + 1
    tags = {}
    for t in {k[1] for k in seen if isinstance(k, tuple) and k[1]}:
        rate_in, rate_out = (seen[("in", t)] + 0.01) / words_in, (seen[("out", t)] + 0.01) / words_out
        share = seen[("in", t)] / (seen[("in", t)] + seen[("out", t)])
        # inside more often than not: a small cost; else the more the rarer it is inside
        tags[t] = -0.25 if share >= 0.5 else -min(MOST, 1.0 + max(0.0, math.log(rate_out / rate_in)) * 2 + MOST * (1 - 2 * share))
    return 1.0, tags


def extract(page: str | None, weights: tuple[float, dict[str, float]]) -> str:
    if not page:
        return ""
    toks = tokens(page)
    a, b = region(toks, *weights)
    return blocks(toks[a:b])


def _sampled_counts(pages: DataFrame, sample: int) -> Counter:
    """Token counts of the `sample` labelled pages with the smallest hashes: the hashes are picked first (8 bytes a
    page), those pages are counted on the executors, and the driver gets a count for each tag."""
    marked = pages.select("h", F.xxhash64("h").alias("k")).filter((F.octet_length("h") <= MOST_BYTES) & F.col("h").rlike(r"(?i)<article|<main|role\s*=\s*.?main|articlebody"))
    keys = marked.select("k").distinct().orderBy("k").limit(sample)
    chosen = marked.join(F.broadcast(keys), "k").groupBy("k").agg(F.max("h").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for b in batches:
            for h in b.column(0):
                seen.update(count_labelled(h.as_py()) or {})
        keys = [k if isinstance(k, tuple) else (k, None) for k in seen]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())], ["place", "tag", "n"])

    rows = chosen.select("h").mapInArrow(run, "place string, tag string, n bigint").groupBy("place", "tag").agg(F.sum("n").alias("n")).collect()
    return Counter({place if tag is None else (place, tag): n for place, tag, n in rows})


def extract_html(pages: DataFrame, id_col: str = "page_id", markup: str = "html", keep: tuple[str, ...] = ("url",), sample: int = SAMPLE_PAGES) -> DataFrame:
    """One row per input row: id, the columns of `keep`, text, n_chars (code points)."""
    ship(pages.sparkSession)
    weights = weights_of(_sampled_counts(pages.select(F.col(f"`{markup}`").alias("h")), sample))
    kept = [id_col, *keep]
    types = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py(), weights) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", text string, n_chars bigint"
    return pages.select(*[f"`{c}`" for c in kept], f"`{markup}`").mapInArrow(run, schema)
