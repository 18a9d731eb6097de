"""Main text of web pages by the maximum-scoring run of tokens.

A page is a sequence of words and tags. Words score by the block they stand in, tags cost points; the weights are log
odds counted on labelled pages, which are pages that mark their article up as such. Words and tags inside boilerplate are
known by it alone, so lists in menus say nothing about lists elsewhere. One linear scan finds the contiguous region of
highest score, and what of it no boilerplate encloses is the text.
"""

import html
import math
import re
from bisect import bisect
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursuit.llm.registry import query, table

SAMPLE = 2000           # labelled pages that the weights are counted on
PRIOR = 20.0            # words that a block with a telling name counts as seen outside an article
MARKED = 0.25           # points at least of a word that a page marks as its article
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "select", "button", "object", "canvas", "title"}
VOID = {"br", "img", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track", "param"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
          "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "img", "wbr"}
LABEL = {"article", "main"}
OUTER = {"html", "body", *LABEL}
BOILERPLATE = {"nav", "aside", "footer", "header", "form", "menu", "dialog", "fieldset"}
HINTS = ["comment", "sidebar", "advert", "ad", "ads", "banner", "cookie", "notice", "promo", "share", "social", "related", "menu",
         "nav", "breadcrumb", "footer", "header", "popup", "modal", "newsletter", "subscribe", "sponsor", "widget", "login",
         "search", "reply", "disclaimer", "toolbar", "pagination"]
HINT = re.compile(r"(?:^|[_-])(" + "|".join(HINTS) + r")s?(?=$|[_-])")
MODIFIER = re.compile(r"(?:^|[_-])(?:has|have|no|not|with|without|hide|hidden|show|shows|toggle|enable|disable|enabled|disabled)[_-]")
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|[^<]+|<", re.S)
# after a tag whose quotes never close, a tag ends at the next bracket
LOOSE = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]+|<", re.S)
NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HEADING = re.compile(r"h[1-6]|p$")


def key_of(tag: str, attributes: str, inner: bool = False) -> str:
    """The tag, with a telling word of its class, id or role if there is one. A word after a modifier, as in no-sidebar, tells
    nothing, nor do those of OUTER, which hold whole pages; an article ``inner`` to another can be a comment, though. The id of
    a heading or a paragraph names what it is about, and tells nothing either."""
    if attributes and (tag not in OUTER or tag == "article" and inner):
        for kind, *parts in NAMED.findall(attributes):
            if kind.lower() == "id" and HEADING.match(tag):
                continue
            for name in "".join(parts).lower().split():
                hint, modifier = HINT.search(name), MODIFIER.search(name)
                if hint and not (modifier and modifier.start() < hint.start(1)):
                    return f"{tag}.{hint[1]}"
    return tag


class Chain:
    """The open blocks around a place: the innermost one's key, and the chain of those around it. What all of them say
    together is kept when a block opens, so that a page of any depth takes no longer than a flat one."""

    __slots__ = ("key", "around", "bare", "label", "first", "telling")

    def __init__(self, key=None, around=None, first=True):
        self.key, self.around, self.first = key, around, first
        self.telling = key is not None and telling(key)
        self.bare = around is None or around.bare and not self.telling
        self.label = around is not None and (around.label or key in LABEL)


def _tag_at(page: str, at: int, strict: bool):
    """The token at a place, and whether quotes still count: they do until one that never closes."""
    if strict:
        m = TOKEN.match(page, at)
        if m[0] != "<" or not page[at + 1:at + 2].isalpha() and page[at + 1:at + 2] != "/":
            return m, True
    if page.find(">", at) < 0:
        return None, False
    return LOOSE.match(page, at), False


def tokens_of(page: str):
    """Items ``(text or None, tag key, chain, is a block border)`` in page order. The chain holds the keys of the open blocks
    around a text; contents that are never shown as text are left out; unclosed tags end as browsers end them. A form
    around the whole article is no form of the page."""
    stack: list[tuple[str, Chain, bool]] = []   # tag, the chain with it, whether it is a link of its own in the chain
    opened: Counter = Counter()
    keys: Counter = Counter()
    root = chain = Chain()
    items, raw, at, strict = [], None, 0, True
    labels = [m.start() for m in re.finditer(r"<(?:article|main)\b", page, re.I)]
    ends = [m.start() for m in re.finditer(r"</form\b", page, re.I)] if labels else []

    def close(i):
        nonlocal chain
        for tag, c, linked in stack[i:]:
            opened[tag] -= 1
            if linked:
                keys[c.key] -= 1
        del stack[i:]
        chain = stack[-1][1] if stack else root

    while at < len(page):
        if raw:
            end = re.compile(rf"</{re.escape(raw)}\b[^>]*>?", re.I).search(page, at)
            at, raw = (end.end(), None) if end else (len(page), None)
            continue
        m, strict = _tag_at(page, at, strict)
        if m is None:
            items.append((html.unescape(page[at:]), None, chain, False))
            break
        start, at = at, m.end()
        slash, tag = m[1], m[2]
        if tag is None:
            piece = m[0]
            if piece[:2] in ("<!", "<?"):
                continue
            items.append((html.unescape(piece), None, chain, False))
            continue
        tag = tag.lower()
        key = key_of(tag, m[3], tag == "article" and opened[tag] > 0)
        items.append((None, key, chain, tag not in INLINE))
        if slash:
            if opened[tag] > 0:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close(i)
        elif tag in RAW:
            if tag != "svg" or not m[3].endswith("/"):      # of these only svg can close itself
                raw = tag
            continue
        elif tag not in VOID and not m[3].endswith("/"):
            if tag not in INLINE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or stack[i][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                        close(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            if tag == "form" and labels:
                upto = bisect(ends, start)
                if bisect(labels, ends[upto] if upto < len(ends) else len(page)) > bisect(labels, start):
                    key = "div"
            linked = tag not in INLINE or "." in key
            if linked:
                chain = Chain(key, chain, not keys[key])
                keys[key] += 1
            opened[tag] += 1
            stack.append((tag, chain, linked))
    return items


def telling(key: str) -> bool:
    tag, _, hint = key.partition(".")
    return tag in BOILERPLATE or bool(hint)


def count_page(page: str) -> dict[tuple[str, str], list[int]]:
    """Words and tags by key, inside and outside the labelled article; nothing for a page without exactly one. What a
    telling name marks inside it, such as comments, counts as outside, and for the telling blocks only."""
    items = tokens_of(page)
    if sum(text is None and key in LABEL and chain.bare for text, key, chain, _ in items) not in (2, 1):
        return {}
    counts: dict[tuple[str, str], list[int]] = {}
    own: dict[Chain, list[int]] = {}
    for text, key, chain, _ in items:
        outside = not chain.label or not chain.bare
        if text is None:
            if key not in OUTER and (telling(key) or chain.bare):
                counts.setdefault(("tag", key), [0, 0])[outside] += 1
        else:
            # by place: bare inside, bare outside, not bare
            own.setdefault(chain, [0, 0, 0])[2 if not chain.bare else int(outside)] += len(text.split())
    order, depth = [], {}
    for chain in own:       # every block around a text, outer ones first
        path = []
        while chain is not None and chain not in depth:
            path.append(chain)
            chain = chain.around
        for c in reversed(path):
            depth[c] = len(order)
            order.append(c)
    for chain in reversed(order):
        inside, outside, marked = own.get(chain, [0, 0, 0])
        if chain.around is not None:
            above = own.setdefault(chain.around, [0, 0, 0])
            for i, n in enumerate((inside, outside, marked)):
                above[i] += n
        if chain.key is None or chain.key in OUTER or not chain.first:
            continue
        both = (0, marked) if chain.telling else (inside, outside)
        if any(both):
            total = counts.setdefault(("word", chain.key), [0, 0])
            total[0] += both[0]
            total[1] += both[1]
    return counts


class Weights:
    """Points of words by the blocks around them and of tags, from counts ``{(kind, key): (inside, outside)}``."""

    def __init__(self, counts):
        self.counts = counts

    def odds(self, kind: str, key: str) -> float:
        inside, outside = self.counts.get((kind, key), (0, 0))
        if kind == "word" and telling(key):
            outside += PRIOR
        return math.log((inside + 1) / (outside + 1))

    def worst(self, chain: Chain, known: dict) -> float | None:
        """The least odds of the blocks that count: of telling ones where there are any, else of all with a count. ``known``
        holds what was found for the chains around, so that each is looked at once."""
        path = []
        while chain is not None and chain not in known:
            path.append(chain)
            chain = chain.around
        value = known[chain] if chain is not None else None
        for c in reversed(path):
            if c.key is not None and (c.telling or c.bare and c.key not in OUTER and ("word", c.key) in self.counts):
                mine = self.odds("word", c.key)
                first = value is None or c.telling and c.around.bare  # the first telling block leaves the others aside
                value = mine if first else min(value, mine)
            known[c] = value
        return value

    def word(self, chain: Chain, known: dict | None = None) -> float:
        """Between -1/4 and 1, as the worst block around it says; of telling blocks only these are asked. Boilerplate costs
        little, since an article may go on after it; at either end of a region any cost is enough to leave it out. What the
        page marks as its article scores at least MARKED without boilerplate around it."""
        worst = self.worst(chain, {} if known is None else known)
        if not chain.bare:
            return max(-0.25, min(1.0, worst))
        return max(MARKED if chain.label else -0.25, min(1.0, 0.5 if worst is None else worst))

    def tag(self, key: str, chain: Chain) -> float:
        """Tags cost between 0.2 and 1.5 points; nothing in what the page marks as its article, 0.2 inside boilerplate."""
        if key in OUTER:
            return 0.0
        if not telling(key):
            if not chain.bare:
                return -0.2
            if chain.label:
                return 0.0
        return -min(1.5, 0.2 + max(0.0, -self.odds("tag", key)))


def best_region(scores) -> tuple[int, int]:
    """Half-open bounds of the contiguous run of highest positive sum, the first such; (0, 0) if none is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def extract(page: str, weights: Weights) -> str:
    """The blocks of the best region that nothing telling encloses, one a line."""
    items = tokens_of(page)
    known: dict[Chain, float | None] = {}
    scores = []
    for text, key, chain, _ in items:
        if text is None:
            scores.append(weights.tag(key, chain))
        else:
            scores.append(weights.word(chain, known) * len(text.split()))
    lo, hi = best_region(scores)
    lines, parts = [], []
    for text, key, chain, border in items[lo:hi]:
        if border or key == "br":
            parts.append(" ")
        if border:
            lines.append(parts)
            parts = []
        if text is not None and chain.bare:
            parts.append(text)
    lines.append(parts)
    joined = (" ".join("".join(p).split()) for p in lines)
    return "\n".join(x for x in joined if x)


def fit(pages: DataFrame) -> Weights:
    """Weights counted on at most SAMPLE labelled pages, chosen by the hash of their id; the counts are kept by tag and
    by the words in HINTS, so there are few of them whatever the pages hold."""
    marked = pages.where("page_id is not null").where(F.col("html").rlike(r"(?i)<(article|main)\b"))
    chosen = marked.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE).distinct()

    def count(batches):
        for batch in batches:
            total: dict = {}
            for page in batch["html"]:
                for (kind, key), (inside, outside) in count_page(page or "").items():
                    if len(key) <= 40:
                        both = total.setdefault((kind, key), [0, 0])
                        both[0] += inside
                        both[1] += outside
            yield pd.DataFrame([(*k, *v) for k, v in total.items()], columns=["kind", "key", "inside", "outside"])

    seen = pages.select("page_id", "html").join(F.broadcast(chosen), "page_id").mapInPandas(
        count, "kind string, key string, inside long, outside long")
    rows = seen.groupBy("kind", "key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")) \
        .orderBy(F.desc(F.col("inside") + F.col("outside")), "kind", "key").limit(10_000).collect()
    return Weights({(r.kind, r.key): (r.inside, r.outside) for r in rows})


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page. Null html counts as empty; a page without a region of positive
    score gives an empty text. Without labelled pages the names of tags and blocks alone decide. Repeated rows stay
    apart. Weights are counted when called."""
    weights = fit(pages)

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": [extract(h, weights) for h in batch["html"]]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string").withColumn(
        "n_chars", F.length("text").cast("long"))


@query()
def op9_html_extract(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
