"""Main text of a web page as the maximum-scoring contiguous run of its tokens.

A page is a sequence of word and tag tokens. Words score by how often words of their innermost container are inside the article
on labelled pages, tags cost the more the less often they are inside; both weights are learnt from a bounded sample (about
SAMPLE pages, chosen by a hash) of pages that mark their article themselves (article or main element), on top of fixed
priors for tags that the sample may lack. Tokens inside boilerplate containers are counted apart from all others. One linear scan
finds the best run; boilerplate inside an article or main, left out anyway, costs nothing there. Inside the run, scripts, styles, forms and containers that are boilerplate by name are left out, character references
are decoded, inline tags join and block tags separate words.

What is boilerplate is decided by names and structure, never by size. Reader comments are boilerplate wherever they stand, an article
element inside them or named as a comment included, unless the name only tells a state (comments-open). Other boilerplate names do not
count on html and body, on what holds an article or main, on a page's layout (names such as layout or page beside them), on what holds all
top headings of a page without article, and where nothing else would be left of the page or of its article. Inside an article or main
the headings of a header stay, and so do names that are usual for its own text (INNER_NOISE has the others). Aside, nav, footer and
the like are boilerplate whatever they hold, unless all articles of the page are in them.

Defined results: null or empty html, and pages where no run scores above zero, give the empty text. Whole pages are read,
whatever their length. Extra columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import sampled

SAMPLE = 800
#: A key seen in fewer than one of so many tokens of the sample is left to the priors, so there are at most as many.
RARE = 100_000

#: Elements by their HTML role.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "object", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "button", "select", "head", "title", "dialog", "menu", "fieldset", "option", "legend"}
#: Class or id names of boilerplate containers.
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|alert|popup|modal|newsletter|subscribe|share|sharing|social|sidebar|related|recommend\w*|comments?|reply|replies|disqus|breadcrumbs?|nav\w*|menu|footer|header|widget|login|signup|pagination|pager|tags|meta|byline|skip)(?:$|[\s_-])", re.I)
#: Names that also inside an article are boilerplate; a notice, a line of meta data or a section on related work is text there.
INNER_NOISE = re.compile(r"(?:^|[\s_-])(?:(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|popup|modal|newsletter|subscribe|share|sharing|social|sidebar|recommend\w*|comments?|reply|replies|disqus|breadcrumbs?|nav\w*|menu|footer|widget|login|signup|pagination|pager)(?:$|[\s_-])|related(?:[_-](?:articles?|content|items?|links?|news|posts?|stories))?(?:$|\s))", re.I)
#: Names of reader comments, those that only tell a state, and how a comment that is an article element is named.
COMMENTS = re.compile(r"(?:^|[_-])(?:comments?|disqus|replies|respond)(?:$|[_-])", re.I)
STATE = re.compile(r"^(?:has|no|with|is|show|hide)[_-]|[_-](?:open|closed|enabled|disabled|on|off)$", re.I)
COMMENT_ARTICLE = re.compile(r"(?:(?:user|reader|single|child|nested|blog)[_-])?comments?(?:[_-](?:body|item|content|text|entry|single|card|box|thread|post|wrap|main))?", re.I)
LAYOUT = re.compile(r"(?:^|\s)(?:layout|page|site|app|root|post|hentry|story|single|article)(?:$|\s)", re.I)
MAIN = {"article", "main"}
ROOT = {"html", "body"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements of BOILERPLATE that some pages put around everything.
WRAPPERS = {"form", "fieldset", "dialog", "header"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, data): kind is open, close or text; raw elements and comments are skipped."""
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if m[2]:
            name = m[2].lower()
            yield ("close" if m[1] else "open"), name, m[3]
            if not m[1] and name in RAW and not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                at = close.start() if close else end


def _key(name: str, attributes: str, inside: bool) -> tuple[str, bool, bool, bool]:
    """A container's key (element, and boilerplate class if it has one), whether it is boilerplate by name, whether of comments, and whether it is named as a layout."""
    names = " ".join(x for g in _NAMED.findall(attributes) for x in g if x) if attributes and name not in ROOT else ""
    if name in MAIN:
        said = any(COMMENT_ARTICLE.fullmatch(x) for x in names.split())
        return (f"{name}.noise" if said else name), said, said, False
    comments = any(COMMENTS.search(x) and not STATE.search(x) for x in names.split())
    if name in BOILERPLATE:
        return name, True, comments, False
    marked = bool(names) and (comments or bool((INNER_NOISE if inside else NOISE).search(names)))
    return (f"{name}.noise" if marked else name), marked, comments, bool(LAYOUT.search(names))


@dataclass
class Node:
    """An element: its mark, whether it stands in comments, the article or main around it; then what it holds outside comments."""

    name: str
    marked: bool
    parent: int
    around: int
    comments: bool = False
    layout: bool = False
    words: int = 0
    articles: int = 0
    titles: int = 0
    paragraphs: int = 0


def _emptied(nodes: list[Node], scope: int) -> None:
    """Where marks leave no word of a page (0) or of an article, the outermost marked names lose theirs, level by level; those with paragraphs first."""
    own = [i for i in range(1, len(nodes)) if scope in (0, nodes[i].around)]
    while True:
        hidden, outer = {}, []
        left = nodes[scope].words
        for i in own:
            node = nodes[i]
            hidden[i] = hidden.get(node.parent, False) or node.marked
            left += 0 if hidden[i] else node.words
            if node.marked and not hidden.get(node.parent, False) and not node.comments and (node.name not in BOILERPLATE or node.name in WRAPPERS):
                outer.append(node)
        if left or not outer:
            return
        for node in [x for x in outer if x.paragraphs] or outer:
            node.marked = False


def _holders(nodes: list[Node]) -> None:
    """Clears the marks of elements that hold the text itself. Parents come before children."""
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        if not node.comments:
            up.articles += node.articles + (node.name in MAIN and not node.around)
            up.titles += node.titles + (node.name == "h1")
            up.paragraphs += node.paragraphs + (node.name == "p")
    own, titles = nodes[0].articles, nodes[0].titles
    for node in nodes[1:]:
        if not node.marked or node.comments:
            continue
        if node.around:
            node.marked = node.name in BOILERPLATE or not node.titles
        elif node.name in BOILERPLATE and node.name not in WRAPPERS:
            node.marked = not node.articles or node.articles < own
        else:
            node.marked = not (node.articles or node.layout or not own and titles and node.titles == titles)
    for scope in [i for i, x in enumerate(nodes) if x.name in MAIN and not x.around and not x.comments] or [0]:
        _emptied(nodes, scope)


def parse(page: str) -> list[tuple]:
    """Tokens with context: (is_word, key, main, noise, text). Words' key is the innermost block container, tags' their own."""
    found, stack, nodes = [], [0], [Node("", False, 0, 0)]
    named, standing = [""], Counter()
    for kind, name, data in tokens(page):
        if kind == "text":
            if data:
                found.append(("text", stack[-1], data))
                nodes[stack[-1]].words += len(data.split())
        elif kind == "open":
            if name in ("p", "li", "option", "tr", "td", "th", "dt", "dd") and nodes[stack[-1]].name == name and name not in VOID and not data.rstrip().endswith("/"):
                standing[nodes[stack.pop()].name] -= 1
            up = nodes[stack[-1]]
            around = up.around or (stack[-1] if up.name in MAIN and not up.comments else 0)
            key, bad, comments, layout = _key(name, data, around > 0)
            nodes.append(Node(name, bad, stack[-1], around, comments or up.comments, layout))
            named.append(key)
            found.append(("open", len(nodes) - 1, name))
            if name not in VOID and not data.rstrip().endswith("/") and name not in RAW:
                stack.append(len(nodes) - 1)
                standing[name] += 1
        elif standing[name]:
            while nodes[stack[-1]].name != name:
                standing[nodes[stack.pop()].name] -= 1
            standing[name] -= 1
            found.append(("close", stack.pop(), name))
        else:
            found.append(("stray", stack[-1], name))
    if any(x.marked for x in nodes):
        _holders(nodes)
    noise, keys, block, cause = [False], [""], ["body"], [0]
    for i, (node, key) in enumerate(zip(nodes[1:], named[1:], strict=True), 1):
        bad, name = node.marked, node.name
        cause.append(cause[node.parent] or (i if bad else 0))
        headline = name in HEADINGS and nodes[cause[i]].name == "header" and nodes[cause[i]].around > 0
        cause[i] *= not headline
        noise.append(cause[i] > 0)
        keys.append(key if bad else name)
        block.append(block[node.parent] if name in INLINE or name in MAIN else keys[-1])
    out = []
    for kind, i, data in found:
        name, around = nodes[i].name, nodes[i].around
        main = around > 0 or kind in ("text", "stray") and name in MAIN
        if kind == "text":
            out.append((True, block[i], main, noise[i], data))
        elif kind == "stray":
            out.append((False, "/" + data, main and data not in MAIN, noise[i], data))
        else:
            out.append((False, keys[i] if kind == "open" else "/" + keys[i], main and name not in MAIN, noise[i], data))
    return out


def in_context(key: str, noise: bool) -> str:
    """The key that a token is counted by: list items, links and tables of boilerplate say nothing about those of articles."""
    return key + "~" if noise else key


class Weights:
    """Scores of words and tags by container key and context; ``inside`` and ``seen`` count tokens of labelled pages."""

    PRIOR = 4.0

    def __init__(self, inside: dict[str, float], seen: dict[str, float]):
        self.inside, self.seen, self.known = inside, seen, {}

    def share(self, key: str, noise: bool) -> float:
        prior = 0.02 if noise or key.strip("/") in MAIN | {"html", "body"} and not key.startswith("w:") else 0.7
        key = in_context(key, noise)
        n = self.seen.get(key, 0)
        return (self.inside.get(key, 0) + prior * self.PRIOR) / (n + self.PRIOR)

    def of(self, is_word: bool, key: str, noise: bool, words: int) -> float:
        k = (is_word, key, noise)
        if k not in self.known:
            p = self.share(("w:" if is_word else "") + key, noise)
            self.known[k] = max(0.02, 2 * p - 1) if is_word else -(0.05 + 12 * max(0.0, 0.6 - p) ** 2 * 3)
        return self.known[k] * (words if is_word else 1)


def extract(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    parsed = parse(page)
    best = total = 0.0
    start, span = 0, None
    for i, (is_word, key, main, noise, data) in enumerate(parsed):
        words = len(data.split()) if is_word else 1
        if not words or noise and main:
            continue
        if total <= 0:
            total, start = 0.0, i
        total += weights.of(is_word, key, noise, words)
        if total > best:
            best, span = total, (start, i)
    if span is None:
        return ""
    pieces = []
    for is_word, key, _, noise, data in parsed[span[0] : span[1] + 1]:
        if is_word:
            if not noise:
                pieces.append(htmllib.unescape(data) if "&" in data else data)
        elif data not in INLINE:
            pieces.append(" ")
    return " ".join("".join(pieces).split())


def learn(pages: DataFrame, sample: int = SAMPLE, rows: int | None = None) -> Weights:
    """Token counts of about ``sample`` different pages that mark their article; pages: page_id, html. rows: how many there are, if known."""
    picked = pages.where(F.col("html").rlike(r"(?i)<(?:article|main)[\s>]")).select("page_id", "html")
    picked = picked.where(sampled(["page_id", "html"], sample, picked.count() if rows is None else rows)).distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside, seen = Counter(), Counter()
        for pdf in batches:
            for page in pdf.html:
                for is_word, key, main, noise, data in parse(page):
                    k, w = ("w:" + key, len(data.split())) if is_word else (key, 1)
                    k = in_context(k, noise)
                    seen[k] += w
                    inside[k] += w * main
        if seen:
            yield pd.DataFrame({"key": list(seen), "inside": [float(inside[k]) for k in seen], "seen": [float(x) for x in seen.values()]})

    counts = picked.mapInPandas(count, "key string, inside double, seen double").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("seen").alias("seen"))
    every = counts.agg(F.coalesce(F.sum("seen"), F.lit(0.0))).first()[0]
    rows = counts.where(F.col("seen") * RARE >= every).collect()
    return Weights({r.key: r.inside for r in rows}, {r.key: r.seen for r in rows})


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    weights = learn(base, sample)

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return pd.Series([extract(x, weights) for x in html], dtype=object)

    return base.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
