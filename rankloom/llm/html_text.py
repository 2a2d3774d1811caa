"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a row of events. Words score positive and tags negative, by the log-odds of standing in the article of labelled pages
(those that mark it with an article element). Elements that are never article text (scripts, menus, forms, adverts, comments and
the like, by element or by class and id) score nothing and give no text, unless they enclose the article; a name alone cuts nothing that
outweighs all the rest of the page. A linear scan finds the contiguous run of events of the highest score; its words are the main text.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.arrowtext import extend, least_hashed

#: Labelled pages that weights are learned from, those of the smallest hash.
LABELLED = 2000

_REST = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
EVENT = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|select)\b[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>{_REST})(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
#: A page's head ends at its closing tag or where the first element or text of the body begins.
HEAD = re.compile(
    rf"<head(?=[\s/>]){_REST}>(?>\s+|<!--.*?-->|<(?P<in_head>title|script|style|noscript|template)\b{_REST}>.*?</(?P=in_head)\s*>|<(?:meta|link|base)\b{_REST}>)*+(?:</head\s*>)?",
    re.S | re.I,
)
# Elements of HTML by their role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("nav footer aside form button dialog menu svg".split())
BLOCKS = frozenset("article main section div p h1 h2 h3 h4 h5 h6 ul ol table".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKED = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side-bar|"
    r"footer|site-header|page-header|masthead|topbar|comments?|commentlist|disqus|reply|replies|respond|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|"
    r"popup|modal|overlay|widget|pagination|pager|skip-link|toolbar)(?![a-z])", re.I,
)
#: Of these, what readers write: left out however long it is, as long as anything else is left.
READERS = re.compile(r"(?<![a-z])(?:comments?|commentlist|disqus|reply|replies|respond)(?![a-z])", re.I)
# Of these, what marks a container inside an article, by class or role.
MARKED_INSIDE = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommended|newsletter|subscribe|signup)(?![a-z])", re.I,
)
# Names of a layout, not of the part they speak of: has-sidebar, no-sidebar, content-sidebar.
LAYOUT = re.compile(r"(?:has|no|not|non|with|without|content|layout|hide)[-_]", re.I)
CONTAINERS = frozenset("div section ul ol dl aside table".split())
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def _marked(tag: str, rest: str, inside: bool) -> int:
    """Whether the class, id or role names of an element are those of something else than an article's text (NAMED), or of what readers write (READER)."""
    if inside and tag not in CONTAINERS or not (pattern := MARKED_INSIDE if inside else MARKED).search(rest):
        return 0
    names = ("class", "role") if inside else ("class", "id", "role")
    values = (a or b or c for name, a, b, c in ATTRIBUTE.findall(rest) if name.lower() in names)
    hits = [x for v in values for x in v.split() if pattern.search(x) and not LAYOUT.match(x)]
    return 0 if not hits else READER if any(map(READERS.search, hits)) else NAMED


@dataclass(frozen=True)
class Weights:
    word: float = 1.0
    tags: dict[str, float] = field(default_factory=dict)
    other: float = -3.0

    def of(self, tag: str) -> float:
        return self.tags.get(tag, self.other)


#: Why an element may be cut: by its own kind, by a name, by a name of what readers write.
KIND, NAMED, READER = 1, 2, 3
#: A named element is kept if it has more than this many times the words of all that would be left without it.
OUTWEIGHS = 4


def events(page: str) -> list[tuple[str, str]]:
    """(tag, "") and ("", text) in page order, without comments, raw elements and boilerplate elements. A closing tag begins with /."""
    if head := HEAD.search(page):
        page = page[: head.start()] + page[head.end() :]
    found: list[tuple[str, str, int]] = []
    inside = 0  # open article or main elements
    for m in EVENT.finditer(page):
        if m["text"] is not None:
            found.append(("", m["text"], 0))
        elif m["tag"]:
            tag = m["tag"].lower()
            if tag in ("article", "main"):
                inside = max(inside + (-1 if m["end"] else 1), 0)
            bad = 0
            if not m["end"] and tag not in VOID and tag not in ("html", "body", "article", "main") and not m["rest"].endswith("/"):
                bad = KIND if tag in BOILERPLATE or tag == "header" and inside <= 0 else _marked(tag, m["rest"], inside > 0)
            if tag == "svg" and m["rest"].endswith("/"):
                continue
            found.append(((m["end"] and "/") + tag, "", bad))
    closers = _closers(found)
    words, holds = _words(found), _holder(found)
    cut = _cuts(found, closers, holds, frozenset())
    left = words[-1] - sum(words[closers[i] + 1] - words[i] for i in cut)
    kept = set()
    for i in sorted((i for i in cut if found[i][2] != KIND), key=lambda i: words[i] - words[closers[i] + 1]):
        own = words[closers[i] + 1] - words[i]
        if own > (OUTWEIGHS * left if found[i][2] == NAMED else 0) and (found[i][2] == NAMED or not left):
            kept.add(i)
            left += own
    cut = _cuts(found, closers, holds, kept) if kept else cut
    out, i = [], 0
    while i < len(found):
        tag, text, _ = found[i]
        if i in cut:
            out.append(("/", ""))  # what was cut out parts the text around it
            i = closers[i]
        else:
            out.append((tag, text))
        i += 1
    return out


def _words(found: list[tuple[str, str, int]]) -> list[int]:
    """The words before each event, and of all."""
    total = [0]
    for tag, text, _ in found:
        total.append(total[-1] + (0 if tag else len(text.split())))
    return total


def _cuts(found: list[tuple[str, str, int]], closers: dict[int, int], holds: Callable[[int, int], bool], kept: set[int] | frozenset[int]) -> set[int]:
    """The outermost elements that are cut out."""
    out, i = set(), 0
    while i < len(found):
        if found[i][2] and i not in kept and not holds(i, closers[i]):
            out.add(i)
            i = closers[i]
        i += 1
    return out


def _holder(found: list[tuple[str, str, int]]) -> Callable[[int, int], bool]:
    """Tells whether an element that looks like boilerplate, from its opening tag to its end, holds the article.

    It does with a main element or all articles of the page in it; a form also does with the first
    h1 or half of the words of the page, and an element named by its class or id with the first h1.
    """
    at: dict[str, list[int]] = {"article": [], "main": [], "h1": []}
    for i, (tag, _, _) in enumerate(found):
        if tag in at:
            at[tag].append(i)
    words = _words(found)

    def holds(a: int, b: int) -> bool:
        tag = found[a][0]
        if tag == "svg":
            return False
        if bisect(at["main"], a) < bisect(at["main"], b) or at["article"] and a < at["article"][0] and at["article"][-1] < b:
            return True
        if tag != "form" and (tag in BOILERPLATE or tag == "header"):
            return False
        return bool(at["h1"]) and a < at["h1"][0] < b or tag == "form" and 2 * (words[b] - words[a]) >= words[-1] > 0

    return holds


def _closers(found: list[tuple[str, str, int]]) -> dict[int, int]:
    """Where each boilerplate element ends: at its closing tag, else before the next block that opens. An svg ends at both."""
    out, open_at = {}, {}
    for i, (tag, _, bad) in enumerate(found):
        if tag[:1] == "/":
            stack = open_at.get(tag[1:])
            if stack:
                start = stack.pop()
                if found[start][2]:
                    out[start] = i
        elif tag and tag not in VOID:
            open_at.setdefault(tag, []).append(i)
    after = len(found)
    for i in range(len(found) - 1, -1, -1):
        tag, _, bad = found[i]
        if bad and i not in out:
            out[i] = after - 1
        elif tag == "svg" and bad:
            out[i] = min(out[i], after - 1)
        if tag in BLOCKS or tag in ("/body", "/html"):
            after = i
    return out


def learn(pages: list[str]) -> Weights:
    """Weights from pages whose article element is closed: its inside against the rest."""
    counts = (Counter(), Counter())
    for page in pages:
        inside = 0
        for tag, text in events(page):
            if tag == "/article":
                inside = 0
            counts[inside][tag or "word"] += 1 if tag else len(text.split())
            if tag == "article":
                inside = 1
    totals = [sum(c.values()) + 1 for c in counts]
    odds = {k: math.log((counts[1][k] + 0.5) / totals[1]) - math.log((counts[0][k] + 0.5) / totals[0]) for k in counts[0].keys() | counts[1].keys()}
    if not counts[1]["word"]:
        return Weights()
    return Weights(max(odds.pop("word"), 0.5), {k: min(v, -0.05) for k, v in odds.items() if k != "/"} | {"/": -0.05})


def best_run(scores: list[float]) -> tuple[int, int]:
    """The first contiguous run of the highest sum; an empty run if no score is positive."""
    best, run, start, at = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, at = run, (start, i + 1)
    return at


def main_text(page: str, weights: Weights) -> str:
    """Blocks of the best run, each with its white space as single spaces, joined by a space."""
    row = events(page)
    a, b = best_run([weights.of(tag) if tag else weights.word * len(html.unescape(text).split()) for tag, text in row])
    out, block = [], []
    for tag, text in row[a:b]:
        if not tag:
            block.append(text)
        elif tag.lstrip("/") not in INLINE:
            out.append("".join(block))
            block = []
    out.append("".join(block))
    return " ".join(x for x in (" ".join(html.unescape(t).split()) for t in out) if x)


def train(pages: DataFrame, html_col: str = "html", rows: int = LABELLED) -> Weights:
    """Weights from at most ``rows`` pages with a closed article element."""
    marked = pages.select(F.col(html_col).alias("h")).where(F.col("h").rlike("(?is)<article\\b.*</article\\s*>"))
    return learn(sorted(r.h for r in least_hashed(marked, "h", rows).collect()))


def extract(pages: DataFrame, html_col: str = "html", out: str = "text", weights: Weights | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add every page's main text, an empty string for null or empty pages and those without words; weights are learned if not given.

    Other columns stay, but for one of the added name; repeated rows stay, an empty table gives an empty one.
    """
    known = weights if weights is not None else train(pages, html_col)
    return extend(pages, html_col, T.StructType([T.StructField(out, T.StringType())]), lambda col: [pa.array([main_text(x or "", known) for x in col.to_pylist()], pa.string())], drop=drop)
