"""Main text of web pages: the maximum-scoring run of blocks, with weights from labelled pages."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
SPECIAL = re.compile("[\"'>]")
NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)

# Elements of HTML by what they do to the text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp", "template", "svg", "math"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "br", "button", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins",
    "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
ASIDE = {"aside", "button", "dialog", "footer", "head", "menu", "nav", "object", "select"}
# Words of class, id or role that name what is not the article.
NOT_ARTICLE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "commentlist", "complementary", "consent", "contentinfo", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager",
    "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets",
}
NEGATES = {"has", "hide", "no", "non", "with", "without"}  # before such a word: "has-sidebar" names what stands beside
WRAPS, HOLDS_ALL = 0.5, 0.9  # shares of the words from which on an element with and without an article inside is a wrapper
ROOTS = {"html", "body", "article", "main"}
CLOSES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


def _named_aside(attributes: str) -> bool:
    for value in NAMED.findall(attributes):
        words = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower())
        if any(w in NOT_ARTICLE and before not in NEGATES for before, w in zip(["", *words], words)):
            return True
    return False


class Marks:
    """Elements that are not the article by their class, id or role, and forms, as they open and close on a page.

    Such names are on wrappers of the article too, so what an element holds decides: one with an article or main
    element inside is a wrapper if it holds at least ``WRAPS`` of the words beside it (those without a mark, and
    those of other such elements), and one without if it holds ``HOLDS_ALL`` of what its surroundings hold and, on
    pages that name an article, no such words stand beside it.
    """

    def __init__(self) -> None:
        self.now, self.words, self.articles = -1, 0, 0
        self.parent: list[int] = []
        self.held: list[int] = []
        self.inside: list[int] = []
        self.own: list[int] = []  # words by their innermost mark
        self.plain = 0  # words without one

    def open(self) -> None:
        self.parent.append(self.now)
        self.held.append(-self.words)
        self.inside.append(-self.articles)
        self.own.append(0)
        self.now = len(self.parent) - 1

    def close(self) -> None:
        self.held[self.now] += self.words
        self.inside[self.now] += self.articles
        self.now = self.parent[self.now]

    def text(self, n: int) -> None:
        self.words += n
        if self.now < 0:
            self.plain += n
        else:
            self.own[self.now] += n

    def asides(self) -> list[bool]:
        """By mark, whether the element (or one around it) is not the article; False at the end for no mark."""
        beside = [*self.own, self.plain]
        for p, held, inside in zip(self.parent, self.held, self.inside):
            beside[p] += held if inside else 0
        off = [False] * len(beside)
        for k, (p, held, inside) in enumerate(zip(self.parent, self.held, self.inside)):
            around = self.held[p] if p >= 0 else self.words
            wraps = held > 0 and (held >= WRAPS * beside[p] if inside else held >= HOLDS_ALL * around and not (self.articles and beside[p]))
            off[k] = off[p] or not wraps
        return off


class Tags:
    """Tags of a page from front to back, in time that grows with the page however broken its markup is.

    An attribute's quotes may hold ``>``. Where a quote never ends the tag ends at its first ``>`` instead; the quotes that
    led there are remembered, so that no later tag follows them again. Without a ``>`` behind it ``<`` is text.
    """

    def __init__(self, html: str):
        self.html = html
        self.special: list[int] | None = None
        self.last = html.rfind(">")
        self.dead: set[int] = set()

    def _index(self) -> None:
        self.special = [m.start() for m in SPECIAL.finditer(self.html)]
        self.next: list[int] = [-1] * len(self.special)  # the next of the same kind
        seen: dict[str, int] = {}
        for k in range(len(self.special) - 1, -1, -1):
            c = self.html[self.special[k]]
            self.next[k] = seen.get(c, -1)
            seen[c] = k

    def _end(self, place: int, first: int) -> int:
        """Place of the ``>`` outside of quotes that ends a tag, or -1; ``first`` is that of the first ``>``."""
        if self.html.find('"', place, first) < 0 and self.html.find("'", place, first) < 0:
            return first
        if self.special is None:
            self._index()
        k, passed = bisect_left(self.special, place), []
        while 0 <= k < len(self.special) and k not in self.dead:
            if self.html[self.special[k]] == ">":
                return self.special[k]
            passed.append(k)
            if self.next[k] < 0:
                break
            k = self.next[k] + 1
        self.dead.update(passed)
        return -1

    def after(self, place: int) -> tuple[int, int, str, bool, str] | None:
        """``(start, end, name, closing, attributes)`` of the next tag; the name is empty for comments and the like."""
        html = self.html
        start = html.find("<", place)
        while start >= 0:
            if html.startswith("<!--", start):
                ends = [(k, k + len(mark)) for mark in ("-->", "--!>") if (k := html.find(mark, start + 4)) >= 0]
                return start, min(ends)[1] if ends else len(html), "", False, ""
            m = NAME.match(html, start + 1) if start < self.last else None
            if m:
                first = html.find(">", m.end())
                end = self._end(m.end(), first)
                attributes = html[m.end() : end] if end >= 0 else ""
                return start, (end if end >= 0 else first) + 1, m[1].lower(), html[start + 1] == "/", attributes
            if html.startswith(("<!", "<?", "</"), start):
                end = html.find(">", start)
                return start, end + 1 if end >= 0 else len(html), "", False, ""
            start = html.find("<", start + 1)
        return None


def scan(html: str) -> Iterator[tuple[str, str, bool, bool, int]]:
    """``(tag, text, aside, linked, article)`` in page order: a tag name (``/`` first in an end tag) or "" with a text.

    ``aside``: within an element that is not the article by its name, class, id or role; ``linked``: within
    a link; ``article``: how many article or main elements are open.
    """
    marks = Marks()
    found = list(_scan(html, marks))
    off = marks.asides()
    for tag, text, aside, mark, linked, article in found:
        yield tag, text, aside or off[mark], linked, article


def _scan(html: str, marks: Marks) -> Iterator[tuple[str, str, bool, int, bool, int]]:
    stack: list[tuple[str, bool, bool]] = []
    open_at: dict[str, list[int]] = defaultdict(list)  # places in the stack by name, and of blocks but paragraphs
    place, aside, links, articles, tags = 0, 0, 0, 0, Tags(html)

    def pop_to(index: int) -> None:
        nonlocal aside, links, articles
        while len(stack) > index:
            name, off, marked = stack.pop()
            open_at[name].pop()
            if name in BLOCK and name != "p":
                open_at[""].pop()
            aside -= off
            links -= name == "a"
            articles -= name in ("article", "main")
            if marked:
                marks.close()

    def last(names: set[str], stop: set[str]) -> int:
        """Place of the innermost open element of ``names`` that none of ``stop`` lies within, or -1."""
        at = max((open_at[x][-1] for x in names if open_at[x]), default=-1)
        return at if at > max((open_at[x][-1] for x in stop if open_at[x]), default=-1) else -1

    while place < len(html):
        tag = tags.after(place)
        end = tag[0] if tag else len(html)
        if end > place:
            if not aside:
                marks.text(len(html[place:end].split()))
            yield "", html[place:end], aside > 0, marks.now, links > 0, articles
        if not tag:
            break
        _, place, name, closing, attributes = tag
        if not name:
            continue
        if closing:
            k = last({name}, set())
            if k >= 0:
                pop_to(k)
            yield "/" + name, "", aside > 0, marks.now, links > 0, articles
            continue
        if open_at["p"] and name in BLOCK and (k := last({"p"}, {""})) >= 0:
            pop_to(k)
        if name in CLOSES and (k := last({name} | ({"dt", "dd"} if name in ("dt", "dd") else {"td", "th"} if name in ("td", "th") else set()), CLOSES[name])) >= 0:
            pop_to(k)
        yield name, "", aside > 0, marks.now, links > 0, articles
        if name in RAW:
            close = re.compile(rf"</{name}\b", re.I).search(html, place)
            end = html.find(">", close.end()) if close else -1
            place = end + 1 if end >= 0 else len(html)
        elif name not in VOID and not attributes.endswith("/"):
            off = name in ASIDE or name == "header" and not articles
            named = bool(attributes) and not off and _named_aside(attributes)
            marked = not aside and not off and (name == "form" or named and name not in ROOTS)
            if marked:
                marks.open()
            open_at[name].append(len(stack))
            if name in BLOCK and name != "p":
                open_at[""].append(len(stack))
            stack.append((name, off, marked))
            aside += off
            links += name == "a"
            articles += name in ("article", "main")
            marks.articles += name in ("article", "main") and not named and not aside
    pop_to(0)


def _known(tag: str) -> str:
    return tag if tag.lstrip("/") in BLOCK or tag.lstrip("/") in INLINE or tag.lstrip("/") in RAW else "other"


def _kind(aside: bool, linked: bool) -> str:
    return "#aside" if aside else "#link" if linked else "#word"


def counts(html: str | None) -> Counter | None:
    """Of a page that names its article, occurrences of each tag and kind of word inside and outside of it."""
    found, named = Counter(), 0
    for tag, text, aside, linked, article in scan(html or ""):
        inside = article > 0
        if tag:
            named += tag == "article"
            found[_known(tag), inside] += 1
        else:
            found[_kind(aside, linked), inside] += len(text.split())
    return found if named == 1 else None


def weights(inside: dict[str, int], outside: dict[str, int]) -> dict[str, float]:
    """Words score up to 1 by the share of their kind that is content, tags down to -8 by the share that is not.

    Words of elements that name themselves as something else score below 0.
    """
    out = {}
    for token in {*inside, *outside}:
        a, b = inside.get(token, 0), outside.get(token, 0)
        share = (a + 0.5) / (a + b + 1)
        out[token] = max(0.02, share) if token.startswith("#") else -0.02 - 8 * (1 - share) ** 2
    unseen = {f"{end}{tag}": cost for names, cost in ((BLOCK, -0.5), (RAW, -0.5), (INLINE, -0.02)) for tag in names for end in ("", "/")}
    return unseen | {"#word": 1.0, "#link": 0.3, "other": -0.5} | out | {"#aside": -0.5}


IN_ARTICLE = -0.05  # the most a tag costs within an article or main element

# What holds where no page names its article: tags cost by what they usually stand in.
DEFAULT = weights(
    {"p": 9, "/p": 9, "h1": 9, "/h1": 9, "h2": 9, "/h2": 9, "#word": 99}, {"li": 9, "/li": 9, "a": 3, "/a": 3, "div": 3, "/div": 3, "nav": 9, "footer": 9}
)


def main_text(html: str | None, weight: dict[str, float]) -> str:
    """The blocks of the best run of blocks that are not aside."""
    blocks: list[tuple[float, float, str]] = []  # cost of the tags before, score, text
    cost = score = 0.0
    parts: list[str] = []
    other = weight["other"]

    def close() -> None:
        nonlocal cost, score, parts
        text = " ".join("".join(parts).split())
        if text:
            blocks.append((cost, score, text))
            cost = 0.0
        else:
            cost += score
        score, parts = 0.0, []

    for tag, text, aside, linked, article in scan(html or ""):
        if tag:
            name, own = tag.lstrip("/"), weight.get(_known(tag), other)
            if article:  # the page says itself that this is content
                own = max(own, IN_ARTICLE)
            if name in BLOCK:
                close()
                cost += own
            else:
                score += own
                if name == "br":
                    parts.append(" ")
        else:
            if not (aside and article):
                score += weight[_kind(aside, linked)] * len(text.split())
            if not aside:
                parts.append(entities.unescape(text))
    close()

    # Linear scan: the run that ends here is worth extending while it is worth anything.
    best, best_from, best_to = 0.0, 0, 0
    running, start = 0.0, 0
    for k, (before, own, _) in enumerate(blocks):
        if running + before <= 0:
            running, start = own, k
        else:
            running += before + own
        if running > best:
            best, best_from, best_to = running, start, k + 1
    return "\n\n".join(text for _, _, text in blocks[best_from:best_to])


def learn(pages: DataFrame, sample: int = 2000, page_id: str = "page_id", html: str = "html") -> dict[str, float]:
    """Weights from pages that label themselves by exactly one article element.

    About ``sample`` pages, chosen by a hash of their ids, are read; the counts are one small row for
    each known element name.
    """
    share = min(1.0, sample / max(1, pages.count()))
    chosen = pages.where(F.pmod(F.xxhash64(F.lit("sample"), page_id), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else pages

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for h in batch[html]:
                total.update((isinstance(h, str) and counts(h)) or ())
        yield pd.DataFrame([(t, i, n) for (t, i), n in total.items()], columns=["token", "inside", "n"])

    rows = chosen.select(html).mapInPandas(count, "token string, inside boolean, n long").groupBy("token", "inside").agg(F.sum("n")).collect()
    inside, outside = ({r[0]: r[2] for r in rows if r[1] is side} for side in (True, False))
    return weights(inside, outside) if inside.get("#word") else DEFAULT


def extract(pages: DataFrame, weight: dict[str, float] | None = None, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` (blocks joined by an empty line) and ``n_chars``.

    A page is read once: words score positive and tags negative (tags little within an element that the page
    names its article), and a linear scan finds the contiguous
    blocks with the largest sum; in them, elements that name themselves as menu, advert, comments and so on
    are left out, unless they wrap the article or all there is (``Marks``). Scripts, styles and the head never count as text.

    Defined cases: null or empty html and pages without words outside such elements give empty text; tags
    that are never closed end with what holds them; very long pages are read whole. Repeated rows stay; no
    rows give no rows; other columns pass through, except ones named as the two new columns.
    """
    weight = learn(pages, page_id=page_id, html=html) if weight is None else weight

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(h if isinstance(h, str) else None, weight) for h in batch], dtype=object)

    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    return pages.select(*kept, text_of(F.col(html)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
