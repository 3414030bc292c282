"""HTML main text as a maximum-scoring subsequence.

A page is a sequence of words and tags. Every word scores the weight of its
place (block element, link, page furniture), every tag a negative weight; a
linear scan finds the contiguous run with the largest sum: the content
region. Furniture inside the region (menus, forms, adverts, comments ...) is
left out, the rest is split into blocks.

The weights are log odds of a place or tag lying inside the article, counted
in Spark over all labelled pages: those whose markup names exactly one main
content element (``article``, ``main``, ``itemprop=articleBody``). The label
is used in training alone; scoring reads places and tags, so pages without
such markup are extracted too. Word weights are held in [-W, W] and tag
weights in [-MOST_TAG, -LEAST_TAG]; places never seen take fixed defaults.

Defined cases: null html counts as empty and gives the empty text; unclosed
or stray tags, truncated pages, repeated rows and null urls are all allowed;
other columns are ignored."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

W, LEAST_TAG, MOST_TAG = 4.0, 0.05, 1.0
DEFAULT_WORD, DEFAULT_LINK, DEFAULT_TAG, DEFAULT_FURNITURE = 0.5, -0.25, -0.05, -0.05

# Fixed names of the markup language.
RAW = ("script", "style", "template", "textarea", "title", "iframe", "svg", "select")
FURNITURE = ("nav", "footer", "aside", "form", "button", "dialog", "menu", "header", "head", "fieldset", "label")
BLOCKS = ("p", "div", "article", "section", "main", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt",
          "dd", "blockquote", "pre", "table", "tr", "td", "th", "thead", "tbody", "caption", "figure", "figcaption",
          "address", "hr", "body", "html", "details", "summary", "center")
VOID = ("br", "img", "hr", "input", "meta", "link", "wbr", "source", "col", "area", "base", "embed", "track", "param")
CONTENT = ("article", "main")
INLINE = ("a", "abbr", "acronym", "audio", "b", "bdi", "bdo", "big", "canvas", "cite", "code", "data", "datalist", "del",
          "dfn", "em", "font", "frame", "frameset", "hgroup", "i", "ins", "kbd", "legend", "map", "mark", "meter",
          "math", "noscript", "object", "optgroup", "option", "output", "picture", "progress", "q", "rp", "rt", "ruby", "s", "samp", "slot", "small",
          "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "video")
#: Every other name counts as one feature, ``?``, so that markup bounds the table of weights.
KNOWN = frozenset(RAW + FURNITURE + BLOCKS + VOID + CONTENT + INLINE + ("tfoot", "colgroup"))
# Fixed words of class, id and role attributes that mark page furniture.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "widget", "footer", "masthead", "topbar", "comment",
    "comments", "disqus", "reply", "replies", "respond", "cookie", "cookies", "consent", "gdpr", "notice", "alert",
    "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing",
    "social", "related", "recommended", "recommendations", "pagination", "pager", "toolbar", "complementary",
    "contentinfo", "search", "copyright", "legal", "skip", "hidden", "paywall", "header",
}

# Quotes enclose a value only right after =; others are part of a name or value.
_PART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)", re.S)
# Elements that hold others; only these are furniture by their id or label.
HOLDERS = ("div", "section", "ul", "ol", "dl", "table", "tbody", "tr", "td", "li", "figure", "details", "center", "address")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Za-z0-9]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)


def attributes(attrs: str) -> list[tuple[str, str]]:
    """Names (lower case) and values of a tag's attributes."""
    return [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attrs)]


def _hidden(attrs: list[tuple[str, str]]) -> bool:
    """Whether an element says that it is not shown; words of other values
    (titles, data) do not count."""
    return any(n == "hidden" or n == "aria-hidden" and v.strip().lower() == "true" or n == "style" and _NOT_SHOWN.search(v)
               for n, v in attrs)


def _is_body(attrs: list[tuple[str, str]]) -> bool:
    return any(n == "itemprop" and "articlebody" in v.lower().split() for n, v in attrs)


def _furniture(name: str, attrs: list[tuple[str, str]], in_content: bool) -> bool:
    """Whether an element is page furniture; a header inside named content
    is the article's own. Marks are whole names (``related``, ``social-share``);
    on elements that hold others outside named content also a word of a longer
    class, role or label, or the last word of an id (``site-header``)."""
    own = ("header",) if in_content else ()
    if name in FURNITURE and name not in own:
        return True
    if not attrs or name in ("html", "body") or name in CONTENT:
        return False
    if _hidden(attrs):
        return True
    for kind, value in attrs:
        if kind not in ("class", "id", "role", "aria-label"):
            continue
        if kind in ("id", "aria-label") and name not in HOLDERS:
            continue  # ids of headings and paragraphs are anchors made of their text
        for token in [value] if kind == "aria-label" else value.split():
            words = [w.lower() for w in _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token))]
            marks = [w in MARKS and w not in own for w in words]
            if any(marks) and (all(marks) or name in HOLDERS and not in_content and (kind != "id" or marks[-1])):
                return True
    return False


def parts(html: str) -> list[tuple[str, str, bool, str]]:
    """``(feature, text, block, element)`` of each part of a page in order: a
    run of words (feature ``w:<place>``) or a tag (``t:<name>``, no text);
    ``block`` says whether the tag ends a block, ``element`` names content
    elements opened (``+``) or closed (``-``) and, as ``(`` and ``)``, others
    that ``itemprop=articleBody`` names."""
    out: list[tuple[str, str, bool, str]] = []
    stack: list[tuple[str, bool]] = []  # open elements that place words, and whether they are furniture
    bodies: list[int] = []  # depths of the open article bodies
    endless: set[str] = set()  # elements that no end tag follows
    names: Counter[str] = Counter()  # of the stack
    at, size = 0, len(html)

    def push(name: str, extra: bool) -> None:
        stack.append((name, extra))
        names.update((name, "!") if extra else (name,))

    def pop() -> str:
        name, extra = stack.pop()
        names.subtract((name, "!") if extra else (name,))
        return name

    def place() -> str:
        block = next((n for n, _ in reversed(stack) if n != "a"), "body")
        block = block if block in KNOWN else "?"
        return f"w:{'!' if names['!'] else ''}{block}{'+a' if names['a'] else ''}"

    def words(text: str) -> None:
        if text.strip():
            out.append((place(), text, False, ""))

    while at < size:
        m = _PART.search(html, at)
        if m is None:
            words(html[at:])
            break
        if m.start() > at:
            words(html[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        tail, closing = m[3] or "", bool(m[1])
        attrs = [] if closing or "=" not in tail and "hidden" not in tail.lower() else attributes(tail)
        element = ""
        if name in RAW and not closing:
            end = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(html, at)
            if end is None:
                endless.add(name)
            at = end.end() if end else (size if name in ("script", "style") else at)
            out.append((f"t:{name}", "", False, ""))
            continue
        if closing:
            if names[name]:
                while pop() != name:
                    pass
            element = "-" if name in CONTENT else ""
            while bodies and len(stack) < bodies[-1]:
                bodies.pop()
                element = element or ")"
        elif name not in VOID and not tail.rstrip().endswith("/"):
            body = _is_body(attrs)
            if name in CONTENT or body:
                # content never lies in furniture that was left open
                while names["!"]:
                    pop()
                element = "+" if name in CONTENT else ""
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
                while stack and stack[-1][0] in (name, "a", "p"):
                    pop()
            extra = _furniture(name, attrs, any(names[n] for n in CONTENT))
            if name in BLOCKS or name == "a" or extra:
                push(name, extra)
                if body and not element:
                    bodies.append(len(stack))
                    element = "("
        out.append((f"t:{'/' if closing else ''}{name if name in KNOWN else '?'}", "", name in BLOCKS or name in FURNITURE, element))
    return out


def _labelled(seq: list[tuple[str, str, bool, str]]) -> list[bool] | None:
    """Which parts lie in the page's one content element: the innermost of
    nested ones, an ``articleBody`` where no element is named so; None
    without one or with several side by side."""
    for opened, closed in ("+-", "()"):
        inner, open_at = [], []  # (start, end) of elements that hold no other
        for i, (_, _, _, mark) in enumerate(seq):
            if mark == opened:
                open_at.append(i)
            elif mark == closed and open_at:
                start = open_at.pop()
                if not any(start < a for a, _ in inner):
                    inner.append((start, i))
        for start in reversed(open_at):  # left open
            if not any(start < a for a, _ in inner):
                inner.append((start, len(seq)))
        if len(inner) == 1:
            start, end = inner[0]
            return [start < i < end for i in range(len(seq))]
        if inner:
            return None
    return None


def learn(pages: DataFrame) -> dict[str, float]:
    """Feature weights from all labelled pages."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list[int]] = {}
        for b in batches:
            for html in b["html"]:
                seq = parts(html or "")
                inside = _labelled(seq)
                if inside is None:
                    continue
                for (f, text, _, _), yes in zip(seq, inside):
                    total.setdefault(f, [0, 0])[not yes] += len(text.split()) if text else 1
        yield pd.DataFrame([(f, a, b) for f, (a, b) in total.items()], columns=["feature", "inside", "outside"])

    # one row a feature: places and tags by known names, a few hundred at most
    got = (pages.select("html").mapInPandas(count, "feature string, inside long, outside long").groupBy("feature")
           .agg(F.sum("inside").alias("a"), F.sum("outside").alias("b")).collect())
    weights = {}
    for kind, low, high in (("w", -W, W), ("t", -MOST_TAG, -LEAST_TAG)):
        rows = [r for r in got if r["feature"][0] == kind]
        # words start even; tags carry the odds of their own kind
        for r in rows:
            odds = np.log((r["a"] + 0.5) / (r["b"] + 0.5))
            weights[r["feature"]] = float(min(high, max(low, odds)))
    return weights


def _weight(weights: dict[str, float], feature: str) -> float:
    if feature in weights:
        return weights[feature]
    if feature[0] == "t":
        return DEFAULT_TAG
    if "!" in feature:
        return DEFAULT_FURNITURE  # an aside amid an article does not end it
    if feature.endswith("+a"):
        return 0.5 * weights[feature[:-2]] if feature[:-2] in weights else DEFAULT_LINK
    return DEFAULT_WORD


def extract(html: str | None, weights: dict[str, float]) -> str:
    """The main text: blocks of the best region, one a line."""
    seq = parts(html or "")
    best, start, end, total, first = 0.0, 0, 0, 0.0, 0
    for i, (feature, text, _, _) in enumerate(seq):
        w = _weight(weights, feature)
        if total <= 0:
            total, first = 0.0, i
        total += w * len(text.split()) if text else w
        if total > best:
            best, start, end = total, first, i + 1
    blocks, now = [], []
    for feature, text, block, _ in seq[start:end]:
        if text:
            if not feature.startswith("w:!"):
                now.append(text)
        elif block:
            blocks.append("".join(now))
            now = []
        elif feature in ("t:br", "t:/br", "t:td", "t:th"):
            now.append(" ")
    blocks.append("".join(now))
    lines = [" ".join(unescape(b).split()) for b in blocks]
    return "\n".join(x for x in lines if x)


def main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page row."""
    weights = learn(pages) if weights is None else weights

    @F.pandas_udf(T.StringType())
    def text_of(htmls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in htmls:
            yield pd.Series([extract(h, weights) for h in batch], dtype=object)

    return (pages.select("page_id", "url", text_of(F.col("html")).alias("text"))
            .withColumn("n_chars", F.length("text").cast("bigint")))
