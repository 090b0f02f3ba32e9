"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of blocks, each with its number of words, its link density, those of its neighbours, and
what the elements around it and their names say. Names are a hint only: one that most of the article or page stands
under, or that the article itself stands in, doesn't count. A small decision tree, trained on a labelled table of
blocks, tells the article from the rest; the blocks of the article are joined.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_of

# Elements of HTML by what they do to text.
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select
summary table tbody td tfoot th thead tr ul""".split())
SKIP = set("script style noscript template title textarea svg math iframe object select button head".split())
RAW = set("script style textarea title".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# closing an element of the first kind is implied when one of the second kind starts
IMPLIED = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
AROUND = {"nav", "footer", "header", "aside", "form", "menu", "dialog", "search", "fieldset", "button"}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|sponsor(?:ed)?|promo(?:tion)?s?|banner|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side|widget|related|recommend(?:ed|ations)?|"
    r"footer|foot|header|masthead|copyright|legal|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|social|share|sharing|"
    r"comments?|comment-list|disqus|replies|reply|respond|discussion|pager|pagination|toolbar|tags|meta|byline)(?:$|[\s_-])",
    re.I,
)
IN_HEAD = {"meta", "title", "link", "style", "script", "base", "noscript", "template"}
MOST = 0.8  # of the words of an article or page; a name that so many stand under says nothing
NOT_IT = re.compile(r"(?:^|\s)(?:with|has|no|without|is)[-_]\S*", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
MAIN = {"article", "main"}
TAG = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|(?![\"'])[^\s>]*))*)(?:>|$))", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"\w+")


class _State(NamedTuple):
    """What the open elements say: number of the outermost named element without and within the article, number of the article."""

    name: str = ""
    around: bool = False
    article: int = 0
    link: bool = False
    outer: int = 0
    inner: int = 0


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool, bool]]:
    """(text, words, words in links, in the page's furniture, under a name of furniture, in an article, heading) of each block."""
    out: list[tuple] = []
    stack: list[_State] = []
    buffer: list[tuple[str, bool]] = []
    heading = False
    numbers = count(1)

    def flush() -> None:
        if buffer:
            text = SPACE.sub(" ", html.unescape("".join(t for t, _ in buffer))).strip()
            if text:
                linked = sum(len(WORD.findall(html.unescape(t))) for t, in_link in buffer if in_link)
                out.append((text, len(WORD.findall(text)), linked, heading, stack[-1] if stack else _State()))
            buffer.clear()

    at, skipped, end = 0, None, len(page)
    while at < end:
        tag = TAG.search(page, at)
        if skipped:
            close = re.compile(rf"</{re.escape(skipped)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
            if skipped in RAW or close is None:
                # without an end tag only these go on to the end of the page
                at, skipped = (close.end() if close else end if skipped in RAW else at), None
                continue
            depth, place = 1, at
            for m in re.compile(rf"<(/?){re.escape(skipped)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
                depth += -1 if m[1] else 1
                place = m.end()
                if not depth:
                    break
            at, skipped = (place if not depth else close.end()), None
            continue
        text = page[at : tag.start() if tag else end]
        if text:
            if stack and stack[-1].name == "head" and not text.isspace():
                stack.pop()
            buffer.append((text, bool(stack) and stack[-1].link))
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(x[0] in BLOCK for x in stack[k + 1 :]) and name not in BLOCK:
                        break  # an inline end tag doesn't close blocks
                    del stack[k:]
                    break
            heading = any(re.fullmatch("h[1-6]", x[0]) for x in stack[-3:])
            continue
        if name == "br":
            buffer.append((" ", False))
            continue
        if stack and stack[-1].name == "head" and name not in IN_HEAD:
            stack.pop()  # its end tag may be left out
        if name in BLOCK:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if name in IMPLIED.get(stack[k][0], ()):
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE.get(name, BLOCK):
                    break
        if name in SKIP and not (name == "head"):
            if name not in VOID and not tag[3].rstrip().endswith("/"):
                skipped = name
            continue
        if name in VOID:
            continue
        attributes = {m[1].lower(): next((g for g in m.groups()[1:] if g), "") for m in ATTRIBUTE.finditer(tag[3])} if tag[3] else {}
        up = stack[-1] if stack else _State()
        role = attributes.get("role", "").lower()
        named = NOT_IT.sub(" ", f"{attributes.get('class', '')} {attributes.get('id', '')}")
        article = up.article or (next(numbers) if name in MAIN or role in ("main", "article") else 0)
        around = up.around or name == "head" or name in AROUND and not (name == "header" and article) or role in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
        hint = next(numbers) if name not in ("html", "body", *MAIN) and NAMED.search(named) else 0
        stack.append(_State(name, around, article, up.link or name == "a", up.outer or (0 if article else hint), up.inner or (hint if article else 0)))
        if re.fullmatch("h[1-6]", name):
            heading = True
    flush()
    return _weighed(out)


def _weighed(found: list[tuple]) -> list[tuple]:
    """Names that most of the words stand under are dropped, and those around the article with the most words."""
    own = [(words - linked) * (not state.around) for _, words, linked, _, state in found]
    under: dict[tuple, int] = {}
    for n, (*_, state) in zip(own, found):
        for key in (("page", 0), ("outer", state.outer), ("inner", state.inner), ("article", state.article)):
            under[key] = under.get(key, 0) + n
    articles = [k for k in under if k[0] == "article" and k[1]]
    largest = max(articles, key=lambda k: (under[k], -k[1]))[1] if articles else 0
    out = []
    for text, words, linked, heading, state in found:
        inside = under["article", state.article] if state.article else under["page", 0]
        outer = state.outer and not (articles and state.article == largest) and (bool(articles) or under["outer", state.outer] < MOST * under["page", 0])
        inner = state.inner and under["inner", state.inner] < MOST * inside
        out.append((text, words, linked, state.around, bool(outer or inner), bool(state.article), heading))
    return out


FEATURES = ["words", "link_density", "furniture", "named", "article", "heading", "page_has_article", "words_before", "link_density_before", "words_after", "link_density_after"]


def features(found: list[tuple]) -> np.ndarray:
    """FEATURES of each block of a page; beyond its ends there are blocks without words."""
    n = len(found)
    words = np.array([0, *(b[1] for b in found), 0], float)
    density = np.array([0, *(b[2] for b in found), 0], float) / np.maximum(words, 1)
    flags = np.array([b[3:7] for b in found], float).reshape(n, 4)
    return np.column_stack([words[1:-1], density[1:-1], flags, np.full(n, float(flags[:, 2].any() if n else 0)), words[:-2], density[:-2], words[2:], density[2:]])


def examples() -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: blocks of small made-up pages, those of the article being marked by a plus sign."""
    prose = "It was late in the year when the first boats came back and the harbour filled with people who had waited for them all night"
    short, link = "Read on here", '<a href="/x">{}</a>'
    menu = "".join(f"<li>{link.format(w)}</li>" for w in ("Home", "News", "Sport", "About us", "Contact"))
    nav = f"<nav><ul>{menu}</ul></nav>"
    foot = "<footer>(c) Example Press. All rights reserved by the owners of this page and its many writers.</footer>"
    ad = f'<div class="ad">{prose} and buy it now</div>'
    comments = f'<section class="comments"><h3>Comments</h3><p>{prose}</p><p>I agree</p></section>'
    notice = f'<div class="cookie-notice">We use cookies. {prose}</div>'
    aside = f"<aside><h4>More</h4><p>{prose}</p><ul>{menu}</ul></aside>"
    form = f"<form><label>Your name</label><p>{prose}</p></form>"
    paragraphs = [f"<p>+{prose}. {prose}.</p>", "<p>+Short one.</p>", f"<p>+See {link.format('this page')} for what {prose}</p>", f"<p>+{link.format('A whole linked line of text')}</p>", "<ul><li>+First point</li><li>+Second point of the list</li></ul>", f"<blockquote>+{prose}</blockquote>", "<p>+Yes</p>"]
    pages = []
    for k in range(len(paragraphs)):
        body = "<h1>+A title</h1>" + "".join(paragraphs[(k + j) % len(paragraphs)] for j in range(1 + k)) + "<h2>+Next part</h2>" + paragraphs[k]
        for wrap in ("<article>{}</article>", "<main>{}</main>", f"<article>{{}}{comments}{ad}</article>", f"<main>{{}}{aside}{form}</main>"):
            pages.append(f"{nav}{ad}{wrap.format(body)}{aside}{foot}")
            pages.append(f'{notice}<header><p>{prose}</p></header>{wrap.format(body)}{form}{comments}{foot}')
            pages += [wrap.format(body), f"{nav}{wrap.format(body)}", f"{wrap.format(body)}<p>{prose}</p>", f"<p>{short}</p>{wrap.format(body)}<p>{short}</p>", f"<p>{prose}</p>{wrap.format('<p>+Yes</p>')}"]
            pages.append(f"<div><p>{short}</p></div>{nav}{wrap.format(body)}<div>{link.format('Next page')}</div><p>{prose}</p>")
        # without elements that name the article, words and links decide
        text = "".join(f"<p>+{prose} {prose}</p>" for _ in range(2 + k % 3))
        pages.append(f"{nav}<div><ul>{menu}</ul></div><div><h1>+A title</h1>{text}<p>+{prose}</p></div><div>{link.format('Next page')} {link.format('Home')}</div><div>Site map</div>{foot}")
        pages.append(f"{ad}<div>{link.format('Home')}</div><div>{text}<p>+Short one.</p>{text}</div>{comments}<div>{link.format('Imprint')} {link.format('Privacy')}</div>")
        some = prose.split()
        parts = "".join(f"<p>+{' '.join(some[j : j + 6 + 3 * ((j + k) % 5)])}</p>" for j in range(0, 12, 2))
        pages += [f"<div>{parts}</div>", f"<div>{text}</div>", f"{nav}<div>{parts}</div>{foot}", f"<p>+{' '.join(some[: 5 + k])}</p>", f"<div><h1>+A title</h1>{parts}</div><div>{link.format('Next page')}</div>"]
    x, y = [], []
    for page in pages:
        found = blocks(page)
        x.append(features(found))
        y += [b[0].startswith("+") for b in found]
    return np.concatenate(x), np.array(y)


class Tree:
    """A binary decision tree by Gini impurity; of equal splits the first feature and lowest threshold is taken."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
        self.nodes: list[tuple] = []  # (feature, threshold, below, above) or (None, answer)
        self._grow(x, y.astype(float), depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        me = len(self.nodes)
        self.nodes.append((None, bool(y.mean() >= 0.5) if len(y) else False))
        if not depth or len(y) < 2 * least or y.min() == y.max():
            return me
        best = (y.mean() * (1 - y.mean()) * len(y) - 1e-9, None, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, above = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            cut = cut[(cut >= least) & (cut <= len(y) - least)]
            if len(cut):
                a, b = above[cut - 1], above[-1] - above[cut - 1]
                impurity = a * (1 - a / cut) + b * (1 - b / (len(y) - cut))
                k = int(np.argmin(impurity))
                if impurity[k] < best[0] - 1e-9:
                    best = (float(impurity[k]), f, float(v[cut[k] - 1] + v[cut[k]]) / 2)
        if best[1] is not None:
            low = x[:, best[1]] <= best[2]
            below = self._grow(x[low], y[low], depth - 1, least)
            above = self._grow(x[~low], y[~low], depth - 1, least)
            self.nodes[me] = (best[1], best[2], below, above)
        return me

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for i, row in enumerate(x):
            node = self.nodes[0]
            while node[0] is not None:
                node = self.nodes[node[2] if row[node[0]] <= node[1] else node[3]]
            out[i] = node[1]
        return out


def extract_page(page: str, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n\n".join(b[0] for b, good in zip(found, tree(features(found))) if good)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text) for each row: the text of the blocks taken for the article, in order, two newlines between.

    White space within a block is one space. Null and empty pages and pages without an article give an empty text;
    tags that aren't closed, and pages that break off, are read as far as they go. Repeated rows stay, null ids stay
    null, other columns don't matter, an empty table gives no rows.
    """
    bound_batches(pages.sparkSession)
    tree = Tree(*examples())
    source = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text_of(page).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                text = [extract_page(p.as_py(), tree) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return source.mapInArrow(run, "page_id long, url string, text string")
