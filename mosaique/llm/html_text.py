"""Main text of web pages by the ratios of their tag paths."""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag's beginning, and its rest: quotes hold a ">" only after "=", so that a stray one does not swallow the text. Every
#: part is taken whole, without a way back, so that a page costs as many steps as it has characters.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
SPACE = re.compile(r"\s+")
#: Fixed lists of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head script style noscript template iframe svg math canvas object select option button textarea input title nav aside menu dialog footer audio video".split())
CONTENT = frozenset("article main".split())
#: Fixed lists: whole names in class, id or role that mark what is no content, and how longer ones begin.
NAMES = frozenset("""ad ads adsense advert adverts advertisement advertising banner banners sponsor sponsored sponsors promo promos promotion nav navigation navbar topnav
    menu menubar breadcrumb breadcrumbs footer header masthead sidebar side aside widget widgets related recommended recommendations share sharing social comment comments
    commentlist replies disqus respond cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login search pagination pager toolbar skip
    copyright legal disclaimer complementary contentinfo dialog alert
    site-header site-footer site-nav site-navigation page-header page-footer main-nav main-menu main-navigation""".split())
PREFIXES = ("ad-", "ads-", "ad_", "ads_", "advert-", "sponsored-", "promo-", "nav-", "navbar-", "menu-", "breadcrumb-", "sidebar-", "widget-", "widget_", "related-", "recommended-", "share-", "sharing-", "social-", "comment-", "comments-", "cookie-", "consent-", "gdpr-", "popup-", "modal-", "newsletter-", "pagination-")
#: Ends of names that say a state of the element or page, not what it holds.
STATES = ("-open", "-closed", "-on", "-off", "-left", "-right", "-enabled", "-disabled", "-none")
#: Of the names, those that the page's own text never bears, whatever their length: adverts, menus, notes on cookies, readers' answers.
SURE = frozenset("ad ads adsense advert adverts advertisement advertising sponsor sponsored sponsors nav navigation navbar menu menubar breadcrumb breadcrumbs cookie cookies consent gdpr comment comments commentlist replies disqus respond".split())
#: How much a mark of content weighs: times the ratio of a block in article or main.
PRIOR = 4.0
IMPLIED = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
BLOCK_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Within these a p that is open outside stays so; and elements that are boilerplate unless they hold the page itself.
KEEPS_P = frozenset("article main section div td li blockquote body".split())
DOUBTFUL = frozenset("form fieldset".split())
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؟]")


class Node:
    """A block of text: the number of its path of tags, its text, how much of it is in links, and what encloses it."""

    __slots__ = ("path", "text", "linked", "never", "content", "named")

    def __init__(self, path: int, text: str, linked: int, never: bool, content: bool, named: int):
        self.path, self.text, self.linked, self.never, self.content, self.named = path, text, linked, never, content, named


class Open(NamedTuple):
    """An open element, with what holds of all that it lies in: path and marks leave inline elements out."""

    name: str
    path: int
    never: bool
    content: bool  # in an article or main
    block_content: bool  # the same of the nearest element that is a block
    named: int  # the nearest element named as boilerplate; 0 for none
    link: bool
    paragraph: int  # where in the stack the nearest open p is, if no block that keeps it open lies between; -1 for none


def named_boilerplate(words: str) -> str:
    """The first of the ``words`` that is a name of boilerplate, or begins as one and does not end as a state; empty if none."""
    for w in words.lower().split():
        if w in NAMES or w.startswith(PREFIXES) and not w.endswith(STATES):
            return w
    return ""


def lift(nodes: list[Node], above: list[int], sure: set[int]) -> None:
    """Sets ``never`` of the blocks in elements named as boilerplate, but for elements that hold the page itself.

    Those are elements with over half of the text in article or main, or over half of all text, so that no name around the
    page empties it. ``sure`` ones can be longer than a short page's text; they count as the page only if an article or
    main lies in them and nothing outside. ``above`` has the next such element around each, always of a lower number.
    """
    whole, marked = [0] * len(above), [0] * len(above)
    for n in nodes:
        if not n.never:
            whole[n.named] += len(n.text)
            marked[n.named] += len(n.text) * n.content
    for k in range(len(above) - 1, 0, -1):
        whole[above[k]] += whole[k]
        marked[above[k]] += marked[k]
    bad = [False] * len(above)
    for k in range(1, len(above)):
        page = whole[k] == whole[0] and marked[0] > 0 if k in sure else 2 * marked[k] > marked[0] > 0 or 2 * whole[k] > whole[0]
        bad[k] = bad[above[k]] or not page
    for n in nodes:
        n.never = n.never or bad[n.named]


def blocks(source: str) -> list[Node]:
    """The page's text blocks in order. Unclosed and stray tags are borne: an end tag closes up to its own start, if any.

    Paths are numbers, and what holds of an element's surroundings is kept with it, so that depth costs nothing.
    """
    root = Open("", 0, False, False, False, 0, False, -1)
    stack: list[Open] = []
    paths: dict[tuple[int, str], int] = {}
    opened: dict[str, int] = defaultdict(int)
    out: list[Node] = []
    above, sure = [0], set()
    held: list[str] = []
    linked = at = 0
    quoted = True

    def end_block() -> None:
        nonlocal linked
        if held:
            text = SPACE.sub(" ", html_lib.unescape("".join(held))).strip()
            if text:
                top = stack[-1] if stack else root
                out.append(Node(top.path, text, linked, top.never, top.block_content, top.named))
        held.clear()
        linked = 0

    def pop_to(index: int) -> None:
        if any(x.name not in INLINE for x in stack[index:]):
            end_block()
        for x in stack[index:]:
            opened[x.name] -= 1
        del stack[index:]

    def add(text: str) -> None:
        nonlocal linked
        if text:
            held.append(text)
            if stack and stack[-1].link:
                linked += len(text.strip())

    while True:
        start = source.find("<", at)
        if start < 0:
            add(source[at:])
            break
        add(source[at:start])
        m = TAG.match(source, start)
        if m is None:
            opening, closing = next(((o, c) for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")) if source.startswith(o, start)), ("", ""))
            if not opening:
                add("<")
                at = start + 1
                continue
            end = source.find(closing, start + len(opening))
            at = end + len(closing) if end >= 0 else len(source)
            continue
        rest = REST.match(source, m.end()) if quoted else None
        # A tag without an end is text; after one no other is looked for in the same way.
        at = rest.end() if rest else source.find(">", m.end()) + 1
        if not rest:
            quoted = False
        if not at:
            add(source[start:])
            break
        name, attributes = m[2].lower(), source[m.end() : at - 1]
        if m[1]:
            if opened[name]:
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                pop_to(k)
            elif name not in INLINE:
                end_block()
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
            at = close.end() if close else len(source)
            continue
        if name == "br":
            held.append(" ")
            continue
        if name not in INLINE:
            end_block()
            if name in BLOCK_ENDS_P:
                if stack and stack[-1].paragraph >= 0:
                    pop_to(stack[-1].paragraph)
            elif name in IMPLIED and stack and stack[-1].name in IMPLIED[name]:
                pop_to(len(stack) - 1)
        if name in VOID or attributes.endswith("/"):
            continue
        marks = {}
        for k, v in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
            marks.setdefault(k.lower(), v.strip("\"'"))
        up = stack[-1] if stack else root
        inside = up.content or name in CONTENT or marks.get("role", "").lower() in ("main", "article") or marks.get("id", "").lower() in ("content", "main-content", "article")
        never = up.never or name in NEVER or (name == "header" and not up.content) or "hidden" in marks or marks.get("aria-hidden", "").lower() == "true" or NOT_SHOWN.search(marks.get("style", "")) is not None
        named = up.named
        found = named_boilerplate(" ".join(marks.get(k, "") for k in ("class", "id", "role"))) if name not in ("html", "body", "main") else ""
        if found or name in DOUBTFUL:
            above.append(named)
            named = len(above) - 1
            if found and re.split("[-_]", found)[0] in SURE:
                sure.add(named)
        inline = name in INLINE
        path = up.path if inline else paths.setdefault((up.path, name), len(paths) + 1)
        paragraph = len(stack) if name == "p" else -1 if name in KEEPS_P else up.paragraph
        stack.append(Open(name, path, never, inside, up.block_content if inline else inside, named, up.link or name == "a", paragraph))
        opened[name] += 1
    end_block()
    lift(out, above, sure)
    return out


def _smooth(values: list[float]) -> list[float]:
    """Each value with its neighbours, weighted 1-2-1."""
    n = len(values)
    return [(values[max(0, k - 1)] + 2 * v + values[min(n - 1, k + 1)]) / 4 for k, v in enumerate(values)]


def main_text(source: str) -> str:
    """Blocks of the tag paths that hold content, joined by blank lines.

    Per path: characters outside links per node, and punctuation per node, aggregated over the page. Both ratios are read
    back in page order, smoothed over neighbours, and fused as a geometric mean; a path whose mean lies at or above the
    threshold (a part of the page's deviation from zero) is selected whole, blocks that are mostly links aside. Elements that never hold content do not count.
    Where the page marks its content (article, main), a block's fused ratio counts ``PRIOR`` times in its path's mean, so
    that headlines and short paragraphs stay; the threshold is that of the plain ratios, and decides marked pages too.
    """
    nodes = [n for n in blocks(source) if not n.never]
    if not nodes:
        return ""
    text: dict[int, float] = defaultdict(float)
    marks: dict[int, float] = defaultdict(float)
    count: dict[int, int] = defaultdict(int)
    for n in nodes:
        count[n.path] += 1
        text[n.path] += max(0, len(n.text) - n.linked)
        marks[n.path] += len(PUNCTUATION.findall(n.text)) * (1 - min(1.0, n.linked / len(n.text)))
    length = _smooth([text[n.path] / count[n.path] for n in nodes])
    points = _smooth([1 + marks[n.path] / count[n.path] for n in nodes])
    fused = [math.sqrt(a * b) for a, b in zip(length, points, strict=True)]
    limit = 0.3 * math.sqrt(sum(f * f for f in fused) / len(fused))
    score: dict[int, float] = defaultdict(float)
    for n, f in zip(nodes, fused, strict=True):
        score[n.path] += f * (PRIOR if n.content else 1) / count[n.path]
    return "\n\n".join(n.text for n in nodes if score[n.path] >= limit and n.linked < 0.5 * len(n.text))


def extract_text(pages: DataFrame) -> DataFrame:
    """Every row of ``pages`` (page_id, url, html) with its main text (empty if none) and that text's code points.

    One pass, each page on its own: nothing is shuffled. A null html is empty; a page costs as many steps as it has
    characters, however deep its elements nest and whatever it leaves open. Repeated rows, null ids and URLs pass through;
    no rows give no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
