"""Operator 1: main-text extraction by tag-path ratios.

A page is cut into blocks, each with its root-to-leaf tag path.  Text length and
punctuation are aggregated per path and divided by the path's number of blocks; both
ratios are smoothed along the page and fused to one weight for each block.  Paths
whose mean weight reaches a threshold are content paths, and their blocks are returned.
The threshold is overridden for

* the blocks of main and article elements: there only a container's own lines (a ``div``'s, not a
  paragraph's, list item's, cell's or the like) are judged, against a lower threshold and by their
  path's own ratios without their neighbours;
* headings, which stay if a block below them does;
* paragraphs with sentences (by their path's own means) and lists with text, under the lowest
  element that holds all content paths, main and article elements;
* blocks of mostly link text, which go if their path, or list, is mostly link text too and
  they are in no main or article element;
* elements that are named, by tag, class, id or role, as something other than article text
  or are hidden, which go unless they wrap the page's main text.

Defined results: null or empty html gives the empty text; pages without any tags are
one block; unclosed elements end where HTML ends them; very long pages are read whole;
repeated rows are extracted one by one; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from sigwin.llm.common import map_rows

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is not markup.
RAW = ("script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul caption option select button".split())
#: A start tag ends an open element of these kinds (HTML's implied end tags).
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "thead", "tbody"), "body": ("head",)}
#: Elements that an implied end does not reach out of.
SCOPE = frozenset(("table", "ul", "ol", "dl", "td", "th", "article", "section", "div", "main", "body", "html", "form",
                   "aside", "nav", "header", "footer", "blockquote", "figure"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
NOT_ARTICLE_TAGS = frozenset("head button select option legend script style noscript template iframe object svg math "
                             "canvas audio video".split())
#: Elements that are no part of an article, but may wrap the whole page.
WRAPPERS = frozenset(("nav", "aside", "footer", "form", "fieldset", "dialog", "menu", "search"))
#: Whole names in class, id and role of parts of a page other than its article.
NOT_ARTICLE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adslot ad-slot ad-banner ad-container ad-wrapper google-ad "
    "sponsor sponsored promo banner sidebar side-bar left-sidebar right-sidebar sidebar-left sidebar-right "
    "nav navbar nav-bar navigation nav-menu main-nav main-menu main-navigation site-nav site-navigation menu menubar "
    "breadcrumb breadcrumbs footer site-footer page-footer masthead topbar top-bar toolbar "
    "comment comments commentlist comment-list comments-area comments-section comment-form disqus disqus_thread replies "
    "respond cookie cookies cookie-notice cookie-banner cookie-bar cookie-consent consent gdpr popup modal overlay "
    "share sharing share-buttons social social-share social-links social-media related related-posts related-articles "
    "related-links recommended recommendations newsletter newsletter-signup subscribe subscription signup sign-up login "
    "widget widget-area pagination pager skip-link search searchbox search-box search-form searchform copyright "
    "contentinfo complementary dialog hidden toc skip promotion outbrain taboola sponsored-box sponsored-content ad-unit ad_unit adunit ad-box adbox notice notices site-notice alert alerts legal legal-notice disclaimer privacy-notice privacy-policy paywall author-bio reader-comment reader-comments user-comment user-comments".split())
#: Names of comments; an article element that bears one is a comment.
COMMENT_NAMES = frozenset("comment comments comment-body reader-comment reader-comments user-comment user-comments "
                          "reply replies".split())
#: Elements whose lines are text of the article they are in, however short.
TEXT_TAGS = frozenset("p li dt dd td th caption figcaption pre blockquote address details summary".split())
HEADER_NAMES = frozenset(("header", "site-header", "banner"))
PUNCTUATION = re.compile(r"[.,;:!?，。；：！？、]")
#: Fixed parameters: the smoothing kernel, the thresholds (within articles) as parts of the mean
#: weight, and the most link text of a kept block.
KERNEL = np.array([0.06, 0.24, 0.4, 0.24, 0.06])
THRESHOLD = 0.35
ARTICLE_THRESHOLD = 0.25
MOST_LINKS = 0.6
#: Characters without links that a path's paragraphs or lists have on average to be prose.
PROSE = 40


@dataclass
class Element:
    """``main`` is 3 for main elements, 2 for articles, 1 for what is named main; ``inside`` the most of all around."""

    tag: str
    parent: int
    path: str
    out: bool
    main: int = 0
    inside: int = 0
    named: bool = False


@dataclass
class Block:
    element: int
    parts: list = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _names(attributes: str) -> tuple[set[str], set[str], set[str], bool]:
    """The names in class, id and role, and whether the element is hidden."""
    names: dict[str, set[str]] = {"class": set(), "id": set(), "role": set()}
    hidden, seen = False, set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in seen:  # of an attribute given twice the first counts
            continue
        seen.add(name)
        if name in names:
            names[name].update(value.split())
        else:
            hidden = hidden or name == "hidden" or (name == "aria-hidden" and value.strip() == "true")
    return names["class"], names["id"], names["role"], hidden


def parse(source: str) -> tuple[list[Element], list[Block]]:
    """The page's elements and its blocks in order."""
    elements = [Element("", -1, "", False)]
    stack, blocks = [0], [Block(0)]
    links = 0

    def cut() -> None:
        if blocks[-1].parts:
            blocks.append(Block(stack[-1]))
        else:
            blocks[-1].element = stack[-1]

    def pop(to: int) -> None:
        nonlocal links
        for e in stack[to:]:
            links -= elements[e].tag == "a"
        if any(elements[e].tag in BLOCK for e in stack[to:]):
            del stack[to:]
            cut()
        else:
            del stack[to:]

    def add(text: str) -> None:
        if text:
            blocks[-1].parts.append(text)
            if links:
                blocks[-1].linked += len(text)

    at = 0
    for m in iter(lambda: TAG.search(source, at), None):
        add(html.unescape(source[at:m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            where = next((i for i in range(len(stack) - 1, 0, -1) if elements[stack[i]].tag == tag), 0)
            if where and (tag in BLOCK or not any(elements[e].tag in SCOPE for e in stack[where + 1:])):
                pop(where)
            continue
        if tag in RAW:
            end = RAW_END[tag].search(source, at)
            close = source.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else len(source)
            continue
        if tag in VOID:
            add(" ")
            if tag == "hr":
                cut()
            continue
        if tag in BLOCK:
            for ended in (("p",) if tag not in ("html", "body") else ()) + ENDS.get(tag, ()) + (
                    tuple(HEADINGS) if tag in HEADINGS else ()):
                for i in range(len(stack) - 1, 0, -1):
                    open_tag = elements[stack[i]].tag
                    if open_tag == ended:
                        pop(i)
                        break
                    if open_tag in SCOPE:
                        break
        classes, ids, roles, hidden = _names(attributes) if attributes.strip() else (set(), set(), set(), False)
        parent = stack[-1]
        # A heading's id is an anchor made of its text.
        names = classes | roles | (ids if tag not in HEADINGS else set())
        inside_main = elements[parent].inside
        page = tag in ("html", "body")
        comment = bool(names & COMMENT_NAMES)
        main = 0 if page else 3 if tag == "main" or "main" in roles else 2 if tag == "article" and not comment else int(
            "main" in names)
        named = not page and (hidden or tag in WRAPPERS or (not main and bool(names & NOT_ARTICLE_NAMES)) or (
            not inside_main and not main and (tag == "header" or bool(names & HEADER_NAMES))))
        own = tag + "".join(sorted("." + w for w in names)) if tag in BLOCK else ""
        # Within an article noscript holds what its script would show.
        gone = tag in NOT_ARTICLE_TAGS and not (tag == "noscript" and inside_main > 1)
        elements.append(Element(tag, parent, elements[parent].path + ("/" + own if own else ""),
                                elements[parent].out or gone, main, max(inside_main, main), named))
        stack.append(len(elements) - 1)
        links += tag == "a"
        if tag in BLOCK:
            cut()
    add(html.unescape(source[at:]))
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
    return elements, [b for b in blocks if b.text]


def path_weights(elements: list[Element], blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """For each block the fused ratios of its tag path: smoothed, and its own without its neighbours."""
    totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(3))
    for b in blocks:
        plain = max(0, len(b.text) - b.linked)
        totals[elements[b.element].path] += (plain, len(PUNCTUATION.findall(b.text)) if plain else 0, 1)
    ratios = np.array([totals[elements[b.element].path] for b in blocks])
    ratios = ratios[:, :2] / ratios[:, 2:]
    smooth = np.stack([np.convolve(np.pad(x, 2, mode="edge"), KERNEL, mode="valid") for x in ratios.T], 1)
    scale = np.maximum(smooth.max(0), 1e-9)
    fused, own = (np.sqrt((x[:, 0] / scale[0]) * ((x[:, 1] + 0.1) / (scale[1] + 0.1))) for x in (smooth, ratios))
    return fused, own


@dataclass
class PathTotal:
    """``linked``: mostly link text.  ``prose``: paragraphs with sentences, or lists with text, by the path's mean."""

    linked: bool
    prose: bool


def path_totals(elements: list[Element], blocks: list[Block]) -> list[PathTotal]:
    """For each block what its path is in itself, however long other blocks are; each list is one unit by itself."""
    def key(b: Block) -> tuple[str, int]:
        e = elements[b.element]
        return e.path, e.parent if e.tag == "li" else -1

    by_path: dict[tuple[str, int], list[Block]] = defaultdict(list)
    for b in blocks:
        by_path[key(b)].append(b)
    out = {}
    for path, own in by_path.items():
        size, linked = sum(len(b.text) for b in own), sum(b.linked for b in own)
        if elements[own[0].element].tag == "li":
            prose = size - linked >= PROSE
        else:
            prose = (elements[own[0].element].tag == "p" and size - linked >= PROSE * len(own)
                     and sum(len(PUNCTUATION.findall(b.text)) for b in own) >= len(own))
        out[path] = PathTotal(linked > MOST_LINKS * size, prose)
    return [out[key(b)] for b in blocks]


def judge_names(elements: list[Element], blocks: list[Block], weight: np.ndarray) -> None:
    """Take named elements and all in them out, but for those that wrap the page's main text.

    These are the elements that hold a main element, or most of the weight of the articles
    outside any named element; without such articles, most of all the weight.
    """
    free = [False] * len(elements)  # under an article that is in no named element
    under = [False] * len(elements)  # under a named element
    for i, e in enumerate(elements):
        under[i] = e.named or (i > 0 and under[e.parent])
        free[i] = not under[i] and (e.main > 1 or (i > 0 and free[e.parent]))
    articles = np.array([free[b.element] for b in blocks])
    core = np.where(articles, weight, 0.0) if (articles & (weight > 0)).any() else weight
    held = [0.0] * len(elements)
    wraps = [False] * len(elements)
    filled = [False] * len(elements)
    for b, w, any_w in zip(blocks, core, weight, strict=True):
        held[b.element] += w
        filled[b.element] |= bool(any_w > 0)
    for i in range(len(elements) - 1, 0, -1):
        e = elements[i]
        held[e.parent] += held[i]
        filled[e.parent] |= filled[i]
        wraps[i] |= e.main == 3 and filled[i]
        wraps[e.parent] |= wraps[i]
    for i, e in enumerate(elements[1:], 1):
        e.out |= elements[e.parent].out or (e.named and not wraps[i] and held[i] * 2 <= held[0])
        e.inside = 0 if e.out else e.inside


def headed(elements: list[Element], blocks: list[Block], chosen: np.ndarray) -> None:
    """Choose each heading that has a chosen block before the next heading of its rank or above."""
    below = [False] * 7
    for i in range(len(blocks) - 1, -1, -1):
        e = elements[blocks[i].element]
        if e.tag in HEADINGS:
            rank = int(e.tag[1])
            chosen[i] = not e.out and (chosen[i] or below[rank])
            # What is below this heading is not below another one of its rank.
            below[rank:] = [False] * (7 - rank)
            below[1:rank] = [x or bool(chosen[i]) for x in below[1:rank]]
        elif chosen[i]:
            below = [True] * 7


def common_ancestor(elements: list[Element], of: list[int]) -> int:
    """The lowest element that holds all of ``of``; parents come before their children."""
    top = of[0] if of else 0
    for e in of:
        while e != top:
            if e > top:
                e = elements[e].parent
            else:
                top = elements[top].parent
    return top


def extract(source: str | None) -> str:
    """The main text of a page, blocks joined by line feeds."""
    elements, blocks = parse(source or "")
    if not blocks:
        return ""
    fused, own_ratio = path_weights(elements, blocks)
    totals = path_totals(elements, blocks)
    link = np.array([b.linked > MOST_LINKS * len(b.text) and t.linked for b, t in zip(blocks, totals, strict=True)])
    size = np.array([len(b.text) for b in blocks], dtype=float)
    outside = np.array([elements[b.element].out for b in blocks])
    judge_names(elements, blocks, np.where(outside | link, 0.0, fused * size))
    outside = np.array([elements[b.element].out for b in blocks])
    # A class or id "main" counts on pages without main and article elements.
    inside = np.array([elements[b.element].inside for b in blocks])
    marked = inside >= max(1, min(2, inside.max()))
    link &= ~marked
    lines = np.array([elements[b.element].tag not in TEXT_TAGS | HEADINGS for b in blocks])
    if (outside | link).all():
        return ""
    weight = np.where(outside | link, 0.0, fused * size)
    by_path: dict[str, list] = defaultdict(list)
    for b, w, f in zip(blocks, weight, fused, strict=True):
        if w:
            by_path[elements[b.element].path].append(f)
    enough = THRESHOLD * float(np.average(fused, weights=np.maximum(weight, 1e-12)))
    content = {p for p, f in by_path.items() if np.mean(f) >= enough}
    chosen = np.array([w > 0 and elements[b.element].path in content for b, w in zip(blocks, weight, strict=True)])
    weak = marked & lines & (own_ratio < ARTICLE_THRESHOLD * enough)
    marked &= ~weak
    # A short block beside the content has its weight from there: it is kept, but does not widen the main element.
    chosen &= ~weak
    sure = chosen & (own_ratio >= THRESHOLD * enough)
    headed(elements, blocks, sure)
    chosen |= sure
    top = common_ancestor(elements, [b.element for b, c in zip(blocks, sure | marked, strict=True) if c])
    kept = np.zeros(len(blocks), dtype=bool)
    for i, b in enumerate(blocks):
        e = b.element
        while e > top:
            e = elements[e].parent
        kept[i] = e == top and not outside[i] and not link[i] and (chosen[i] or marked[i] or totals[i].prose)
    headed(elements, blocks, kept)
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def _report(page_id: list, url: list, source: list) -> dict:
    texts = [extract(x) for x in source]
    return {"page_id": page_id, "url": url, "text": texts, "n_chars": [len(t) for t in texts]}


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    return map_rows(pages.select("page_id", "url", "html"), "page_id long, url string, text string, n_chars long",
                    _report)
