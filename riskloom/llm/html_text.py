"""Main text of web pages by tag-path ratios.

A page's text blocks are grouped by their path of block tags from the root to the
leaf. A path's ratio joins its text length and its punctuation, each per block.
Ratios are smoothed over the containers that a path runs through, every container
having the mean ratio of the text in it, less where it holds little of the page's
text, then fused with the path's own ratio. The paths over a share of the page's own
mean are the content, ``article`` and ``main`` included. Names of page furniture and
of articles only weigh a ratio, within the bounds of WEAK and STRONG; text that is not
displayed is none. Paths are nodes of a tree, so the work is linear in the page,
however many classes or levels it has.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import map_rows, own_columns

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/><]*)((?>[^>\"'<]+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z|(?=<))", re.S)
#: Elements that begin a block. Fixed values.
BLOCK = set("html head body p div section article main header footer nav aside h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address form fieldset details summary hr center dialog menu hgroup search".split())
#: Elements whose content is no text.
SKIP = set("script style noscript template iframe object embed svg math canvas video audio map select option datalist button textarea title head input label legend".split())
#: Elements whose content is not parsed.
RAW = set("script style textarea title iframe noembed noframes xmp".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag in the value's set ends an open element of the key.
ENDS = {"p": BLOCK - {"html", "head", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"}}
#: Ends of elements never reach out of these.
SCOPE = {"table", "article", "section", "main", "body", "html", "td", "th"}
FURNITURE = set("nav footer aside form fieldset menu dialog search".split())
ROLES = re.compile(r"\b(?:navigation|banner|contentinfo|complementary|search|menu|menubar|alert|dialog|form|note|toolbar)\b")
#: Names of furniture, and names that furniture and articles both have.
NAMES = re.compile(
    r"ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion)?s?|banners?|nav(?:igation|bar)?|menus?|breadcrumbs?|sidebars?|footers?|"
    r"headers?|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscribe|signup|login|comments?|replies|respond|disqus|share|sharing|"
    r"widgets?|pagination|pager")
DOUBTFUL = re.compile(r"side|foot|social|related|recommended|recommendations|tags?|skip|hidden|copyright|legal|disclaimer|rail")
LABEL = re.compile(r"(class|id|role|aria-label|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
HEAD = re.compile(r"headers?|masthead|banners?")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
#: Elements whose mean ratio smooths the ratios of the paths in them; inside an article there is the article alone.
BOXES = set("html body div section article main center nav header footer aside form".split())
#: Elements whose text may be all links and is prose still.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Share of the page's mean ratio that a path needs; share of links over which a path is a menu; weights of a path's own ratio
#: against its container's, and of a container's mean against the one around it.
THRESHOLD, MENU, OWN, NEAR = 0.5, 0.6, 0.3, 0.75
#: What the names of furniture leave of a ratio at least, and what those of an article make of it at most.
WEAK, STRONG = 0.15, 3.0
#: Share of the mean without names that the page's mean counts as at least, so that a page of furniture alone has no content.
BARE = 0.4


def weight(tag: str, attributes: str, inside: bool) -> float:
    """Factor of an element's names, from WEAK to STRONG, or 0 if it is not displayed; ``inside`` tells that an article is open.

    Names of several words weigh by the share of the words that are furniture's: ``ad`` in full, ``notice board`` by half.
    """
    factor = STRONG if tag in ("article", "main") and not inside else WEAK if tag in FURNITURE or tag == "header" and not inside else 1.0
    if tag in ("html", "body") or not attributes:
        return factor
    for m in LABEL.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" and (not value or value in ("hidden", "true")) or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 0.0
        if name == "role" and ROLES.search(value):
            factor = min(factor, WEAK)
        if name in ("class", "id") and tag not in ("article", "main"):
            words = [w for w in re.split(r"[\s_-]+", value) if w and not (inside and HEAD.fullmatch(w))]
            named = sum(1.0 if NAMES.fullmatch(w) else 0.5 if DOUBTFUL.fullmatch(w) else 0.0 for w in words)
            factor = min(factor, WEAK ** (named / max(1, len(words))))
    return factor


@dataclass(slots=True)
class Path:
    """A node of the tree of tag paths, with the sums of its own blocks."""

    tag: str
    up: int
    box: int  # the container whose mean smooths this path
    inside: bool
    left: float
    count: int = 0
    chars: int = 0
    marks: int = 0
    linked: int = 0
    ways: dict = field(default_factory=dict)

    def ratio(self) -> float:
        """Text length and punctuation per block, as one figure; menus lose the share that is links."""
        if not self.chars:
            return 0.0
        menu = self.linked / self.chars
        return math.sqrt(self.chars / self.count * (1 + self.marks / self.count)) * (1 - menu if menu > MENU and self.tag not in PROSE else 1)


def blocks(page: str) -> tuple[list[Path], list[tuple[int, str]]]:
    """The tree of paths, parents before children, and (path, text) of every block in page order."""
    tree = [Path("", 0, 0, False, 1.0)]
    found: list[tuple[int, str]] = []
    stack, run = [0], []
    open_tags, scopes = Counter(), [Counter()]  # all open elements; those since each scope began
    linked = links = skipping = 0
    skip_tag, at = "", 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            x = tree[stack[-1]]
            x.count, x.chars, x.marks, x.linked = x.count + 1, x.chars + len(text), x.marks + len(PUNCTUATION.findall(text)), x.linked + min(linked, len(text))
            found.append((stack[-1], text))
        run.clear()
        linked = 0

    def pop() -> str:
        tag = tree[stack.pop()].tag
        open_tags[tag] -= 1
        if tag in SCOPE:
            scopes.pop()
        else:
            scopes[-1][tag] -= 1
        return tag

    def push(tag: str, attributes: str) -> None:
        label = re.search(r"class\s*=\s*[\"']?([\w -]+)", attributes, re.I) if tag in ("div", "section", "td") else None
        up = tree[stack[-1]]
        own = weight(tag, attributes, up.inside)
        left = up.left * own if own >= 1 else min(up.left, own * (STRONG if up.inside else 1))
        way = (tag, label[1].strip() if label else "", left)
        if way not in up.ways:
            up.ways[way] = len(tree)
            box = len(tree) if not up.inside and tag in BOXES else up.box
            tree.append(Path(tag, stack[-1], box, up.inside or tag in ("article", "main"), left))
        stack.append(up.ways[way])
        open_tags[tag] += 1
        if tag in SCOPE:
            scopes.append(Counter())
        else:
            scopes[-1][tag] += 1

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not skipping:
            run.append(piece)
            if links:
                linked += len(piece.strip())

    while at < len(page):
        m = TOKEN.search(page, at)
        text(page[at:m.start() if m else len(page)])
        if not m:
            break
        at = m.end() if m.end() > m.start() else m.start() + 1
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1]:
            if skipping:
                if tag == skip_tag:
                    skipping -= 1
            elif tag == "a":
                links = 0
            elif tag in BLOCK and (open_tags[tag] if tag in SCOPE else scopes[-1][tag]):
                flush()
                while pop() != tag:
                    pass
            continue
        if skipping:
            if tag == skip_tag and tag not in RAW and tag not in VOID and not m[3].endswith("/"):
                skipping += 1
            if tag != "body":
                continue
            skipping = 0
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in SKIP:
            if tag not in VOID and not m[3].endswith("/"):
                skipping, skip_tag = 1, tag
            continue
        if tag == "br":
            text(" ")
        elif tag == "a":
            links = 1
        elif tag in BLOCK:
            flush()
            while len(stack) > 1 and tag in ENDS.get(tree[stack[-1]].tag, ()):
                pop()
            if tag not in VOID:
                push(tag, m[3])
    flush()
    return tree, found


def scores(tree: list[Path]) -> tuple[list[float], float]:
    """Every path's ratio smoothed, fused and weighed, and the page's mean of these, or BARE of it without names if more; means weigh by text."""
    ratio = [x.ratio() if x.left else 0.0 for x in tree]
    chars, mass = [x.chars if r else 0 for x, r in zip(tree, ratio)], [x.chars * r for x, r in zip(tree, ratio)]
    for i in range(len(tree) - 1, 0, -1):
        chars[tree[i].up] += chars[i]
        mass[tree[i].up] += mass[i]
    smooth: list[float] = []
    for i, x in enumerate(tree):
        if x.box != i:
            smooth.append(smooth[x.box])
            continue
        mean = mass[i] / chars[i] * math.sqrt(chars[i] / chars[0]) if chars[i] else 0.0
        smooth.append(NEAR * mean + (1 - NEAR) * smooth[tree[x.up].box] if i else mean)
    fused = [OWN * r + (1 - OWN) * smooth[i] if r else 0.0 for i, r in enumerate(ratio)]
    weighed = [x.left * f for x, f in zip(tree, fused)]
    if not chars[0]:
        return weighed, 0.0
    return weighed, max(sum(x.chars * w for x, w in zip(tree, weighed)), BARE * sum(x.chars * f for x, f in zip(tree, fused))) / chars[0]


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    """Blocks of the content paths joined by blank lines; empty if there are none."""
    tree, found = blocks(page or "")
    fused, mean = scores(tree)
    return "\n\n".join(t for i, t in found if fused[i] and fused[i] >= threshold * mean)


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text, n_chars (code points): one row per input row.

    Null and empty pages, and pages of furniture alone, have an empty text and 0.
    Broken markup is read to its end. Repeated rows give equal rows; other columns
    are not read; nothing is shuffled.
    """
    own_columns(key, ["text", "n_chars"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [main_text(p) for p in pdf["p"]]
        return pd.DataFrame({key: pdf[key], "url": pdf["u"], "text": found, "n_chars": [len(t) for t in found]})

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, F.col(url).alias("u"), F.col(page).alias("p")), f"`{key}` {kind}, url string, text string, n_chars long", run)
