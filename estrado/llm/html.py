"""HTML extraction: text-to-tag ratios.

The standard library's streaming parser gives events; a line is what stands between two block
tags. Each line has a ratio, its characters outside links over its tags; the ratios of a page are smoothed by a
Gaussian and split into two clusters at a threshold (one-dimensional two-means). The lines of the upper cluster are marked, and
they decide:

- the region: the innermost element that holds nine tenths of the marked text, narrowed to an article or main element
  with half of it. All of its lines stay, short ones, headings and lists of sources too;
- where the region is the whole page, its first and last line: from the heading before the first marked line, with the byline between, to the last marked line and the sentences that close it;
- which lines of the region are menus: runs of unmarked lines that are links and nothing else, unless a heading or a colon announces them;
- whether an element that its name or kind would drop is the page's wrapper instead.

What stands in menus, headers, footers, sidebars, forms, scripts and styles is no line of the article, nor what a class or id
calls an advert, a notice, a sidebar or reader comments. A name counts if all of its parts say so: comments-area, but not comment-letter or social-policy.

An element is a number and its parent's number, lines hold the innermost one; weights are summed from the children up, so time and memory grow with the page, not with its depth.
Pages are read one by one: rows that repeat give their text each, and of lines that tie at the threshold none is marked.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, with_defaults

#: Fixed lists of element and attribute names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split()
)
DROPPED = frozenset("head script style noscript template nav aside footer iframe object svg math select textarea button dialog menu canvas audio video".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog toolbar".split())
#: Parts of a class or id, between hyphens and underscores, that name what is no article, and parts that may stand beside them.
DROPPED_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner menu menus nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead comment comments commentlist disqus replies respond cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login share sharing social related recommended pagination pager toolbar".split()
)
BESIDE = frozenset(
    "area articles bar block bottom box btn button buttons container content count form global google icons inner item items js left links list main mobile module msg outer overlay panel posts primary right secondary section site slot stories text thread top unit widget wrap wrapper zone".split()
)
IN_HEAD = frozenset("title meta link style script base noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = ("article", "main")
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
SIGMA, RADIUS = 1.0, 2
#: Links in a row that may be a menu.
MENU = 3
#: How a line that closes a text ends, and how one that only names its owner begins.
CLOSING, OWNER = tuple(".!?…»”\"')"), ("©", "(c)", "copyright")


def _named(a: dict[str, str]) -> bool:
    for name in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
        parts = set(re.split(r"[-_]+", name)) - {""}
        if parts & DROPPED_PARTS and parts <= DROPPED_PARTS | BESIDE:
            return True
    return False


class _Line(NamedTuple):
    text: str
    tags: int
    link: int
    element: int
    dropped: bool
    heading: int


class _Lines(HTMLParser):
    """Lines of a page: text, tags, link characters, the innermost element, whether tags drop it, and the level of its heading."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # open elements: tag, number, dropped (1 as lines of its own, 2 within a line)
        self.stack: list[tuple[str, int, int]] = []
        self.places: dict[str, list[int]] = {}  # where each tag is open, by height in the stack
        self.blocks: list[int] = []  # heights of open blocks
        # by element; the page is 0
        self.kind, self.parent, self.doubtful, self.core, self.level = [""], [0], [False], [False], [0]
        self.lines: list[_Line] = []
        self.articles = 0
        self.text: list[str] = []
        self.tags = self.link = 0

    def _open(self, tag: str) -> list[int]:
        return self.places.get(tag, [])

    def _break(self) -> None:
        t = " ".join("".join(self.text).split())
        if t:
            n = self.stack[-1][1] if self.stack else 0
            self.lines.append(_Line(t, max(1, self.tags), self.link, n, bool(self.stack) and self.stack[-1][2] > 0, self.level[n]))
        self.text, self.tags, self.link = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD and self._open("head"):  # the end tag of head may be left out
            self._break()
            self._close(self._open("head")[-1])
        if tag in BLOCK:
            self._break()
            # end tags that may be left out
            for i in range(len(self.stack) - 1, max(-1, len(self.stack) - 12), -1):
                name = self.stack[i][0]
                if tag in CLOSED_BY.get(name, ()):
                    self._close(i)
                    break
                if name in ("div", "article", "section", "main", "table", "ul", "ol", "td", "body"):
                    break
        elif tag in ("td", "th", "br"):
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        a = {k: v or "" for k, v in attrs}
        above = self.stack[-1][2] if self.stack else 0
        inside = tag in ("header", "article") and any(self._open(t) for t in REGIONS)
        out = above > 0 or tag in DROPPED or a.get("role", "").lower() in DROPPED_ROLES or "hidden" in a or a.get("aria-hidden") == "true"
        out = out or (tag == "header" and not inside) or "display:none" in a.get("style", "").replace(" ", "").lower()
        doubt = not out and (tag == "form" or (tag not in ("html", "body", "main") and (tag != "article" or inside) and _named(a)))
        if doubt and tag not in BLOCK:
            out, doubt = True, False
        up = self.stack[-1][1] if self.stack else 0
        self.kind.append(tag)
        self.parent.append(up)
        self.doubtful.append(doubt)
        self.core.append(not out and (tag in ("h1", "main") or (tag == "article" and not self.articles)))
        self.level.append(int(tag[1]) if tag in HEADINGS else self.level[up])
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, len(self.kind) - 1, above or (0 if not out else 1 if tag in BLOCK else 2)))
        self.articles += tag == "article"

    def _close(self, i: int) -> None:
        while len(self.stack) > i:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        at = self._open(tag)
        if tag in BLOCK:
            self._break()
            if at:
                self._close(at[-1])
        # an inline end tag never closes a block
        elif at and (not self.blocks or at[-1] > self.blocks[-1]):
            self._close(at[-1])

    def handle_data(self, data):
        if self.stack and self.stack[-1][2] == 2:
            return
        self.text.append(data)
        if self._open("a"):
            self.link += len(data)

    def close(self):
        super().close()
        self._break()


def _smooth(x: np.ndarray) -> np.ndarray:
    k = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA**2))
    pad = np.pad(x, RADIUS)
    return np.convolve(pad, k / k.sum(), "valid")


def _threshold(x: np.ndarray) -> float:
    """Between two clusters."""
    a, b = 0.0, float(x.max())
    for _ in range(20):
        t = (a + b) / 2
        up, low = x[x > t], x[x <= t]
        na, nb = (float(low.mean()) if len(low) else 0.0), (float(up.mean()) if len(up) else b)
        if (na, nb) == (a, b):
            break
        a, b = na, nb
    return (a + b) / 2


def _marked(lines: list[_Line], live: np.ndarray) -> np.ndarray:
    """Lines of the upper cluster. Lines that are not live keep their place in the smoothing, with a ratio of zero."""
    ratio = np.array([max(0, len(x.text) - x.link) / x.tags if on else 0.0 for x, on in zip(lines, live)])
    smooth = _smooth(ratio)
    marked = (smooth > _threshold(smooth)) & live
    return marked if marked.any() else live


def _up(parent: list[int], value: list[int]) -> list[int]:
    """Each element's value with those of all elements in it: children have larger numbers than their parents."""
    out = list(value)
    for n in range(len(out) - 1, 0, -1):
        out[parent[n]] += out[n]
    return out


def _down(parent: list[int], flag: list[bool]) -> list[bool]:
    """Whether each element or one around it has the flag."""
    out = list(flag)
    for n in range(1, len(out)):
        out[n] = out[n] or out[parent[n]]
    return out


def _weights(p: _Lines, marked: np.ndarray) -> list[int]:
    """Marked characters by element; 0 is the page."""
    own = [0] * len(p.kind)
    for x, m in zip(p.lines, marked):
        if m:
            own[x.element] += len(x.text)
    return _up(p.parent, own)


def _without_names(p: _Lines, live: np.ndarray) -> np.ndarray:
    """Live lines outside the elements that a name or a form drops: those that neither wrap the page nor hold nearly all that is marked."""
    if not any(p.doubtful):
        return live
    around = _up(p.parent, p.core)
    doubtful = [d and around[n] <= p.core[n] for n, d in enumerate(p.doubtful)]
    weight = _weights(p, _marked(p.lines, live))

    def rest():
        out = _down(p.parent, doubtful)
        return np.array([on and not out[x.element] for x, on in zip(p.lines, live)], bool)

    clean = rest()
    if 4 * sum(len(x.text) for x, on in zip(p.lines, clean) if on) < weight[0]:
        region = _down(p.parent, [k in REGIONS for k in p.kind])
        if not any(on and region[x.element] for x, on in zip(p.lines, clean)):
            doubtful = [d and 2 * weight[n] < weight[0] for n, d in enumerate(doubtful)]
            clean = rest()
    return clean


def _widened(p: _Lines, live: np.ndarray, marked: np.ndarray, root: int) -> int:
    """root, or the widest element around it that adds marked lines and headings and nothing else."""
    own = [[0] * len(p.kind), [0] * len(p.kind)]
    for x, on, m in zip(p.lines, live, marked):
        if on and (m or not x.heading):
            own[0 if m else 1][x.element] += 1
    good, other = (_up(p.parent, v) for v in own)
    n = best = root
    while n:
        n = p.parent[n]
        if other[n] > other[root]:
            break
        best = n if good[n] > good[best] else best
    return best


def _ends(lines: list[_Line], inside: list[int], marked: np.ndarray) -> list[int]:
    """The lines of a page without a container: from its heading to its closing sentence, around the marked ones."""
    links = lambda i: 2 * lines[i].link > len(lines[i].text)
    sentence = lambda i: not links(i) and lines[i].text.endswith(CLOSING) and not lines[i].text.lower().startswith(OWNER)
    hit = [k for k, i in enumerate(inside) if marked[i]]
    a, z = hit[0], hit[-1]
    # back over what is no link to the nearest heading, and over headings that stand before it
    k = a
    while k and not lines[inside[k]].heading and not links(inside[k - 1]):
        k -= 1
    if lines[inside[k]].heading:
        while k and lines[inside[k - 1]].heading:
            k -= 1
        a = k
    else:
        while a and sentence(inside[a - 1]):
            a -= 1
    while z + 1 < len(inside) and sentence(inside[z + 1]):
        z += 1
    return inside[a : z + 1]


def _title(lines: list[_Line], live: np.ndarray, marked: np.ndarray, inside: list[int]) -> list[int]:
    """The page's heading before a region that does not begin with one, with the lines between that are no links; else nothing."""
    if lines[inside[0]].heading:
        return []
    out = []
    for i in range(inside[0] - 1, -1, -1):
        if not live[i]:
            continue
        if marked[i] or 2 * lines[i].link > len(lines[i].text):
            return []
        out.append(i)
        if lines[i].heading == 1:
            return out[::-1]
    return []


def _menus(lines: list[_Line], inside: list[int], marked: np.ndarray) -> list[int]:
    """inside without runs of MENU lines or more that are unmarked and all links, where neither a heading nor a colon announces them."""
    keep, run = [], []
    for i in [*inside, -1]:
        if i >= 0 and not marked[i] and lines[i].link >= len(lines[i].text) and not lines[i].heading:
            run.append(i)
            continue
        told = keep and (lines[keep[-1]].heading or lines[keep[-1]].text.endswith(":"))
        if len(run) < MENU or told:
            keep.extend(run)
        keep.append(i)
        run.clear()
    return keep[:-1]


def extract(html: str | None) -> str:
    """The main text of a page: its blocks in order, one to a line. Null, empty and broken pages give what there is, or ""."""
    if not html:
        return ""
    p = _Lines()
    p.feed(html)
    p.close()
    lines, kind = p.lines, p.kind
    live = np.array([not x.dropped for x in lines], bool)
    if live.any():
        live = _without_names(p, live)
    if not live.any():
        return ""
    marked = _marked(lines, live)
    weight = _weights(p, marked)
    named = [n for n in range(len(kind)) if kind[n] in REGIONS and weight[n] and 2 * weight[n] >= weight[0]]
    if named:
        root = max(named, key=lambda n: (kind[n] == "article", weight[n], -n))
    else:
        # the innermost element that holds nearly all of the marked text
        root = max((n for n in range(len(kind)) if 10 * weight[n] >= 9 * weight[0] and kind[n] not in ("p", "b", "span", "li")), default=0)
        root = _widened(p, live, marked, root)
    within = _down(p.parent, [n == root for n in range(len(kind))])
    inside = [i for i, x in enumerate(lines) if live[i] and within[x.element]]
    if kind[root] in ("", "html", "body"):
        inside = _ends(lines, inside, marked)
    else:
        inside = _title(lines, live, marked, inside) + inside
    return "\n".join(lines[i].text for i in _menus(lines, inside, marked))


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text and n_chars (code points) in place of html; all other columns stay. Columns of these names are replaced."""
    keep = [f for f in pages.schema.fields if f.name not in ("text", "n_chars", html)]

    def run(batches):
        for b in batches:
            text = [extract(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "text string", "n_chars long"])
    return small_batches(pages).select(*[f"`{f.name}`" for f in keep], F.col(html)).mapInArrow(run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    return extract_pages(with_defaults(table(spark, sf_dir, "pages"), "page_id", "url", "html"))
