"""HTML extraction by line-block distribution.

Markup is stripped into lines, one for each block; the lengths of text (link text
aside) are summed over sliding windows of lines; the text between a surge point,
where the sums rise, and the dive point, where they have fallen, is the main text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import narrow, steps
from weftline.runtime import table

#: Lines in a window; a window's sum that makes a surge; sums at or under which it dives.
WINDOW, SURGE, DIVE = 3, 40, 0

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is raw text up to their own end tag, or the page's end, never shown.
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"))
#: Elements that hold other markup and nothing of the text, up to their own end tag; where
#: there is none before an end that no such element spans, the tag alone is passed over.
SKIPPED = frozenset(("noscript", "template", "svg", "math", "object", "select"))
BEYOND = re.compile(r"</?(?:article|main|body)(?=[\s/>])|\Z", re.I)
#: Elements that are not part of an article.
ASIDE = frozenset("nav header footer aside form button menu dialog fieldset head datalist label input option video audio canvas map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that mark menus, notices, adverts, comments and the like.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist comentarios kommentare commentaires"
    " consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup"
    " promo promoted promotion promotions related replies reply respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe"
    " subscription toolbar widget widgets".split()
)
#: Words that may stand beside these in one name without changing what it says.
NEUTRAL = frozenset(
    "a area bar block body bottom box button buttons card center col column container content desktop form global group icon icons id inner item items js"
    " left line link links list main mobile module outer page panel post posts primary right row secondary section site slot small sticky text title top"
    " unit wrap wrapper".split()
)
CONTAINERS = frozenset(("article", "main"))
BLOCKS = frozenset(
    "address article blockquote body br center dd details dir div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html hgroup legend li main ol p pre"
    " section summary table caption tbody td tfoot th thead tr ul nav header footer aside form fieldset menu dialog".split()
)
#: Elements that group blocks; with their classes they tell what kind of place a line is in.
GROUPS = frozenset("article body center details div main section table td".split())
CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end at their sibling when their end tag is left out.
CLOSES_P = BLOCKS - frozenset(("br", "body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"))
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose end tag is not left out across, by what is left out.
FENCES = frozenset("ul ol dl table tbody thead tfoot select div article section".split())
P_FENCES = frozenset("table td th caption button".split())
SPACES = re.compile(r"\s+")


END = {name: re.compile(rf"</{name}(?=[\s/>]|$)[^>]*(?:>|$)", re.I) for name in RAW | SKIPPED}


@dataclass
class Line:
    """One block's text, how much of it is link text, whether it lies in an element
    that is no part of an article, the innermost article or main around it and the
    innermost group (name and class), as numbers of the page's trees."""

    text: str
    linked: int
    aside: bool
    container: int
    group: int


class Tree:
    """Elements inside elements, the root being 0 and each numbered after the one around it."""

    def __init__(self) -> None:
        self.parents, self.names, self.depths = [0], [""], [0]
        self.known: dict[tuple[int, str], int] = {}

    def add(self, parent: int, name: str) -> int:
        self.parents.append(parent)
        self.names.append(name)
        self.depths.append(self.depths[parent] + 1)
        return len(self.parents) - 1

    def same(self, parent: int, name: str) -> int:
        """The element of that name in the parent, one for all."""
        if (parent, name) not in self.known:
            self.known[parent, name] = self.add(parent, name)
        return self.known[parent, name]

    def within(self, tops: set[int]) -> list[bool]:
        """For each element whether it is one of these or inside one."""
        found = [0 in tops]
        for i in range(1, len(self.parents)):
            found.append(i in tops or found[self.parents[i]])
        return found

    def sums(self, weights: dict[int, int]) -> list[int]:
        """For each element the weight of itself and all inside it."""
        total = [weights.get(i, 0) for i in range(len(self.parents))]
        for i in range(len(total) - 1, 0, -1):
            total[self.parents[i]] += total[i]
        return total


@dataclass
class Page:
    lines: list[Line]
    containers: Tree
    groups: Tree


def is_aside(name: str, rest: str) -> bool:
    if name in ASIDE:
        return True
    if name in ("html", "body", "article", "main") or "=" not in rest:
        return "hidden" in rest and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", rest) is not None
    for key, *values in ATTRIBUTE.findall(rest):
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key in ("class", "id") and any(map(is_mark, value.split())):
            return True
        if key == "role" and value.strip() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def is_mark(name: str) -> bool:
    """Whether a class or id names a mark and, beside it, nothing that has a meaning."""
    parts = {x for x in re.split(r"[^a-z]+", name) if x}
    return not parts.isdisjoint(MARKS) and parts <= MARKS | NEUTRAL


def lines_of(page: str) -> Page:
    """The page's blocks in order. Elements that are not closed end with the element
    around them; a cut-off tag or comment at the end is dropped. Time is linear in the
    page: where an open element stands is known by its name."""
    lines: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []
    linked = links = asides = 0
    containers, groups = Tree(), Tree()
    inside, around = [0], [0]
    where: dict[str, list[int]] = {}
    fences, p_fences = [-1], [-1]
    ahead: dict[str, re.Match | None] = {}

    def next_of(pattern: re.Pattern, at: int) -> re.Match | None:
        """The next match from `at` on, remembered until it is passed."""
        found = ahead.get(pattern.pattern, pattern)
        if found is pattern or found is not None and found.start() < at:
            found = ahead[pattern.pattern] = pattern.search(page, at)
        return found

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", "".join(parts)).strip()
            if text:
                lines.append(Line(text, linked, asides > 0, inside[-1], around[-1]))
            parts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal links, asides
        while len(stack) > depth:
            name, aside, container, group = stack.pop()
            where[name].pop()
            if name in FENCES:
                fences.pop()
            if name in P_FENCES:
                p_fences.pop()
            links -= name == "a"
            asides -= aside
            if container:
                inside.pop()
            if group:
                around.pop()

    def say(raw: str) -> None:
        nonlocal linked
        text = entities.unescape(raw)
        parts.append(text)
        if links:
            linked += len(text.strip())

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        if m["cdata"] is not None:
            say(m["cdata"])
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            if name in BLOCKS:
                end_line()
            if where.get(name):
                close(where[name][-1])
            continue
        if name in BLOCKS:
            end_line()
        if name in RAW:
            over = next_of(END[name], at)
            at = over.end() if over else end
            continue
        if name in SKIPPED:
            over, beyond = next_of(END[name], at), next_of(BEYOND, at)
            if over and over.start() <= beyond.start():
                at = over.end()
            continue
        if name in VOID or m["rest"].endswith("/") and name not in BLOCKS:
            continue
        if name in CLOSES_P and where.get("p") and where["p"][-1] > p_fences[-1]:
            close(where["p"][-1])
        if name in IMPLIED:
            nearest = max((where[x][-1] for x in IMPLIED[name] if where.get(x)), default=-1)
            if nearest > fences[-1]:
                close(nearest)
        aside = is_aside(name, m["rest"])
        if aside:
            end_line()
        if container := name in CONTAINERS and not asides:
            inside.append(containers.add(inside[-1], name))
        if group := name in GROUPS:
            said = CLASS.search(m["rest"])
            around.append(groups.same(around[-1], f"{name} {' '.join(sorted((said[1] or said[2] or said[3] or '').split()))}" if said else name))
        where.setdefault(name, []).append(len(stack))
        if name in FENCES:
            fences.append(len(stack))
        if name in P_FENCES:
            p_fences.append(len(stack))
        stack.append((name, aside, container, group))
        links += name == "a"
        asides += aside
    end_line()
    return Page(lines, containers, groups)


def stretches(weight: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) from each surge to its dive. A surge is the first line with a weight
    whose window's sum is over SURGE; its dive is where the sums have fallen to DIVE."""
    n = len(weight)
    padded = np.concatenate([weight, np.zeros(WINDOW - 1, np.int64)])
    sums = np.convolve(padded, np.ones(WINDOW, np.int64), "full")[WINDOW - 1 : WINDOW - 1 + n]
    found, i = [], 0
    while i < n:
        if sums[i] <= SURGE or not weight[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j] > DIVE:
            j += 1
        found.append((i, j))
        i = j + 1
    return found


def summed(numbers: list[int], weight: np.ndarray) -> dict[int, int]:
    found: dict[int, int] = {}
    for x, w in zip(numbers, weight.tolist()):
        found[x] = found.get(x, 0) + w
    return found


def home(groups: Tree, weights: dict[int, int]) -> int:
    """The innermost group that holds more than half of the weight."""
    total = groups.sums(weights)
    return max((i for i, w in enumerate(total) if 2 * w > total[0]), key=lambda i: groups.depths[i])


def main_lines(page: Page) -> list[Line]:
    """The lines between surge and dive.

    Lines aside are taken out first, so that they part nothing. A line weighs its text
    without link text. Of several stretches from surge to dive the one with most text
    is certain. Where most of it lies in articles or main elements, surge and dive move
    to the ends of the innermost one that holds all of its lines in such elements, or
    of each outermost one that it spans, so that short first and last lines, which no
    window tells from a menu, belong to them. Otherwise lines without text of their own
    (links, say) may have parted the text: it goes from the first to the last stretch
    with a line in the same kind of place as most of the certain one, and what lies
    between in such a place, however short, belongs to it; so do headings in the
    window of a surge, and short lines right before it in an element of the same kind.
    Without any surge, the articles and main elements alone decide:
    the one with most text."""
    lines = [x for x in page.lines if not x.aside]
    weight = np.array([max(0, len(x.text) - x.linked) for x in lines], np.int64)
    if not weight.any():
        return []
    found = stretches(weight)
    if not found:
        marks = summed([x.container for x in lines], weight)
        top = max((c for c in marks if c), key=lambda c: (marks[c], -c), default=None)
        inside = page.containers.within({top})
        return [x for x in lines if inside[x.container]]
    start, end = max(found, key=lambda s: (int(weight[s[0] : s[1]].sum()), -s[0]))
    held = summed([x.container for x in lines[start:end]], weight[start:end])
    if 2 * held.get(0, 0) < int(weight[start:end].sum()):
        total = page.containers.sums({c: w for c, w in held.items() if c})
        common = [c for c, w in enumerate(total) if c and w == total[0]]
        outermost = {c for c, w in enumerate(total) if w and page.containers.depths[c] == 1}
        inside = page.containers.within({max(common, key=lambda c: page.containers.depths[c])} if common else outermost)
        return [x for x in lines if inside[x.container]]
    at = home(page.groups, summed([x.group for x in lines[start:end]], weight[start:end]))
    inside = page.groups.within({at})
    own = [inside[x.group] for x in lines]
    parts = [(i, j) for i, j in found if any(own[k] and weight[k] for k in range(i, j))]
    first, last = min(start, parts[0][0]), max(end, parts[-1][1])
    while at and page.groups.names[at] != "body" and first and own[first - 1] and weight[first - 1]:
        first -= 1  # a heading or two that no window of the surge reaches
    for i, j in [(start, end), *parts]:
        own[i:j] = [True] * (j - i)
    return [x for x, kept in zip(lines[first:last], own[first:last]) if kept and x.linked * 2 <= len(x.text)]


def main_text(page: str | None) -> str:
    return "\n\n".join(x.text for x in main_lines(lines_of(page or "")))


def extract(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text): the main text of every page, its blocks joined by two line breaks.

    The whole page is read, however long; white space inside a block becomes one
    space. A null or empty page, or one without a main text, gives an empty string.
    Rows come out as they went in, repeated ones too, null keys kept; other columns
    are left out. No shuffle; pages are read in bounded steps."""
    rows = narrow(df, key=key, html=html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([main_text(p) for p in batch.column("html").to_pylist()], pa.string())], ["key", "text"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. The url rides along in the key."""
    pages = table(spark, sf_dir, "pages").select(F.struct("page_id", "url").alias("page"), "html")
    found = extract(pages, key="page")
    return found.select("page.page_id", "page.url", "text", F.char_length("text").cast("long").alias("n_chars"))
