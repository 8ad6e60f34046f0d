"""Main text of web pages by tag-path ratios.

Each text node has a tag path, the names of the elements from the root to it. Over a page,
text length, punctuation and nodes are summed by tag path; a path's text ratio (length per
node) and punctuation ratio (marks per node) are smoothed over the nodes in page order and
fused by product, and the paths whose mean is above a share of the page's mean are content
paths. Their nodes are the page's content, and the content decides what stays:

- Menus, headers, footers, sidebars, forms and elements whose class, id or role is on a list
  go, except one that holds the article, or where there is none most of the page's content (an
  unclosed menu, a form or a wrapper around the page).
- If the articles (or main elements) left hold most of the content, they are the text, with
  all their short lines.
- Otherwise the text is gathered from the page's containers: one without content goes,
  unless it holds a heading; the others are looked into, and what stands beside content in
  the same container stays.

Scripts, styles and form controls always go. Headings, what holds an article's first heading,
and inline elements never go by their names.

Defined results: a null or empty page, or one without content, gives an empty text; a page
without markup is one block; unclosed and misnested tags are closed as their parents end, and
a tag that the page's end cuts off is no text; nothing else is cut, however long or deep;
equal rows and null ids are kept; an empty table gives an empty result; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

BEGIN = re.compile(r"<(?=[!?a-zA-Z]|/[a-zA-Z])")
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The end of a tag, or an attribute's value in quotes.
STEP = re.compile(r"=\s*+([\"'])|>")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
LONG_NUMBER = re.compile(r"&#0*+(?=[0-9])([0-9]{8,});?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style noscript template iframe object embed svg canvas audio video textarea title button select option datalist noembed noframes xmp input label".split())
ASIDE = frozenset("nav footer aside form dialog menu header fieldset".split())
#: Of these, those that don't stand around a page's content by mistake.
ENDS = frozenset("footer dialog menu".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ARTICLES = ("article", "main")
#: Elements that are looked into for content; what stands in others stays or goes as one.
CONTAINERS = frozenset("html body article main section div center td th tr tbody thead tfoot table header form nav footer aside menu dialog fieldset".split())
#: Names in a class, id or role that mark what isn't the article.
BOILERPLATE = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices popup promo promoted promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget alertdialog complementary contentinfo search".split())
#: Elements that end when one of the others begins beside them.
CLOSES = {x: y.split() for x, y in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
SCOPES = "ul ol dl table select article section div body main td th".split()
WALLS = "td th table article body".split()


def _names(attributes: str, split: str = r"\s+") -> bool:
    """Whether a class, id or role has a name on the list."""
    return any(not BOILERPLATE.isdisjoint(re.split(split, (m[2] or m[3] or m[4] or "").lower())) for m in ATTRIBUTE.finditer(attributes))


def _unescaped(s: str) -> str:
    try:
        return html.unescape(s)
    except ValueError:  # a number of thousands of digits is no character
        return html.unescape(LONG_NUMBER.sub("�", s))


class Page:
    """Elements by number, parents before children: parent, name, whether boilerplate, an
    article of a comment, or closed by a tag of its own; and text nodes (block, path, element,
    text). Read in one pass whose steps don't depend on the depth."""

    def __init__(self, page: str):
        self.parent, self.name, self.aside, self.comment, self.closed = [-1], [""], [False], [False], [False]
        self.nodes: list[tuple[int, int, int, str]] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.path = [0]  # of the open elements
        self.open = [0]
        self.at: dict[str, list[int]] = defaultdict(list)  # places of open elements by name
        self.hidden, self.block = 0, 0
        self._read(page)

    def _text(self, s: str) -> None:
        if s and not self.hidden:
            self.nodes.append((self.block, self.path[-1], self.open[-1], s))

    def _innermost(self, names) -> int:
        return max((self.at[x][-1] for x in names if self.at[x]), default=0)

    def _pop(self, k: int) -> None:
        while len(self.open) > k:
            name = self.name[self.open.pop()]
            self.path.pop()
            self.at[name].pop()
            self.block += name in BLOCK
            self.hidden -= name in HIDDEN

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self.block += 1
            p = self._innermost(("p",))
            if p > self._innermost([*SCOPES, "button", "li"]):
                self._pop(p)
        if name in CLOSES:
            k = self._innermost(CLOSES[name])
            if k > self._innermost([x for x in SCOPES if x not in ("td", "th")]):
                self._pop(k)
        if name == "br":
            self._text("\n")
        if name in VOID or attributes.endswith("/") and name not in BLOCK and name not in RAW:
            return
        number, article = len(self.parent), name in ARTICLES
        inside = any(self.at[x] for x in ARTICLES)
        listed = name in BLOCK and name not in HEADINGS and name not in ("html", "body") and _names(attributes, r"[^a-z]+" if article else r"\s+")
        self.parent.append(self.open[-1])
        self.name.append(name)
        self.closed.append(False)
        self.comment.append(article and listed)  # such articles aren't the page's
        self.aside.append(not article and (listed or name in ASIDE and not (name == "header" and inside)))
        self.at[name].append(len(self.open))
        self.open.append(number)
        self.path.append(self.paths.setdefault((self.path[-1], name), len(self.paths) + 1))
        self.hidden += name in HIDDEN

    def _end(self, name: str) -> None:
        k = self._innermost((name,))
        if not k:
            self.block += name == "p"
        elif name in BLOCK or k > self._innermost(WALLS):
            self.closed[self.open[k]] = True
            self._pop(k)

    def _read(self, page: str) -> None:
        at, ends, last = 0, {q: page.rfind(q) for q in ("'", '"', "-->", "]]>")}, page.rfind(">")
        while begin := BEGIN.search(page, at):
            start = begin.start()
            end = self._markup(page, start, ends, last)
            self._text(page[at:start])
            at = end
            name = NAME.match(page, start + 1)
            slash = page.startswith("</", start)
            if slash:
                name = NAME.match(page, start + 2)
            if name is None:
                if page.startswith("<![CDATA[", start) and ends["]]>"] >= start:
                    self._text(html.escape(page[start + 9 : end - 3], quote=False))
                continue
            if page[end - 1] != ">":  # cut off by the page's end
                continue
            if slash:
                self._end(name[0].lower())
                continue
            tag = name[0].lower()
            self._start(tag, page[name.end() : end - 1])
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                to = close.start() if close else len(page)
                self._text(page[at:to])
                end = page.find(">", to) if close else -1
                at = end + 1 if end >= 0 else len(page)
                self._pop(len(self.open) - 1)
        self._text(page[at:])

    @staticmethod
    def _markup(page: str, start: int, ends: dict[str, int], last: int) -> int:
        """Where the markup that starts here ends."""
        if page.startswith("<!--", start):
            return page.find("-->", start + 4) + 3 if ends["-->"] >= start + 4 else len(page)
        if page.startswith("<![CDATA[", start) and ends["]]>"] >= start:
            return page.find("]]>", start) + 3
        if page[start + 1] in "!?":
            return page.find(">", start) + 1 if last > start else len(page)
        at = (NAME.match(page, start + 1) or NAME.match(page, start + 2)).end()
        if last < at:
            return len(page)
        while m := STEP.search(page, at):
            quote = m[1]
            if not quote:
                return m.end()
            if ends[quote] < m.end():  # never closed: the tag ends at the next bracket
                return page.find(">", m.end()) + 1 if last >= m.end() else len(page)
            at = page.find(quote, m.end()) + 1
        return len(page)


def content_paths(nodes: list, smooth: tuple[float, ...] = (0.25, 0.5, 0.25), share: float = 0.7) -> set[int]:
    """The paths whose fused ratio, over their nodes, is at least `share` of the page's mean."""
    nodes = [n for n in nodes if n[3].strip()]
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, path, _, s in nodes:
        length[path] += len(s.strip())
        marks[path] += len(PUNCTUATION.findall(s))
        count[path] += 1
    text = [length[n[1]] / count[n[1]] for n in nodes]
    mark = [marks[n[1]] / count[n[1]] for n in nodes]
    half = len(smooth) // 2

    def smoothed(x: list[float]) -> list[float]:
        padded = [x[0]] * half + x + [x[-1]] * half if x else x
        return [sum(w * padded[i + d] for d, w in enumerate(smooth)) for i in range(len(x))]

    fused: dict[int, float] = defaultdict(float)
    for n, a, b in zip(nodes, smoothed(text), smoothed(mark), strict=True):
        fused[n[1]] += a * (1 + b)
    mean = sum(fused.values()) / max(1, len(nodes))
    return {path for path, total in fused.items() if total / count[path] >= share * mean}


def _visible(page: Page, removed: list[bool]) -> list[bool]:
    shown = [True] * len(removed)
    for k in range(1, len(removed)):
        shown[k] = shown[page.parent[k]] and not removed[k]
    return shown


def main_text(markup: str | None) -> str:
    page = Page(markup or "")
    size, n = [len(s.strip()) for _, _, _, s in page.nodes], len(page.parent)

    def summed(values) -> list[int]:
        """Over each element with all that is in it."""
        out = [0] * n
        for (_, _, k, _), v in zip(page.nodes, values, strict=True):
            out[k] += v
        for k in range(n - 1, 0, -1):
            out[page.parent[k]] += out[k]
        return out

    def weights(shown: list[bool]) -> list[int]:
        """The text of content paths, as the ratios of what is shown have it."""
        nodes = [x for x in page.nodes if shown[x[2]]]
        paths = content_paths(nodes)
        return [m if shown[x[2]] and x[1] in paths else 0 for x, m in zip(page.nodes, size, strict=True)]

    # comments are never the page's text; of the rest, boilerplate goes unless most of the
    # content is in it
    listed = [a or c for a, c in zip(page.aside, page.comment, strict=True)]
    own = weights(_visible(page, listed))
    every = weights([True] * n)
    content, inside = sum(own), summed(every)
    articles = {k for k in range(1, n) if page.name[k] in ARTICLES and not page.comment[k]}
    article_of = [False] * n
    for k in range(1, n):
        article_of[k] = k in articles or article_of[page.parent[k]] and not page.comment[k]
    within = summed([v if article_of[x[2]] else 0 for x, v in zip(page.nodes, every, strict=True)])
    outside = sum(v for x, v in zip(page.nodes, own, strict=True) if article_of[x[2]])
    meant = [name in ASIDE and name != "form" and (name in ENDS or closed) for name, closed in zip(page.name, page.closed, strict=True)]
    wrapper = lambda k: not outside and 2 * inside[k] > inside[0] and 10 * content < inside[k] and not meant[k]
    titled = [name == "h1" for name in page.name]  # an article's own header
    for k in range(n - 1, 0, -1):
        titled[page.parent[k]] = titled[page.parent[k]] or titled[k]
    kept = [a and (within[k] > outside or wrapper(k) or article_of[page.parent[k]] and titled[k] and not page.comment[k]) for k, a in enumerate(listed)]
    removed = [a and not stays for a, stays in zip(listed, kept, strict=True)]
    shown = _visible(page, removed)
    own = weights(shown)
    total = sum(own)
    if not total:
        return ""

    chosen = None
    for name in ARTICLES:
        named = [page.name[k] == name and k in articles and shown[k] for k in range(n)]
        below = named[:]
        for k in range(1, n):
            below[k] = below[k] or below[page.parent[k]]
        if 2 * sum(v for x, v in zip(page.nodes, own, strict=True) if below[x[2]]) > total:
            holds = summed(own)
            top = [False] * n  # whether in an element of the name that holds content
            for k in range(1, n):
                top[k] = top[page.parent[k]] or named[k] and holds[k] > 0
            chosen = [s and t for s, t in zip(shown, top, strict=True)]
            break
    if chosen is None:
        chosen = _gathered(page, shown, summed(own), own)
    blocks: dict[int, list[str]] = defaultdict(list)
    for block, _, k, s in page.nodes:
        if chosen[k]:
            blocks[block].append(s)
    lines = (" ".join(_unescaped("".join(blocks[b])).split()) for b in sorted(blocks))
    return "\n".join(x for x in lines if x)


def _gathered(page: Page, shown: list[bool], holds: list[int], own: list[int]) -> list[bool]:
    """Which elements' text stays on a page that no article tells: that of containers with
    content; beside content, of everything that isn't a container without."""
    n = len(page.parent)
    heading, direct = [False] * n, [False] * n
    for k in range(n - 1, 0, -1):
        heading[k] = heading[k] or page.name[k] in HEADINGS
        heading[page.parent[k]] = heading[page.parent[k]] or heading[k]
        # content that stands in a container itself or in what isn't one
        if holds[k] and page.name[k] not in CONTAINERS:
            direct[page.parent[k]] = True
    for (_, _, k, _), v in zip(page.nodes, own, strict=True):
        direct[k] = direct[k] or v > 0
    out = [False] * n
    out[0] = True
    for k in range(1, n):
        if not (shown[k] and out[page.parent[k]]):
            continue
        if page.name[k] in CONTAINERS:
            out[k] = holds[k] > 0 or heading[k]
        else:
            out[k] = holds[k] > 0 or heading[k] or direct[page.parent[k]] or page.name[page.parent[k]] not in CONTAINERS
    return out


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=SCHEMA)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
