"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element, and each line weighs its characters outside links. The weights
of ``WINDOW`` lines from each line on are summed. Where the sum surges to a threshold a block of text begins, where it
dives to zero (so many lines running that hold no text of their own) the block ends, and the lines between are kept.

What a browser knows of a page comes first: scripts, styles, forms, menus, page headers and footers, asides, notices,
adverts and reader comments, told by element, role, class or id, leave blank lines. Where the page marks its
article (article, main, role=main, articleBody, or else a container named for content) the lines are those of that
element, and the threshold is any text; elsewhere the threshold is a share of the highest sum.
An article inside an article is a reader's comment, as the standard has it. Marks that would hide the page's only
article, such as a form around the whole page, are void.

Rows are independent: one pass in Arrow batches cut to ``CHUNK_BYTES``, no shuffle; a task holds a few times the text
of one such cut, or of one page where that is longer. Nothing is kept per page beyond it.

Defined results: a null or empty page, and one without any main text, gives an empty text of 0 characters. Broken
markup is read as browsers do: unclosed paragraphs and items end at the next, stray end tags are skipped, an unended
tag, comment or script runs to the end of the page, a lone < is text. Equal rows give equal results, one each; null
ids and urls pass; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cellgrid.llm.common import chunks
from cellgrid.session import ship_package

#: lines of a window; so many lines without text of their own end a block
WINDOW = 3
#: a block begins at this sum, or at half of the highest sum of the page where that is less
SURGE = 80

# Elements of the HTML standard by kind, then words that name parts of pages in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
HEAD = frozenset("base link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | {"p", "blockquote", "pre", "figcaption", "dd"}
DROPPED = frozenset("aside audio button canvas dialog fieldset footer form head menu nav object optgroup option select svg video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
MARKS = frozenset(
    "ad ads adsense advert advertisement advertisements advertising adverts alert alerts aside banner breadcrumb breadcrumbs comment "
    "commentlist comments consent cookie cookiebar cookies copyright disclaimer discussion disqus feedback footer footnav gdpr hidden "
    "login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo "
    "promotion rail recommendations recommended related replies reply respond responses search share sharing sidebar sidenav signin "
    "signup skip social sponsor sponsored submenu subscribe subscription teaser toolbar topbar widget widgets".split())
HEADER = frozenset({"header", "pageheader", "siteheader"})
DENIED = frozenset("free has no not with without".split())
CONTENT = frozenset(
    "article articlebody articlecontent articletext bodycontent bodytext content contentbody contentmain entry entrybody entrycontent "
    "entrytext main mainarticle maincontent maintext pagecontent post postbody postcontent posttext singlecontent story storybody "
    "storycontent".split())
#: elements that an opening tag of the same kind ends, up to the element that holds them
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "option": ({"option"}, {"select"})}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</(?![A-Za-z])[^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|\Z)""", re.S | re.X)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

#: kinds of marks: what the element says, what its name says, a header (of the page or of an article)
_BY_TAG, _BY_NAME, _HEADER = 1, 2, 3


def _named(names: str) -> tuple[int, bool]:
    """(mark, content) of the names in a class or id."""
    mark, content = 0, False
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        whole = "".join(words)
        content |= whole in CONTENT
        if whole in HEADER or words and words[-1] == "header":
            mark = mark or _HEADER
        for k, word in enumerate([*words, whole]):
            if word in MARKS and not DENIED & {*words[:k], *words[k + 1:k + 2]}:
                mark = _BY_NAME
    return mark, content


class Page:
    """Elements and lines of a page. A line is a list of (element, text, in link)."""

    def __init__(self, source: str):
        self.parent, self.name, self.mark, self.hint = [-1], ["#page"], [0], [0]
        self.lines: list[list[tuple[int, str, bool]]] = []
        self.holder: list[int] = []
        self._stack, self._open, self._line, self._link = [0], Counter(), [], 0
        self._read(source)

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            found = _TOKEN.search(source, at)
            if found is None:
                self._text(source[at:])
                break
            if found.start() > at:
                self._text(source[at:found.start()])
            at = found.end()
            name = found["name"]
            if name is None:
                continue
            name = name.lower()
            if found["end"]:
                self._close(name)
            elif name in RAW:
                self._edge(name)
                end = _RAW_END[name].search(source, at)
                at = end.start() if end else n
            else:
                self._begin(name, found["attrs"])
        self._flush()

    def _text(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        if not text.isspace():
            self._leave_head("#text")
        self._line.append((self._stack[-1], text, self._link > 0))

    def _leave_head(self, name: str) -> None:
        if self.name[self._stack[-1]] == "head" and name not in HEAD:
            self._pop(len(self._stack) - 1)

    def _flush(self) -> None:
        if any(not t.isspace() for _, t, _ in self._line):
            self.lines.append(self._line)
            self.holder.append(next(e for e in reversed(self._stack) if self.name[e] not in INLINE))
        self._line = []

    def _edge(self, name: str) -> None:
        if name not in INLINE:
            self._flush()

    def _pop(self, depth: int) -> None:
        """Ends the elements from ``depth`` of the stack on."""
        if any(self.name[e] not in INLINE for e in self._stack[depth:]):
            self._flush()
        for e in self._stack[depth:]:
            self._open[self.name[e]] -= 1
        del self._stack[depth:]
        if self._link >= depth:
            self._link = 0

    def _begin(self, name: str, attrs: str) -> None:
        if name == "br":
            self._line.append((self._stack[-1], " ", False))
            return
        self._leave_head(name)
        if name not in INLINE:
            self._flush()
            if self._open["p"] and name not in VOID:
                self._end_above({"p"}, {"table", "td", "th", "button", "object"})
        if name in SIBLINGS:
            self._end_above(*SIBLINGS[name])
        if name in VOID:
            return
        if name == "a" and self._link:
            self._close("a")
        e = len(self.name)
        self.parent.append(self._stack[-1])
        self.name.append(name)
        mark, hint = _BY_TAG if name in DROPPED else _HEADER if name == "header" else 0, 2 if name in ("article", "main") else 0
        if attrs and not attrs.isspace() and name not in ("html", "body"):
            mark, hint = self._described(name, attrs, mark, hint)
        self.mark.append(mark)
        self.hint.append(hint)
        self._stack.append(e)
        self._open[name] += 1
        if name == "a":
            self._link = len(self._stack) - 1

    def _described(self, name: str, attrs: str, mark: int, hint: int) -> tuple[int, int]:
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), html.unescape(a or b or c)
            if key in ("class", "id"):
                said, content = _named(value)
                if name != "main":
                    mark = mark or said
                hint = hint or int(content)
            elif key == "role":
                mark = mark or (_BY_TAG if value.strip().lower() in ROLES else 0)
                hint = 2 if value.strip().lower() in ("main", "article") else hint
            elif key == "itemprop" and value.strip().lower() == "articlebody":
                hint = 2
            elif key == "hidden" or key == "style" and _UNSEEN.search(value):
                mark = _BY_TAG
        return mark, hint

    def _end_above(self, names: set[str], holders: set[str]) -> None:
        """Ends the topmost open element of ``names`` unless one of ``holders`` stands between."""
        if not any(self._open[x] for x in names):
            return
        last = None
        for depth in range(len(self._stack) - 1, 0, -1):
            name = self.name[self._stack[depth]]
            if name in holders:
                break
            if name in names:
                last = depth
                if len(names) == 1:
                    break
        if last is not None:
            self._pop(last)

    def _close(self, name: str) -> None:
        self._edge(name)
        if not self._open[name]:
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            here = self.name[self._stack[depth]]
            if here == name:
                self._pop(depth)
                return
            if name in INLINE and here not in INLINE or here in ("td", "th") and name not in ("tr", "tbody", "thead", "tfoot", "table"):
                return


def _weights(page: Page, seen: list[bool]) -> list[int]:
    """Characters of each line outside links, 0 where links are most of it; in paragraphs and headings links count too."""
    out = []
    for line, holder in zip(page.lines, page.holder):
        own = linked = 0
        for e, text, link in line:
            if seen[e]:
                size = len("".join(text.split()))
                own, linked = own + size * (not link), linked + size * link
        out.append(own + linked if page.name[holder] in PROSE else own if 2 * own >= linked else 0)
    return out


def _inside(page: Page, roots: set[int]) -> list[bool]:
    """Whether each element is one of ``roots`` or below one; elements come after their parents."""
    out = [False] * len(page.name)
    for e in range(len(out)):
        out[e] = e in roots or e > 0 and out[page.parent[e]]
    return out


def _totals(page: Page, weights: list[int]) -> list[int]:
    """Weight of the lines below each element."""
    out = [0] * len(page.name)
    for holder, w in zip(page.holder, weights):
        out[holder] += w
    for e in range(len(out) - 1, 0, -1):
        out[page.parent[e]] += out[e]
    return out


def _hidden(page: Page) -> set[int]:
    """Marked elements whose marks hold."""
    hidden = {e for e, mark in enumerate(page.mark) if mark}
    covered = _inside(page, hidden)
    marks_out = lambda e: page.hint[e] == 2 or page.name[e] == "h1"
    if any(page.hint[e] == 2 and not covered[e] for e in range(len(covered))):
        return hidden
    total = _totals(page, _weights(page, [True] * len(covered)))
    if not any(page.hint[e] == 2 for e in range(len(covered))) and any(page.name[e] == "h1" and not covered[e] for e in range(len(covered))):
        return hidden
    # no article in sight: marks around one that hold most of the page's text are void
    void = set()
    for e in range(len(covered)):
        if marks_out(e) and covered[e]:
            up = e
            while up > 0:
                plain = page.hint[e] == 2 or page.mark[up] != _BY_TAG or page.name[up] == "form"
                if up in hidden and plain and 2 * total[up] > total[0]:
                    void.add(up)
                up = page.parent[up]
    return hidden - void


def _scope(page: Page, seen: list[bool], total: list[int]) -> tuple[set[int], bool]:
    """Elements whose lines are looked at, and whether the page itself named them."""
    marked = [e for e, hint in enumerate(page.hint) if hint == 2 and seen[e]]
    if marked:
        below = _inside(page, set(marked))
        outer = [e for e in marked if not below[page.parent[e]]]
        best = max(total[e] for e in outer)
        outer = [e for e in outer if 3 * total[e] >= best]
        return set(outer), True
    named = [e for e, hint in enumerate(page.hint) if hint == 1 and seen[e] and page.name[e] not in INLINE and total[e]]
    if named:
        return {max(named, key=lambda e: (total[e], -e))}, True
    return {0}, False


def _narrowed(page: Page, top: int, seen: list[bool], total: list[int], lines_in: list[int]) -> int:
    """The innermost element below ``top`` that still holds nine tenths of its text, in two lines or more."""
    at = top
    for e in range(top + 1, len(page.name)):
        if page.parent[e] == at and seen[e] and page.name[e] not in INLINE and 10 * total[e] >= 9 * total[at] > 0 and lines_in[e] > 1:
            at = e
    return at


def _blocks(weights: list[int], threshold: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the runs of lines from a surge of the window sum to its dive."""
    n = len(weights)
    sums = [sum(weights[i:i + WINDOW]) for i in range(n)]
    i = 0
    while i < n:
        if weights[i] and sums[i] >= threshold:
            first = i
            while i < n and sums[i]:
                i += 1
            yield first, i
        i += 1


def main_text(source: str | None) -> str:
    """The main text of one page, white space inside a block as one space, blocks joined by one space."""
    if not source:
        return ""
    page = Page(source)
    if not page.lines:
        return ""
    hidden = _hidden(page)
    article = _inside(page, {e for e, hint in enumerate(page.hint) if hint == 2 and page.name[e] == "article" and e not in hidden})
    # an article inside an article is a comment; of a header inside an article the headings stay
    hidden |= {e for e, name in enumerate(page.name) if name == "article" and e and article[page.parent[e]]}
    covered = _inside(page, hidden)
    seen = [not c for c in covered]
    named = _inside(page, {e for e, hint in enumerate(page.hint) if hint and e not in hidden})
    for e, name in enumerate(page.name):
        if name in HEADINGS and covered[e]:
            up, kept = e, False
            while up > 0 and (covered[up] or kept):
                if up in hidden:
                    kept = page.mark[up] == _HEADER and named[page.parent[up]]
                    if not kept:
                        break
                up = page.parent[up]
            if kept:
                for below, inside in enumerate(_inside(page, {e})):
                    seen[below] |= inside
    weights = _weights(page, seen)
    total = _totals(page, weights)
    tops, told = _scope(page, seen, total)
    if not told:
        lines_in = _totals(page, [int(w > 0) for w in weights])
        tops = {_narrowed(page, 0, seen, total, lines_in)}
    scope = _inside(page, tops)
    inside = [scope[h] for h in page.holder]
    weights = [w if here else 0 for w, here in zip(weights, inside)]
    highest = max(sum(weights[i:i + WINDOW]) for i in range(len(weights)))
    out: list[str] = []
    for first, end in _blocks(weights, 1 if told else max(1, min(SURGE, highest // 2))):
        for k in range(first, end):
            if inside[k]:
                out += "".join(t for e, t, _ in page.lines[k] if seen[e]).split()
    return " ".join(out)


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "_html"):
        texts = [main_text(x) for x in batch.column("_html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["_id", "_url", "_out", "_n"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Per page: its id, url, main text (``text``) and the text's code points (``n_chars``)."""
    ship_package(pages.sparkSession)
    rows = pages.select(pages[page_id].alias("_id"), pages[url].alias("_url"), pages[source].alias("_html"))
    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(_extractor, f"_id {kinds['_id']}, _url {kinds['_url']}, _out string, _n long")
    return out.toDF(page_id, url, "text", "n_chars")
