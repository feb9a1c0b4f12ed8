"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices

#: Where markup may begin; what follows is looked for once, from there on.
OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z-]+)")
#: HTML's white space; a no-break space counts too once references are decoded.
SPACE = re.compile(r"\s+")

# Element kinds of HTML.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea title select button audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
ASIDE = frozenset("nav header footer aside form menu dialog head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BODY = frozenset("article main".split())
ASIDE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class names and ids that mark what is not the article, wherever they stand in a name (ad-slot, site_nav).
ASIDE_WORD = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu menus masthead footer sidebar widget widgets breadcrumb breadcrumbs cookie cookies consent popup modal comment comments discussion replies respond disqus share sharing social related recommended recommendations newsletter subscribe signup login pagination pager toolbar".split())
#: These only as the last word of a name (site-notice, but not notice-period), and the second ones not inside an article.
LAST_WORD = frozenset("notice notices alert alerts banner".split())
OUTER_WORD = frozenset("header side search copyright legal".split())
#: First words by which an article element itself is a reader's comment or an advert; its other class names are often topics.
NO_ARTICLE = frozenset("comment comments reply ad ads advert advertisement sponsored".split())
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Lines a window sums, and the text length at which a window counts as dense.
WINDOW, DENSE = 3, 40


def is_aside(tag: str, names: str, inside: bool) -> bool:
    """Whether class names and ids mark an element as no part of the article; inside: within a marked article."""
    if tag in ("html", "body", "main"):
        return False
    for name in names.split():
        parts = [w.lower() for w in NAME_WORD.findall(name)]
        if not parts:
            continue
        if tag == "article":
            if parts[0] in NO_ARTICLE:
                return True
        elif not ASIDE_WORD.isdisjoint(parts) or parts[-1] in LAST_WORD or not inside and parts[-1] in OUTER_WORD:
            return True
    return False


class Scanner:
    """Ends of markup in a page, in time linear in its length however malformed: what was found once is kept."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.none: dict[str, int] = {}  # of what there is none from a place on
        self.stop = (0, -1)  # no stop character lies between the two
        self.closed: dict[int, int] = {}
        self.dead: set[int] = set()  # places behind a quoted value from which no tag ends

    def find(self, what: str, at: int) -> int:
        """Place of the next `what`; -1, without another search, behind a place that had none."""
        if at >= self.none.get(what, len(self.page)):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none[what] = at
        return found

    def next_stop(self, at: int) -> int:
        if not self.stop[0] <= at <= self.stop[1]:
            m = STOP.search(self.page, at)
            self.stop = at, m.start() if m else len(self.page)
        return self.stop[1]

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag, not within quotes; -1 if none does."""
        page, passed = self.page, []
        while at not in self.dead:
            stop = self.next_stop(at)
            if stop == len(page):
                break
            if page[stop] == ">":
                return stop
            if stop not in self.closed:
                self.closed[stop] = self.find(page[stop], stop + 1)
            if self.closed[stop] < 0:
                break
            at = self.closed[stop] + 1
            passed.append(at)
        self.dead.update(passed)
        return -1


def markup(page: str):
    """(start, end, CDATA text, slash, name, attributes) of each piece of markup, each looked for behind the one that `send` names; name is None but for tags."""
    scan, at = Scanner(page), 0
    while m := OPEN.search(page, at):
        start, at = m.start(), m.end()
        piece = None
        if m[1]:
            end = scan.find("-->", at)
            piece = start, len(page) if end < 0 else end + 3, "", "", None, ""
        elif m[5]:
            end = scan.tag_end(at)
            if end >= 0:
                piece = start, end + 1, "", m[4], m[5].lower(), page[at:end]
        else:
            end = scan.find("]]>", at) if m[2] else -1
            if end >= 0:
                piece = start, end + 3, page[at:end], "", None, ""
            elif (end := scan.find(">", start + 2)) >= 0:
                piece = start, end + 1, "", "", None, ""
        if piece is None:
            at = start + 1
        else:
            at = yield piece
            at = piece[1] if at is None else at


class Stack:
    """Open elements that may change the kind of text, with counts, so that no question walks the stack."""

    def __init__(self) -> None:
        self.items: list[tuple[str, str]] = []
        self.names: Counter = Counter()
        self.kinds: Counter = Counter()

    def push(self, name: str, kind: str) -> None:
        self.items.append((name, kind))
        self.names[name] += 1
        self.kinds[kind] += 1

    def pop(self) -> str:
        name, kind = self.items.pop()
        self.names[name] -= 1
        self.kinds[kind] -= 1
        return name

    def close(self, name: str) -> None:
        """Elements up to the innermost of a name, if one is open."""
        if self.names[name]:
            while self.pop() != name:
                pass

    def kind(self) -> str:
        return "aside" if self.kinds["aside"] else "body" if self.kinds["body"] else "open"


#: Elements that are no part of the stack unless their attributes say what they hold.
LIGHT = frozenset("p li b i a em strong td tr".split())


def lines_of(page: str) -> list[tuple[str, str, int]]:
    """(text, kind, length of its text that is not in links) of each line; kind: body, aside or open."""
    out: list[tuple[str, str, int]] = []
    stack = Stack()
    parts: list[str] = []
    linked = links = 0

    def end_line() -> None:
        nonlocal parts, linked
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append((text, stack.kind(), max(0, len(text) - linked)))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            linked += len(text) * (links > 0)

    pieces, at, back = markup(page), 0, None
    while True:
        try:
            start, end, cdata, slash, name, given = pieces.send(back)
        except StopIteration:
            break
        back = None
        add(page[at:start])
        at = end
        if cdata:
            parts.append(html.escape(cdata, False))
        if not name:
            continue
        if not slash and name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = back = close.end() if close else len(page)
            continue
        if name in BLOCK:
            end_line()
            if not slash and name != "br" and stack.items and stack.items[-1][0] == "p":
                stack.pop()  # a block ends a paragraph that was left open
        if name == "a":
            links = 0 if slash else 1
        if slash:
            stack.close(name)
            continue
        if name in VOID or name in LIGHT and not given:
            continue
        inside = stack.kinds["body"] > 0
        # An article's own heading is part of it.
        what = "aside" if name in ASIDE and not (name == "header" and inside) else "body" if name in BODY else ""
        if given:
            found = {(a[0] or a[4]).lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(given)}
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
            if hidden or found.get("role", "").lower() in ASIDE_ROLE or is_aside(name, found.get("class", "") + " " + found.get("id", ""), inside):
                what = "aside"
            elif found.get("role") == "main":
                what = "body"
        if name not in LIGHT or what:
            stack.push(name, what)
    add(page[at:])
    end_line()
    return out


def runs(weights: list[int], window: int = WINDOW, dense: int = DENSE) -> list[tuple[int, int]]:
    """Runs of lines from a surge to the next dive, without weightless lines at their ends.

    A line block is `window` lines from a line on. It surges where it sums to `dense` characters (or to the
    page's densest block, if that has fewer) and dives where it sums to none.
    """
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    limit, out, at = min(dense, max(sums, default=0)), [], 0
    while at < len(sums) and limit:
        if sums[at] < limit or not weights[at]:
            at += 1
            continue
        to = at
        while to < len(sums) and sums[to]:
            to += 1
        end = max(k for k in range(at, to) if weights[k]) + 1
        out.append((at, end))
        at = to
    return out


def main_text(page: str, window: int = WINDOW, dense: int = DENSE) -> str:
    """The lines between surges and dives of the page's line blocks.

    Lines of asides are taken out before, so they neither count nor interrupt. A line weighs its text outside
    links. Where the page marks an article, its lines weigh `dense` characters more, and others count only if
    they are long (twice `dense`). Inside a run every line stays, links too.
    """
    lines = [x for x in lines_of(page) if x[1] != "aside"]
    marked = any(k == "body" for _, k, _ in lines)
    weights = [n + dense if k == "body" else n if not marked or n >= 2 * dense else 0 for _, k, n in lines]
    return "\n".join(lines[k][0] for at, to in runs(weights, window, dense) for k in range(at, to))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    A null html counts as empty, and pages without main text have an empty text. Repeated rows give
    repeated rows; null ids and urls stay null; only page_id, url and html are read. A map without shuffle.
    """

    def run(batches):
        for b in slices(batches, 2):
            text = [main_text(h.as_py() or "") for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    src = bounded(pages).select("page_id", F.col("url").cast("string").alias("url"), "html")
    return src.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
