"""Main text of web pages by line-block distribution.

Markup is stripped to one line for each block element. A line's length is the number of its characters outside links
(inside an article or main element: all). The lengths are summed over sliding windows of lines: text begins at the
surge, the first line of a window that holds text, and ends at the dive, after which a whole window is empty. What lies
between a surge and its dive is a region, and its peak is its largest window sum. A region is kept if its weighted peak
is at least `share` of the page's largest, or if it lies in the same container as a region kept for its peak (so a short
closing paragraph stays). Kept regions are returned whole.

Markup only weighs lines, it never decides alone:
* Elements whose purpose is not text (navigation, forms, scripts and the like) have no lines.
* Names of classes and ids made of nothing but words for boilerplate and layout (`ad`, `cookie-notice`, but not
  `share-price` or `search-results`) make a container suspect. It is a sequence of lines of its own and weighs FAINT.
* An article or main element is a sequence of its own. If its windows reach a quarter of those outside, the lines
  outside weigh FAINT; otherwise (teaser cards beside a long text) they weigh as much as those inside.
So a suspect container or a text outside the article still wins where its windows hold fifty times as much.

Defined results: a null or empty page, or one with no text of its own, has the empty text; character references are
decoded once; nothing is cut off; an element that hides its content and is never closed hides nothing, unless browsers
read its content as raw text; null ids and urls are kept; further columns, also clashing ones, are ignored; repeated
rows are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from platewise.llm.common import batch, slices

#: Elements that end the line before and after them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas video audio textarea select button head title map".split())
#: Elements read as raw text up to their end tag.
RAW = frozenset("script style textarea title iframe noscript".split())
#: Containers of boilerplate, and containers that can be it by their class, id or role.
ASIDE = frozenset("nav footer aside form dialog menu".split())
CONTAINERS = frozenset("div section ul ol dl table header p span article main figure details td center".split()) | ASIDE
MARKED = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id names that stand for boilerplate, and words for layout that may stand beside them.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsors sponsored promo promos promotion cookie cookies consent gdpr notice notices notification "
    "notifications alert alerts popup modal overlay nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidenav footer masthead topbar toolbar comment comments "
    "disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager widget widgets "
    "tags disclaimer copyright hidden siteheader pageheader".split()
)
LAYOUT = frozenset(
    "area article articles bar block body bottom box button buttons center col column container content desktop fixed form global group head header icon icons inner item items js "
    "left link links list main media mobile outer page panel post posts primary right row secondary section site slot sticky text title top unit user wrap wrapper zone".split()
)
HEADERS = frozenset("site-header page-header main-header global-header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu dialog alert".split())
#: Weight of what markup marks as unlikely.
FAINT = 0.02
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_ENDS = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in RAW}


def _suspect_name(value: str) -> bool:
    for token in value.split():
        words = [w.strip("0123456789").lower() for w in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", token)]
        words = [w for w in words if w]
        if token.lower() in HEADERS or any(w in NOISE for w in words) and all(w in NOISE or w in LAYOUT for w in words):
            return True
    return False


def _cues(element: str, attributes: str) -> tuple[bool, bool]:
    """(never text, suspect) by the attributes of an element."""
    never = suspect = False
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        never |= name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES
        suspect |= (name == "class" or name == "id" and element not in ("p", "span")) and _suspect_name(value)
    return never, suspect


class Line:
    """One line: its text and length, and the numbers of its suspect container, its article and its container (0: none)."""

    __slots__ = ("text", "size", "suspect", "mark", "box")

    def __init__(self, text: str, size: int, suspect: int, mark: int, box: int):
        self.text, self.size, self.suspect, self.mark, self.box = text, size, suspect, mark, box


def lines_of(page: str) -> list[Line]:
    """Lines of a page; lines outside articles that are never text are empty, those inside are left out."""
    out: list[Line] = []
    parts: list[str] = []
    linked = in_link = opened = 0
    stack: list[tuple[str, bool, int, int, int]] = []  # (element, never text, suspect, mark, box) from here on
    state = (False, 0, 0, 0)
    at, n = 0, len(page)
    endless: set[str] = set()  # hiding elements that are not closed any more

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                never, suspect, mark, box = state
                if not never:
                    out.append(Line(text, len(text) if mark else max(0, len(text) - linked), suspect, mark, mark or box))
                elif not mark:
                    out.append(Line("", 0, 0, 0, 0))
        linked = 0

    def top() -> tuple[bool, int, int, int]:
        return stack[-1][1:] if stack else (False, 0, 0, 0)

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * bool(in_link)
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in BLOCKS:
                flush()
            if name in CONTAINERS and any(x[0] == name for x in stack):
                flush()
                while stack.pop()[0] != name:
                    pass
                state = top()
                in_link = 0
            continue
        if name in HIDDEN and name != "head":
            if name == "title":
                flush()
            end = None if name in endless else (_ENDS.get(name) or re.compile(rf"</{name}\b[^>]*>", re.I)).search(page, at)
            if end:
                at = end.end()
                parts.append(" ")
            elif name in ("script", "style", "textarea", "title"):
                at = n
            else:
                endless.add(name)
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = 1
        elif name in BLOCKS:
            flush()
        if name in CONTAINERS and name not in ("p", "span"):
            flush()
        if name in CONTAINERS and not m[3].endswith("/"):
            opened += 1
            never, suspect = _cues(name, m[3])
            if name == "p":
                while stack and stack[-1][0] == "p":
                    stack.pop()
                state = top()
                if not never and not suspect:
                    continue
            outer = state
            never |= outer[0] or name in ASIDE or name == "header" and not outer[2]
            mark = outer[2] or (opened if name in MARKED and not never and not outer[1] else 0)
            suspect_in = outer[1] or (opened if suspect and name not in MARKED else 0)
            box = outer[3] if name in ("p", "span") else opened
            stack.append((name, never, suspect_in, mark, box))
            if name != "span" or never or suspect:
                if name == "span":
                    flush()
                state = stack[-1][1:]
    if at < n:
        parts.append(page[at:])
    flush()
    return out


def regions(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(surge, dive) of each stretch of text: dive is the line after the last one that holds text."""
    found: list[tuple[int, int]] = []
    total, start, last = sum(lengths[: window - 1]), None, 0
    for i in range(len(lengths)):
        ahead = i + window - 1
        total += lengths[ahead] if ahead < len(lengths) else 0
        if start is None:
            if lengths[i] > 0:
                start = i
        if start is not None:
            if lengths[i] > 0:
                last = i
            if total == 0:
                found.append((start, last + 1))
                start = None
        total -= lengths[i]
    if start is not None:
        found.append((start, last + 1))
    return found


def peak(lengths: list[int], window: int) -> int:
    """The largest sum of a window of lines."""
    return max((sum(lengths[i : i + window]) for i in range(max(1, len(lengths) - window + 1))), default=0) if lengths else 0


def extract(page: str | None, window: int = 3, share: float = 0.2) -> str:
    lines = lines_of(page or "")
    plain = [i for i, x in enumerate(lines) if not x.suspect and not x.mark]
    by: dict[tuple[int, int], list[int]] = {}
    for i, x in enumerate(lines):
        if x.suspect or x.mark:
            by.setdefault((x.suspect, x.mark if not x.suspect else 0), []).append(i)
    size = lambda own: [lines[i].size for i in own]
    best = max((peak(size(own), window) for (suspect, _), own in by.items() if not suspect), default=0)
    trusted = bool(best) and 4 * best >= peak(size(plain), window)
    sequences = [(FAINT if suspect else 1.0, own) for (suspect, _), own in by.items()] + [(FAINT if trusted else 1.0, plain)]
    found = []  # (weighted peak, lines)
    for weight, own in sequences:
        for a, b in regions(size(own), window):
            found.append((weight * peak(size(own[a:b]), window), own[a:b]))
    least = share * max((p for p, _ in found), default=0.0)
    boxes = {lines[i].box for p, own in found if p >= least for i in own if lines[i].box and not lines[i].suspect}
    kept = sorted(i for p, own in found if p >= least or boxes & {lines[i].box for i in own if not lines[i].suspect} for i in own)
    return "\n\n".join(lines[i].text for i in kept if lines[i].text)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_pages(pages: DataFrame, window: int = 3) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""

    def run(batches):
        for b in slices(batches):
            texts = [extract(x.as_py(), window) for x in b.column(2)]
            yield batch(_SCHEMA, (b.column(0), b.column(1), texts, [len(t) for t in texts]))

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
