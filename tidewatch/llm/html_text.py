"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import map_batches

#: Elements that end a line, elements that never hold main text, and names that mark such parts.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_DROPPED = frozenset("aside audio button canvas dialog footer form head header iframe input label menu nav noscript object select svg template textarea title video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAMES = frozenset("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer header masthead menu nav navbar navigation newsletter notice notices notification popup promo promoted related respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_MAIN = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXTS = _HEADINGS | frozenset("blockquote dd dl dt li ol p pre td th tr ul".split())
#: Text of dense blocks inside article or main counts so many times against that outside.
MARKED = 2

# A tag ends at its >, or is text if another < comes first outside quotes: no search runs past the next tag.
_REST = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_RAW = re.compile(rf"<(script|style)\b{_REST}>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<![^<>]*>|<\?[^<>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)({_REST})>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Line(NamedTuple):
    text: str
    linked: int  # characters in links
    main: bool  # inside the main element
    heading: bool


def _noise(tag: str, attributes: str) -> int:
    """3 for an element that never holds main text, 2 for one whose class, id or role names such a part, 1 for one whose class or id has a compound
    name with a word of such parts, else 0."""
    if tag in _DROPPED:
        return 3
    if tag in ("body", "html", "article", "main") or not attributes:
        return 0
    found = 0
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", a or b or c).lower()
        if name.lower() == "role" and _ROLES.intersection(value.split()):
            return 2
        if name.lower() in ("class", "id"):
            for token in value.split():
                words = [w for w in re.split(r"[^a-z]+", token) if w]
                if len(words) == 1 and words[0] in _NAMES:
                    return 2
                if _NAMES.intersection(words):
                    found = 1
    return found


def _lines(page: str, least: int = 1) -> list[Line]:
    """The lines without noise (as of _noise, ``least`` and above); a part of noise is an empty line, and so is what parts texts:
    one between paragraphs, two at most where larger blocks end or begin, however many. A compound name doesn't make noise of what holds most of the page's text, and of a header inside
    the main element headings stay."""
    source = _RAW.sub(" ", page)
    tags = list(_TAG.finditer(source))
    before = [0]  # characters of text before each tag, and in all
    for k, m in enumerate(tags):
        before.append(before[-1] + len(source[tags[k - 1].end() if k else 0 : m.start()].strip()))
    before.append(before[-1] + len(source[tags[-1].end() if tags else 0 :].strip()))
    before = before[1:]
    close: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for k, m in enumerate(tags):
        tag = (m[2] or "").lower()
        if not tag or tag in _VOID:
            continue
        if m[1]:
            if opened.get(tag):
                close[opened[tag].pop()] = k
        elif not (m[3] or "").rstrip().endswith("/"):
            opened.setdefault(tag, []).append(k)
    lines: list[Line] = []
    parts: list[str] = []
    linked = depth = main = at = k = level = 0
    bare = -1  # the end of a header inside the main element

    def end(empty: int = 1) -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if k <= bare and not level:
            text = ""
        if text or any(line.text for line in lines[-1:]):
            lines.append(Line(text, linked, main > 0, level > 0))
        if empty > 1 and any(line.text for line in lines[-empty:]):
            lines.append(Line("", 0, main > 0, False))
        parts.clear()
        linked = 0

    while k <= len(tags):
        m = tags[k] if k < len(tags) else None
        text = source[at : m.start() if m else len(source)]
        if text:
            parts.append(text)
            if depth and not text.isspace():
                linked += len(text.strip())
        if m is None:
            break
        at, tag = m.end(), (m[2] or "").lower()
        kind = _noise(tag, m[3] or "") if tag and not m[1] and (k in close or tag in _VOID) else 0
        if kind == 1 and 2 * (before[close.get(k, k)] - before[k]) > before[-1]:
            kind = 0
        if kind == 3 and tag == "header" and main:
            end()
            bare = max(bare, close.get(k, k))
        elif kind >= least:
            end()
            k = close.get(k, k)
            at = tags[k].end()
            lines.append(Line("", 0, main > 0, False))
        elif tag == "br":
            parts.append(" ")
        elif tag in _BLOCKS:
            end(1 if tag in _TEXTS else 2)
            if tag in _HEADINGS and (m[1] or k in close):
                level = 0 if m[1] else 1
            if tag in _MAIN and (m[1] or k in close):
                main = max(0, main + (-1 if m[1] else 1))
        elif tag == "a":
            depth = 0 if m[1] else 1
        k += 1
    end()
    return lines


def main_text(page: str, window: int = 3, surge: int = 80) -> str:
    """See extract_main_text."""
    lines = _lines(page)
    if max(_sums(lines, window)[1], default=0) < surge:  # the names have left nothing dense: do they wrap the page?
        bare = _lines(page, 3)
        held, sums = _sums(bare, window)
        if max(sums, default=0) >= surge and 2 * sum(_sums(lines, window)[0]) < sum(held) or not any(line.text for line in lines):
            lines = bare
    return _dense_text(lines, window, surge)


def _sums(lines: list[Line], window: int) -> tuple[list[int], list[int]]:
    """What each line weighs, and the sum over it and the next ones of its window."""
    weights = [0 if 2 * line.linked > len(line.text) else len(line.text) for line in lines]
    return weights, [sum(weights[i : i + window]) for i in range(len(weights))]


def _dense_text(lines: list[Line], window: int, surge: int) -> str:
    weights, sums = _sums(lines, window)
    blocks, start = [], None
    for i in range(len(lines)):
        if start is None and weights[i] and sums[i] >= surge:  # surge: a dense block begins here
            start = i
        if start is not None and not sums[i]:  # dive: nothing but empty lines ahead
            blocks.append((start, i))
            start = None
    if start is not None:
        blocks.append((start, len(lines)))
    dense, floor = [], 0
    for start, end in blocks:
        i = j = start  # back to a heading that no dive parts from the block, and over the marked element's lines
        while j > floor and sums[j - 1]:
            j -= 1
            if weights[j] and (lines[j].heading or lines[i].main and lines[j].main):
                i = j
        dense += range(i, end)
        floor = end
    if not dense:  # a page too short for any surge
        dense = [i for i, w in enumerate(weights) if w]
    inside = sum(weights[i] for i in dense if lines[i].main)
    marked = MARKED * inside >= sum(weights[i] for i in dense) - inside  # else the marked elements are teasers beside the body
    return "\n\n".join(lines[i].text for i in dense if lines[i].text and (weights[i] or lines[i].main) and (lines[i].main == marked or not inside))


def _extract(at: int, window: int, surge: int):
    def run(batches):
        for batch in batches:
            out = [main_text(x.as_py() or "", window, surge) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, surge: int = 80) -> DataFrame:
    """(id, url, text, n_chars): the main text of each whole page.

    Markup is stripped into lines, one for each block element; scripts, styles, comments
    in the source, and menus, headers, footers, sidebars, notices, adverts, forms and reader
    comments (by element, role, or a word of class or id) leave an empty line, and so do the ends of blocks, two at most for any
    nesting. A line weighs its text length on every page; lines that are mostly links weigh nothing. Where names (not elements) leave nothing
    that surges and hold most of the text, they wrap the page, and don't count. Where the sum over the next
    ``window`` lines first reaches ``surge`` a dense block begins, where it falls to zero it ends. A block reaches back to
    a heading that no such dive parts from it. An article
    or main element adds three bounded things: a block that begins inside reaches back over lines that no
    dive parts from it, and keeps lines of links between others; headings in its header stay; and where the dense lines inside hold at
    least a third of the dense text, those outside go (else the elements are teasers, and those inside go). The
    lines left, decoded, with white space turned into single spaces, are joined by two newlines.
    On a page that never surges all weighing lines count as dense. A noise element that never ends is ignored.

    Null or empty html, and pages without text, give an empty text. Repeated rows give a row each;
    null ids and urls stay; other columns are ignored. An empty table gives no rows.
    """
    rows = pages.select(id_col, url_col, html_col)
    kinds = [f.dataType.simpleString() for f in rows.schema][:2]
    out = map_batches(rows, _extract(2, window, surge), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
