"""Operator 6. HTML extraction by line-block distribution: text between the surges and dives of windowed line lengths."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, record

WINDOW = 3  # lines whose text lengths are summed
SURGE = 86  # signs in a window, from which on content begins
GAP = 2  # empty lines at which it ends

#: Of these nothing is seen. A head is not among them: what it holds is, so that it needs no end.
_ELEMENTS = "script style noscript template svg title textarea iframe select".split()
_HIDDEN = re.compile(rf"<!--|<({'|'.join(_ELEMENTS)})(?=[\s/>])", re.I)
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in _ELEMENTS}
#: Without their ends these hide all that follows, as in browsers; the others end where a block begins.
_RAW = ("script", "style")
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|caption|center|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|option|p|pre|section|summary|table|tbody|td|tfoot|th|thead|tr|ul)(?:[\s/][^<>]*)?>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
_BLANK = re.compile(r"[ \t\r\f\v ]+")


def visible(page: str) -> str:
    """The page without comments and hidden elements. Comments, scripts and styles that aren't closed hide all that follows; other
    elements then end at the next block tag, or hide their own tag only if there is none."""
    out, at, open_ = [], 0, set()
    while m := _HIDDEN.search(page, at):
        out.append(page[at : m.start()])
        tag = m[1].lower() if m[1] else "!"
        end = -1
        if tag not in open_:  # it was not looked for in vain before
            if tag == "!":
                end = page.find("-->", m.end())
                end = end + 3 if end >= 0 else -1
            else:
                close = _CLOSE[tag].search(page, m.end())
                end = close.end() if close else -1
            if end < 0:
                open_.add(tag)
        if end < 0 and (tag == "!" or tag in _RAW):
            return "".join(out)
        if end < 0:
            block = None if "block" in open_ else _BREAK.search(page, m.end())
            if not block:
                open_.add("block")
            end = block.start() if block else m.end()
        at = end
    return "".join([*out, page[at:]])


def lines_of(page: str) -> list[str]:
    """Text lines: block-level tags break lines, other tags go, character references are read, blanks run together."""
    text = _TAG.sub("", _BREAK.sub("\n", visible(page)))
    return [_BLANK.sub(" ", x).strip() for x in html.unescape(text).split("\n")]


def regions(lengths: np.ndarray, window: int = WINDOW, surge: int = SURGE, gap: int = GAP) -> list[tuple[int, int]]:
    """Runs of lines, from each surge (a window over the bound) to the next dive (the first of gap empty lines)."""
    n = len(lengths)
    sums = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(n)
    up = np.flatnonzero((sums[np.minimum(at + window, n)] - sums[at] > surge) & (lengths > 0))
    down = np.flatnonzero(sums[np.minimum(at + gap, n)] - sums[at] == 0)
    out, end = [], 0
    for i in up.tolist():
        if i >= end:
            k = int(np.searchsorted(down, i))
            end = int(down[k]) if k < len(down) else n
            out.append((i, end))
    return out


def extract(page: str) -> tuple[str, int]:
    """The content of a page, a line for each text line, and the number of its regions."""
    lines = lines_of(page)
    found = regions(np.array([len(x) - x.count(" ") for x in lines], np.int64))
    return "\n".join(x for a, b in found for x in lines[a:b] if x), len(found)


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, regions) of every page, in place of its row.

    Content runs from a line at which the next WINDOW lines hold more than SURGE signs (blanks not counted) to GAP empty
    lines. A page that never surges has the empty text and no regions.

    A null page has a null text; an empty one the empty text. Null ids and urls stay. Repeated rows are extracted each. An
    empty table gives no rows; other columns are not read.
    """

    def run(batches):
        for batch in pieces(batches, "html"):
            found = [(None, 0) if x is None else extract(x) for x in batch.column("html").to_pylist()]
            yield record("page_id url text n_chars regions", batch.column("page_id"), batch.column("url"), pa.array([x for x, _ in found], pa.string()), pa.array([None if x is None else len(x) for x, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int32()))

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, regions int")
