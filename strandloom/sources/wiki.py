"""Wiki dumps and wiki mark-up: pages as plain text.

Dumps are XML files of many pages. Spark's text reader cuts them at the end of a page, wherever a split falls, so pages
are read side by side; a page's title, number and text come out by patterns. Mark-up nests, so a small scanner with a stack
takes it off, page by page in Arrow batches.

What goes with all it holds: templates and parameters (``{{ }}``, ``{{{ }}}``), tables (``{| |}``), comments, references,
maths, source code, galleries and the like, files, images, categories and links to other languages. What leaves its text: links
(what is behind the last bar, or the target), headings, lists, quotes, other tags. Behaviour switches go.

Edge cases. A null text is null; brackets that never close are text; those that close nothing too. Entities are decoded once
(twice in a dump, where XML has its own). Pages without a text have an empty one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags whose content isn't the page's text, and name spaces of links that aren't.
GONE = "ref math source syntaxhighlight gallery timeline imagemap score code pre chem ce graph mapframe templatedata".split()
SPACES = "file image media category template wikipedia wikt wiktionary portal help special user talk".split()

_GONE = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(GONE)})\b(?:[^<>/]|/(?!>))*(?:/>|>.*?</\1\s*>)", re.S | re.I)
_TOKEN = re.compile(r"(\{{2,})|(\{\|)|(\|?)(\}{2,})|(\|)(\})|(\[\[)|(\]\])")
#: Closing braces that a sign needs (a table's after a bar).
_NEEDS = {"{{": 2, "{{{": 3, "{|": 1}
_OUTSIDE = re.compile(r"\[(?:https?:)?//[^\s\[\]]+(?:\s+([^\[\]\n]*))?\]")
_BARE = re.compile(r"\bhttps?://\S+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_SWITCH = re.compile(r"__[A-Z]+__")
_LINE = re.compile(r"^[ \t]*(?:=+[ \t]*(.*?)[ \t]*=+[ \t]*$|[*#:;]+[ \t]*|-{4,})", re.M)
_LANGUAGE = re.compile(r"[a-z]{2,3}(?:-[a-z]+)*")


def _linked(inner: str) -> str:
    """What a link shows."""
    target, _, rest = inner.partition("|")
    space, colon, _ = target.lstrip(":").partition(":")
    if colon and not target.startswith(":") and (space.strip().lower() in SPACES or _LANGUAGE.fullmatch(space.strip())):
        return ""
    return rest.rpartition("|")[2] if rest else target.lstrip(":")


def plain_text(text: str | None) -> str | None:
    """The text of a page without its mark-up."""
    if text is None:
        return None
    text = _GONE.sub(" ", text)
    # What is open: its sign, and where its content begins in ``out``, which holds pieces of text.
    out: list[str] = []
    stack: list[tuple[str, int]] = []
    opened = dict.fromkeys((*_NEEDS, "[["), 0)
    at = 0

    def innermost(fits) -> int | None:
        """The place of the last open sign that fits; asked for only where one of its kind is open."""
        return next((k for k in range(len(stack) - 1, -1, -1) if fits(stack[k][0])), None)

    def close(place: int) -> None:
        for sign, _ in stack[place:]:
            opened[sign] -= 1
        begin = stack[place][1]
        inner = "".join(out[begin:])
        shown = _linked(inner) if stack[place][0] == "[[" else " "
        del out[begin - 1 :], stack[place:]
        out.append(shown)

    for found in _TOKEN.finditer(text):
        out.append(text[at : found.start()])
        at = found.end()
        braces, table, link, unlink = found[1], found[2], found[7], found[8]
        if braces:
            threes, rest = divmod(len(braces), 3)
            if rest == 1 and threes:  # 4 are two and two
                threes, rest = threes - 1, 4
            signs = ["{{"] * (rest // 2) + ["{{{"] * threes
        else:
            signs = [x for x in (table, link) if x]
        for sign in signs:
            out.append(sign)
            stack.append((sign, len(out)))
            opened[sign] += 1
        if signs:
            continue
        if unlink:
            place = innermost(lambda sign: sign == "[[") if opened["[["] else None
            if place is None:
                out.append(unlink)
            else:
                close(place)
            continue
        # Closing braces go to what is open, from the innermost on; a bar before them ends a table.
        bar, left = found[3] or found[5] or "", len(found[4] or found[6])
        while left:
            needs = {sign: n for sign, n in _NEEDS.items() if opened[sign] and n <= left and (sign != "{|" or bar)}
            place = innermost(lambda sign, needs=needs: sign in needs) if needs else None
            if place is None:
                out.append(bar + "}" * left)
                break
            left -= _NEEDS[stack[place][0]]
            bar = ""
            close(place)
    out.append(text[at:])
    plain = "".join(out)
    plain = _BARE.sub(" ", _OUTSIDE.sub(lambda m: m[1] or " ", plain))
    plain = _SWITCH.sub(" ", _TAG.sub(" ", plain))
    plain = _LINE.sub(lambda m: m[1] or "", re.sub(r"'{2,5}", "", plain))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t\xa0]+", " ", html.unescape(plain)).replace(" \n", "\n").replace("\n ", "\n")).strip()


def without_markup(text: Column) -> Column:
    """``plain_text`` of a column."""

    @F.pandas_udf("string")
    def plain(texts):
        return texts.map(plain_text, na_action="ignore")

    return plain(text)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """title, ns, page_id, redirect (a boolean) and text (with its mark-up) of every page of a dump's files."""
    pages = spark.read.text(path, lineSep="</page>").where(F.col("value").contains("<page"))
    body = F.regexp_extract("value", r"(?s)<page[^>]*>(.*)", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_page(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string()), strict=True)], names=["title", "ns", "page_id", "redirect", "text"])

    return pages.select(body.alias("value")).mapInArrow(run, "title string, ns int, page_id long, redirect boolean, text string")


def _page(body: str) -> tuple:
    def one(tag: str) -> str | None:
        found = re.search(rf"<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", body, re.S)
        return html.unescape(found[1]) if found else None

    number = lambda x: int(x) if x and re.fullmatch(r"\s*-?\d{1,18}\s*", x) else None
    return one("title"), number(one("ns")), number(one("id")), bool(re.search(r"<redirect\b", body)), one("text") or ""
