"""Answers in light markup as HTML: headings, lists, quotes, tables, paragraphs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperloom.functions.text import INLINE

HEAD = re.compile(r"(#{1,6})\s+(.*)")
ITEM = re.compile(r"(?:[-*]|(\d+)\.)\s+(.*)")
RULE = re.compile(r"\|?[\s:|-]+\|[\s:|-]*")


_INLINE = [(re.compile(rx, re.A), re.sub(r"\$(\d)", r"\\g<\1>", to)) for rx, to in INLINE]


def inline(line: str) -> str:
    """:func:`paperloom.functions.text.inline_markup` of one line."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        line = line.replace(a, b)
    for rx, to in _INLINE:
        line = rx.sub(to, line)
    return line


def cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def blocks(text: str | None) -> str | None:
    """The text's blocks in order; lines of one kind that follow each other are one block. Null stays null."""
    if text is None:
        return None
    out: list[str] = []
    held: list[str] = []
    kind = ""

    def close() -> None:
        if not held:
            return
        if kind == "table":
            rows = [cells(x) for x in held if not RULE.fullmatch(x)]
            headed = len(held) > 1 and RULE.fullmatch(held[1])
            body = ["<tr>" + "".join(f"<{t}>{inline(c)}</{t}>" for c in r) + "</tr>" for i, r in enumerate(rows) for t in ("th" if headed and not i else "td",)]
            out.append(f"<table>{''.join(body)}</table>")
        elif kind in ("ul", "ol"):
            out.append(f"<{kind}>{''.join(f'<li>{inline(x)}</li>' for x in held)}</{kind}>")
        else:
            tag = "blockquote" if kind == "quote" else "p"
            out.append(f"<{tag}>{'<br>'.join(map(inline, held))}</{tag}>")
        held.clear()

    for raw in text.split("\n"):
        x = raw.strip()
        head, item = HEAD.fullmatch(x), ITEM.fullmatch(x)
        if not x or head:
            close()
            if head:
                out.append(f"<h{len(head[1])}>{inline(head[2])}</h{len(head[1])}>")
            continue
        now, part = ("ol" if item[1] else "ul", item[2]) if item else ("quote", x[1:].strip()) if x.startswith(">") else ("table", x) if x.count("|") > 1 else ("p", x)
        if now != kind:
            close()
        kind = now
        held.append(part)
    close()
    return "".join(out)


@F.pandas_udf(StringType())
def render(s: pd.Series) -> pd.Series:
    """:func:`blocks` of a column."""
    return s.map(blocks)
