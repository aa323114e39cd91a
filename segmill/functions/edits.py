"""Putting new texts back: into a line behind its prefix, into a tree at a path of child numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .slices import sliced


def reassembled(line: Column, text: Column, prefix: str) -> Column:
    """The line's prefix, the new text and the line's trailing white space."""
    return F.concat(F.regexp_extract(line, prefix, 1), text, F.regexp_extract(line, r"(\s*)$", 1))


def escaped(text: Column) -> Column:
    """Plain text as it stands in a tree."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


#: A piece of markup that is no text: comments and declarations, CDATA (a text to a tree, but one that is not edited), tags.
MARK = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|<(?P<end>/?)[A-Za-z_:][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^>\"'])*?(?P<empty>/?)>", re.S)


def _tree(xhtml: str) -> list:
    """The child nodes of the root element: a list for an element, (start, end) for a text, None for a comment."""
    top: list = []
    stack, at = [top], 0
    for m in MARK.finditer(xhtml):
        if m.start() > at:
            stack[-1].append((at, m.start()))
        at = m.end()
        if m["end"] is None:
            stack[-1].append(None)
        elif m["end"]:
            if len(stack) > 1:
                stack.pop()
        else:
            stack[-1].append([])
            if not m["empty"]:
                stack.append(stack[-1][-1])
    if at < len(xhtml):
        stack[-1].append((at, len(xhtml)))
    return next((node for node in top if isinstance(node, list)), [])


@sliced(StructType([StructField("xhtml", StringType()), StructField("applied", IntegerType())]))
def edited(xhtml: str | None, edits: list[dict] | None) -> tuple[str | None, int]:
    """Texts at paths of child numbers replaced by others, given as markup; a path that doesn't end at a text changes nothing. With the number applied.

    Only tags are parsed: what isn't replaced stays as it was, entities that are unknown or cut short too. A null text makes the whole null.
    """
    root, found = _tree(xhtml or ""), []
    for e in edits or []:
        node = root
        for k in e["path"]:
            node = node[k] if isinstance(node, list) and 0 <= k < len(node) else None
        if isinstance(node, tuple):
            found.append((node, e["text"]))
    if xhtml is None or any(text is None for _, text in found):
        return None, len(found)
    out, at = [], 0
    for (start, end), text in sorted(dict(found).items()):
        out += [xhtml[at:start], text]
        at = end
    return "".join([*out, xhtml[at:]]), len(found)
