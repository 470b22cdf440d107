"""XML that is read although it breaks the rules: forbidden characters, white space before the declaration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

#: Characters that XML 1.0 does not allow in a document.
FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


class TreeError(ValueError):
    """The text is not a well-formed document."""


def clean_xml(text: str) -> str:
    """Without forbidden characters, and without white space and byte order marks in front."""
    return FORBIDDEN.sub("", text).lstrip("\ufeff \t\r\n\x85\xa0\u2028\u3000")


def walk(text: str, with_text: bool = False) -> Iterator[tuple]:
    """(tag, attributes) where an element starts and (None, None) where it ends; with_text also ("", text) between."""
    out: list[tuple] = []
    p = expat.ParserCreate(namespace_separator="}")
    p.buffer_text = True
    p.ordered_attributes = False
    p.StartElementHandler = lambda tag, attrs: out.append((tag, attrs))
    p.EndElementHandler = lambda tag: out.append((None, None))
    if with_text:
        p.CharacterDataHandler = lambda data: out.append(("", data))
    try:
        p.Parse(text, True)
    except (expat.ExpatError, UnicodeError) as e:
        raise TreeError(str(e)) from None
    return iter(out)
