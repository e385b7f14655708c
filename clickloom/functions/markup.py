"""Visible text of HTML by a tokeniser that goes over each text once.

Where ``text.strip_tags`` replaces patterns natively, this follows the states of the
HTML tokeniser: comments (closed, closed at once, or open to the end), processing
instructions and declarations, tags whose quoted attributes hold ``>``, tags that the
text ends in, elements of raw text (scripts, styles, templates: no text of theirs is
visible) and of plain text (titles, text areas: no markup in them), and character
references of all names, longest first, with or without their semicolon.

It runs in Arrow batches, a text at a time; memory follows the longest text.
"""

from __future__ import annotations

import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, functions as F

# Elements whose content isn't shown, and those whose content holds no markup.
HIDDEN = ("script", "style", "template")
PLAIN = ("textarea", "title")

_TAG = re.compile(
    r"""<(?:
    !--(?:-?>|.*?(?:--!?>|\Z))                      # a comment
    |/>                                             # an end tag of no element
    |(?:[!?]|/(?![a-zA-Z]|\Z))[^>]*+(?:>|\Z)        # a declaration, an instruction, an odd end tag
    |(?P<end>/)?+(?P<name>[a-zA-Z][^\s/>]*+)
     (?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)*+
     (?:>|\Z))""",
    re.VERBOSE | re.DOTALL,
)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in (*HIDDEN, *PLAIN)}
_REFERENCE = re.compile(r"&(?:\#[xX](?P<hex>[0-9a-fA-F]++);?|\#(?P<number>[0-9]++);?|(?P<name>[a-zA-Z][a-zA-Z0-9]*+);?)")
#: Names that count without a semicolon, and the longest of them.
_BARE = {name: value for name, value in html5.items() if not name.endswith(";")}
_LONGEST = max(map(len, _BARE))


def _character(number: int) -> str:
    """The character of a numeric reference; what stands for none becomes the replacement sign, 128 to 159 are read as Windows-1252."""
    if 128 <= number < 160:
        return bytes([number]).decode("cp1252", errors="ignore") or chr(number)
    return chr(number) if 0 < number < 0x110000 and not 0xD800 <= number < 0xE000 else "�"


def _resolved(m: re.Match) -> str:
    if m["hex"] or m["number"]:
        digits = m["hex"] or m["number"]
        return _character(int(digits, 16 if m["hex"] else 10) if len(digits) < 12 else 0x110000)
    whole = m[0][1:]
    if whole in html5:
        return html5[whole]
    for n in range(min(len(m["name"]), _LONGEST), 1, -1):
        if whole[:n] in _BARE:
            return _BARE[whole[:n]] + whole[n:]
    return m[0]


def _resolved_if_whole(m: re.Match) -> str:
    cut = not m[0].endswith(";") and (m.end() == len(m.string) or m.string[m.end()] == "<")
    return m[0] if cut else _resolved(m)


def decode_references(text: str, cut_stay: bool = False) -> str:
    """The text with all character references resolved; others stay as they are.

    HTML resolves those without a semicolon wherever they stand. ``cut_stay`` leaves them
    where the text ends or markup begins right after: where texts were cut to a length
    after they were escaped, such a reference is the rest of one.
    """
    return _REFERENCE.sub(_resolved_if_whole if cut_stay else _resolved, text) if "&" in text else text


def shown_texts(html: str, cut_stay: bool = False) -> list[str]:
    """The visible texts between tags, references resolved, trimmed, without empty ones."""
    out, at = [], 0

    def add(begin: int, end: int) -> None:
        piece = decode_references(html[begin:end], cut_stay).strip()
        if piece:
            out.append(piece)

    while m := _TAG.search(html, at):
        add(at, m.start())
        at = m.end()
        name = (m["name"] or "").lower()
        if name in _ENDS and not m["end"]:
            close = _ENDS[name].search(html, at)
            end = close.start() if close else len(html)
            if name in PLAIN:
                add(at, end)
            at = end
    add(at, len(html))
    return out


def _mapped(of):
    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else of(t) for t in column.to_pylist()], pa.string())

    return run


def visible_text(c: Column, cut_stay: bool = False) -> Column:
    """The visible texts of HTML, joined by spaces; NULL stays NULL. ``cut_stay`` is that of ``decode_references``."""
    return _mapped(lambda t: " ".join(shown_texts(t, cut_stay)))(c)


def visible_of_escaped(c: Column, cut_stay: bool = False) -> Column:
    """The same where markup itself may be escaped, as in scraped cells: references are resolved before tags are looked for, too."""
    return _mapped(lambda t: " ".join(shown_texts(decode_references(t, cut_stay), cut_stay)))(c)
