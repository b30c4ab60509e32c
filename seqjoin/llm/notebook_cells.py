"""Splitting a notebook written out as one text back into its cells.

Six renderings are understood: notebook JSON, ``<cell kind=...>`` blocks, percent
scripts, ``In [n]: / Out[n]:`` transcripts, fenced markdown, and plain text.  A text
in none of them is one ``whole`` cell.  ``null`` gives no cells, an empty text one
empty ``whole`` cell.  Broken JSON falls back to the next rendering that fits, in the
last resort to one ``whole`` cell, so no character is ever left unseen.
"""

from __future__ import annotations

import json
import re

CODE, TEXT, OUTPUT, WHOLE = "code", "text", "output", "whole"

_XML_OPEN = re.compile(r'^<cell kind="(\w+)"[^>\n]*>\n?', re.M)
_PERCENT = re.compile(r"^# (%%(?: \[markdown\]| In\[[^\]\n]*\])?[^\n]*|Out\[[^\]\n]*\])\n?", re.M)
_TRANSCRIPT = re.compile(r"^(In|Out) ?\[[^\]\n]*\]: ?", re.M)
_FENCE = re.compile(r"^```([^\n`]*)\n(.*?)(?:^```[ \t]*$\n?|\Z)", re.M | re.S)


def _joined(value: object) -> str:
    """Text of a JSON value: strings as they are, lists of lines joined, dicts by value."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(x[:-1] if x.endswith("\n") else x for x in map(_joined, value))
    if isinstance(value, dict):
        return "\n".join(map(_joined, value.values()))
    return ""


def _from_json(text: str) -> list[tuple[str, str]] | None:
    try:
        cells = json.loads(text)["cells"]
        found = []
        for cell in cells:
            kind = CODE if cell.get("cell_type") == "code" else TEXT
            found.append((kind, _joined(cell.get("source") or "")))
            for out in cell.get("outputs") or []:
                body = {k: v for k, v in out.items() if k not in ("output_type", "name", "metadata")}
                found.append((OUTPUT, _joined(body)))
        return found
    except (ValueError, TypeError, KeyError, AttributeError, RecursionError):
        return None


def _from_xml(text: str) -> list[tuple[str, str]]:
    found, at = [], 0
    for m in _XML_OPEN.finditer(text):
        if m.start() < at:
            continue
        if text[at : m.start()].strip():
            found.append((TEXT, text[at : m.start()]))
        end = text.find("\n</cell>", m.end() - 1)
        at = len(text) if end < 0 else end + 8
        kind = m[1] if m[1] in (CODE, TEXT, OUTPUT) else TEXT
        found.append((kind, text[m.end() : at - 8 if end >= 0 else at]))
    if text[at:].strip():
        found.append((TEXT, text[at:]))
    return found


def _uncommented(body: str) -> str:
    return "\n".join(x[2:] if x.startswith("# ") else x[1:] if x.startswith("#") else x for x in body.split("\n"))


def _from_percent(text: str) -> list[tuple[str, str]]:
    marks = list(_PERCENT.finditer(text))
    found = [(TEXT, _uncommented(text[: marks[0].start()]))] if text[: marks[0].start()].strip() else []
    for m, after in zip(marks, [*marks[1:], None]):
        body = text[m.end() : after.start() if after else len(text)]
        if m[1].startswith("%% [markdown]"):
            found.append((TEXT, _uncommented(body)))
        elif m[1].startswith("%%"):
            found.append((CODE, body))
        else:
            found.append((OUTPUT, "\n".join(x[3:] if x.startswith("#> ") else x[2:] if x.startswith("#>") else x for x in body.split("\n"))))
    return found


def _from_transcript(text: str) -> list[tuple[str, str]]:
    marks = list(_TRANSCRIPT.finditer(text))
    found = [(TEXT, text[: marks[0].start()])] if text[: marks[0].start()].strip() else []
    for m, after in zip(marks, [*marks[1:], None]):
        body = text[m.end() : after.start() if after else len(text)]
        head, _, rest = body.partition("\n\n")
        found.append((CODE if m[1] == "In" else OUTPUT, head))
        if rest.strip():
            found.append((TEXT, rest))
    return found


def _from_fences(text: str) -> list[tuple[str, str]]:
    found, at = [], 0
    for m in _FENCE.finditer(text):
        if text[at : m.start()].strip():
            found.append((TEXT, text[at : m.start()]))
        found.append((CODE if m[1].strip() else OUTPUT, m[2]))
        at = m.end()
    if text[at:].strip():
        found.append((TEXT, text[at:]))
    return found


def split_cells(text: str | None) -> list[tuple[str, str]]:
    """(kind, content) of every cell, in order; kind is code, text, output or whole."""
    if text is None:
        return []
    if text.lstrip()[:1] == "{" and '"cells"' in text and (cells := _from_json(text)):
        return cells
    if _XML_OPEN.search(text):
        return _from_xml(text)
    if "# %%" in text and _PERCENT.search(text):
        return _from_percent(text)
    if _TRANSCRIPT.search(text):
        return _from_transcript(text)
    if "```" in text and _FENCE.search(text):
        return _from_fences(text)
    return [(WHOLE, text)]
