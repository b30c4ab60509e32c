"""Template residue, filler, error pages and scripts-required notices in notebooks.

1. Every document is split into cells; code cells, tracebacks, quotations, inline code and
   formulas are set aside.  Unfilled slots and filler are found right there, in the text of
   the document itself, however long it is.
2. The rest becomes messages: sentences in lower case, numbers masked.  All distinct messages
   of the corpus are mined for templates with a prefix tree of fixed depth
   (:mod:`seqjoin.llm.templates`), which knows nothing of residue.
3. Every template is classified once (:mod:`seqjoin.llm.notices`), and its verdict is carried
   back through its messages to the documents in which one of them stands on its own: as the
   first sentence of its line, or as half of the line's words.  A sentence further on in a
   paragraph is part of what that paragraph says.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqjoin.llm.notebook_cells import CODE, OUTPUT, split_cells
from seqjoin.llm.notices import classify
from seqjoin.llm.slots import is_filler, without_slots
from seqjoin.llm.templates import leaf_of, mine_templates
from seqjoin.operators.spread import spread
from seqjoin.scratch import materialize

SLOT, FILLER = "slot", "filler"

# What is not the document's own statement

_FENCED = re.compile(r"^```.*?(?:^```|\Z)", re.M | re.S)
_ASIDE = re.compile(
    r"``[^`\n]+``|`[^`\n]*`"  # inline code
    r"|\$\$.+?\$\$|(?<![\w$])\$(?![A-Z_]{3,}\$)[^$\n{][^$\n]*\$(?!\w)|\\\(.+?\\\)"  # formulas
    r"|\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|‘[^’\n]*’|(?<!\w)'[^'\n]*'(?!\w)",  # quotations
    re.S,
)
_ASIDE_START = re.compile("[`$\\\\\"“„«‘']")
_QUOTE_LINE = re.compile(r"^[ \t]*>(?!>).*$", re.M)
_TAG = re.compile(
    r"(?<!<)</?(?:!doctype|html|head|body|title|meta|link|noscript|div|p|h\d|span|center|section|header|footer|nav|main|pre|hr|br|img|a|b|i|em|strong|small|ul|ol|li|table|thead|tbody|tr|td|th|iframe|svg)\b[^<>]*>",
    re.I,
)
_SCRIPT_TAG = re.compile(r"<(script|style)\b.*?</\1>", re.S | re.I)
_HTML = re.compile(r"<(?:!doctype|html|head|body|noscript|div|p|h\d|span|title|center|hr|br)\b[^<>]*>", re.I)
_TRACEBACK = "Traceback (most recent call last)"


def _answer(line: str) -> str | None:
    """The message of a server's JSON answer."""
    line = line.strip()
    if line[:1] != "{":
        return None
    try:
        found = json.loads(line)
    except (ValueError, RecursionError):
        return None
    if not isinstance(found, dict):
        return None
    says = [str(found[k]) for k in ("message", "error", "detail", "title") if isinstance(found.get(k), str)]
    status = found.get("status", found.get("code"))
    if isinstance(status, int) and 400 <= status < 600:
        says.insert(0, f"Error {status}")
    return "\n".join(says) if says else None


def _statement(kind: str, body: str) -> str:
    """What a cell says itself: without tracebacks, code, quotations, formulas and tags."""
    answer = body.strip()
    if answer[:1] == "{" and answer.endswith("}") or '"message"' in answer:
        body = "\n".join(_answer(x) or x for x in body.split("\n"))
    if kind == OUTPUT and (at := body.find(_TRACEBACK)) >= 0:
        body = body[:at]
    if "```" in body:
        body = _FENCED.sub(" ", body)
    if "<" in body and _HTML.search(body):
        body = _TAG.sub("\n", _SCRIPT_TAG.sub("\n", body))
    if kind != OUTPUT and ">" in body:
        body = _QUOTE_LINE.sub(" ", body)
    return _ASIDE.sub(" <aside> ", body) if _ASIDE_START.search(body) else body


# Filler in paragraphs

_BLANK = re.compile(r"\n\s*\n")


def _is_filler_block(block: str, repeats: bool) -> bool:
    """Whether a line, or all lines of a paragraph together, are filler; headings and tables aside."""
    lines = [x for x in block.split("\n") if x and x.lstrip()[:1] not in "#|"]
    if any(len(x) > 12 and is_filler(x, repeats) for x in dict.fromkeys(lines)):
        return True
    return len(lines) > 1 and is_filler("\n".join(lines), repeats)


# Messages

_CODE_NUMBER = re.compile(r"(?<![\w.])[45]\d\d(?![\w.])")
_NUMBER = re.compile(r"\d\w*(?:[.,:]\d+)*")
_DIGIT = re.compile(r"\d")
_LETTERS = re.compile(r"(?<![<\w])[^\W\d_]{2}")
_MARKS = re.compile(r"^[\s⚠*_#•·‣>~=(-]+|[\s*_~=)]+$")
_SOFT_WRAP = re.compile(r"(?<=[^\W\d_,])[ \t]*\n[ \t]*(?=[^\W\d_A-ZÀ-Ý])")
_SENTENCE_END = re.compile(r"(?<=[.!?…])[*_)\]]*\s+")


#: A longer run of characters without a blank, such as an encoded image, is masked in messages like a number.
LONG_WORD = 64


def masked(said: str) -> str:
    """Lower case, HTTP error numbers as ``<code>``, other numbers as ``<num>``."""
    text = said.lower()
    return _NUMBER.sub("<num>", _CODE_NUMBER.sub("<code>", text)) if _DIGIT.search(text) else text


def messages_of_line(line: str) -> Iterator[tuple[str, bool]]:
    """(message, whether it stands on its own) of every sentence of a masked line that has words."""
    if not _LETTERS.search(line):
        return
    pieces = [" ".join(w if len(w) <= LONG_WORD else "<long>" for w in _MARKS.sub("", x).split()) for x in _SENTENCE_END.split(line)]
    sizes = [x.count(" ") + 1 for x in pieces]
    total, before = sum(sizes), 0
    for piece, size in zip(pieces, sizes):
        if _LETTERS.search(piece):
            yield piece, before <= 2 or 2 * size >= total  # an interjection may come first
        before += size


def scan_text(text: str | None) -> tuple[str | None, dict[str, bool]]:
    """(slot or filler or null, messages and whether they stand on their own) of one document's own statements."""
    own: str | None = None
    messages: dict[str, bool] = {}
    for kind, body in split_cells(text):
        if kind == CODE or not body:
            continue
        said = _statement(kind, body)
        said, slot = without_slots(said)
        if slot:
            own = SLOT
        if own is None and any(_is_filler_block(x, kind != OUTPUT) for x in _BLANK.split(said)):
            own = FILLER
        if kind != OUTPUT:
            said = _SOFT_WRAP.sub(" ", said)
        for line in dict.fromkeys(masked(said).split("\n")):
            if line:
                for message, alone in messages_of_line(line):
                    messages[message] = alone or messages.get(message, False)
    return own, messages


def scan_documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, own, leaf, message, alone): a row per message, and one without message per document with an own finding."""
    schema = f"id {docs.schema[doc_id].dataType.simpleString()}, own string, leaf string, message string, alone boolean"
    kinds = (pa.string(), pa.string(), pa.string(), pa.bool_())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for i, x in enumerate(batch.column(1)):
                found, messages = scan_text(x.as_py())
                if found:
                    rows.append((found, None, None, None))
                rows.extend((None, leaf_of(m.split(" ", 3)[:3], m.count(" ") + 1), m, alone) for m, alone in messages.items())
                at.extend([i] * (len(rows) - len(at)))
            columns = list(zip(*rows)) or [[]] * 4
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.record_batch([ids, *(pa.array(list(c), k) for c, k in zip(columns, kinds))], ["id", "own", "leaf", "message", "alone"])

    return spread(docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))).mapInArrow(scan, schema)


def classified_templates(mined: DataFrame) -> DataFrame:
    """(leaf, template, verdict, n_messages, n): every template once, ``verdict`` null for ordinary ones."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [classify(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(verdicts, pa.string())], ["leaf", "template", "n_messages", "n", "verdict"])

    each = mined.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("n_messages"), F.sum("n").alias("n"))
    return each.mapInArrow(judge, "leaf string, template string, n_messages bigint, n bigint, verdict string")


def residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind): documents with residue and each kind found, one row per kind.

    Kinds: slot, filler, instruction, error_page, scripts_required.  Null and empty texts
    have none; copies are judged alike; a text of any length is read whole; other columns
    are not read.  ``doc_id`` may be null or repeated: rows are then told apart only by it.
    """
    scanned = materialize(scan_documents(docs, doc_id, text), "messages")
    mined = mine_templates(scanned.where("message IS NOT NULL").select("leaf", "message"))
    verdicts = classified_templates(mined).where("verdict IS NOT NULL").select("leaf", "template", "verdict")
    bad = mined.join(verdicts, ["leaf", "template"]).select("message", F.col("verdict").alias("kind"))
    by_template = scanned.where("alone").join(bad, "message").select("id", "kind")
    by_text = scanned.where("own IS NOT NULL").select("id", F.col("own").alias("kind"))
    return by_text.unionByName(by_template).distinct().withColumnRenamed("id", doc_id)
