"""Unfilled slots and filler text, found in the text itself."""

from __future__ import annotations

import re
from functools import lru_cache

_ASK_FIRST = r"(?:please )?(?:insert|enter|your|fill in|type|add|tbd|todo|saisir|insérer|indiquer|votre|vos|hier|ihr|ihre|insertar|introducir|escribir|indicar|rellenar|poner|su|sus|aquí|inserire)\b"
_ASK_LAST = r"(?:goes here|here|to be (?:added|filled in|done)|tbd|à compléter|à remplir|ici|eintragen|ergänzen|einfügen|einsetzen|aquí|por completar|a completar|pendiente)"
_NOUN = r"(?:name|nachname|vorname|title|date|address|email|e-mail|company|project|city|phone|url|link|key|token|password|username|number|version|author|description|nom|prénom|nombre|apellido|fecha|firma|datum|fullname|year)"
_SLOTS = re.compile(
    r"\{\{[ \t]*[^\W\d][^{}\n]{0,80}\}\}"
    r"|\{%-?[ \t]*\w[^%{}\n]{0,80}%\}"
    r"|<%[=-]?[ \t]*\w[^%<>\n]{0,80}%>"
    r"|\$\{[^\W\d][^{}\n]{0,60}\}"
    r"|(?<![\w%])%%?[A-Z][A-Z0-9_]{2,60}%%?(?!\w)"
    r"|(?<![\w$])\$[A-Z][A-Z0-9_]{2,60}\$(?!\w)"
    r"|##[A-Z][A-Z0-9_]{1,60}##|@@[A-Z][A-Z0-9_]{1,60}@@|(?<!\w)__[A-Z][A-Z0-9_]{1,60}__(?!\w)"
    r"|<<[ \t]*[^\W\d][^<>\n]{1,60}>>"
    r"|<(?:[A-Z][A-Z0-9]*[_ -])+[A-Z0-9]+>|<(?:first|last|full|user|your|project|company|team|version)[ _-]?(?i:" + _NOUN + r")>"
    r"|(?<![\w<])(?:INSERT|ENTER|YOUR|REPLACE|FILL|PUT|CHANGE)(?:_[A-Z0-9]+)+(?!\w)"
    r"|\[(?!(?:OK|INFO|WARN|WARNING|ERROR|DEBUG|FATAL|TRACE|NOTE|PASS|FAIL|DONE|SKIP|CRITICAL|NULL|NONE|NAN|TRUE|FALSE)\])[^\W\d_a-zà-ÿ](?:[^\W\d_a-zà-ÿ]|[ '’_-]){2,60}\](?!\()"
    r"|(?<![!\w\]])\[[^\W\d_A-ZÀ-Ý]+(?: [^\W\d_A-ZÀ-Ý]+){1,4}\](?![(\[])|(?m:(?<=: )\[[^\W\d_]{3,40}\][.]?$)"
    rf"|(?<![!\w\]])\[(?:[A-Za-zÀ-ÿ]+ )?(?i:{_NOUN})\](?![(\[:])|(?<![!\w\]])\[(?:Your|My|Company|Project|Team|Client|Ihr|Ihre|Votre|Su|Firma) [^\W\d_]+\](?![(\[:])"
    rf"|[\[(<]{{1,2}}[ \t]*(?i:{_ASK_FIRST})(?:[ :,'’_-]+\w+){{0,6}}[ \t]*[\])>]{{1,2}}"
    rf"|[\[(<]{{1,2}}[ \t]*(?:[^\W\d_]+[ '’_-]+){{0,5}}(?i:{_ASK_LAST})[ \t]*[\])>]{{1,2}}"
    r"|(?<![\w$\\^_{}])\{[^\W\d_]\w{2,60}\}(?![}\w])"
    r"|(?<!\w)X{1,2}x{2,}(?: X{1,2}x{2,})*(?!\w)|(?<!\w)X{2}[/.-]X{2}[/.-]\d{0,2}X{2,4}(?!\w)"
    r"|(?<!\w)(?i:(?:dd|tt|jj)([./-])mm\1(?:yyyy|jjjj|aaaa|yy)|mm([./-])dd\2yyyy|(?:yyyy|jjjj|aaaa)([./-])mm\3(?:dd|tt|jj))(?!\w)"
    r"|(?m:(?<=: )(?:TBD|TBA|T\.B\.D\.|_{5,})[ \t]*[.]?$)"
)
# Where a slot may start: at a mark, or at a word if the text has one of these at all.
_MARK_START = re.compile(r"[{<\[($%#@_](?=[{%<\[(#@_=\- \t]*[^\W\d_]|____)")
_WORD_START = re.compile(
    r"[{<\[($%#@_](?=[{%<\[(#@_=\- \t]*[^\W\d_]|____)|X[xX]|(?:INSERT|ENTER|YOUR|REPLACE|FILL|PUT|CHANGE)_|TB[AD]|T\.B|[dDtTjJ]{2}[./-][mM]|[mM]{2}[./-][dD]|[yYjJaA]{4}[./-][mM]"
)
_HINTS = ("XX", "Xx", "INSERT_", "ENTER_", "YOUR_", "REPLACE_", "FILL_", "PUT_", "CHANGE_", "TBA", "TBD", "T.B", "mm", "MM", "Mm", "mM")


def without_slots(text: str) -> tuple[str, bool]:
    """The text with every unfilled slot of a template as ``<slot>``, and whether there was one."""
    kept, at = [], 0
    starts = _WORD_START if any(h in text for h in _HINTS) else _MARK_START
    for m in starts.finditer(text):
        if m.start() >= at and (found := _SLOTS.match(text, m.start())):
            kept += [text[at : m.start()], " <slot> "]
            at = found.end()
    return ("".join([*kept, text[at:]]), True) if kept else (text, False)


# Filler.  Fixed values: words of the usual filler texts, words that stand for text, and words that only running text has.

_LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam
    quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum
    fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim est laborum
    et ac ad at ante aut ut in ex eu vel nec neque cum quia unde omnis iste natus justo vero eos odit optio nihil accusam stet clita kasd""".split()
)
#: Endings of Latin words that are rare in the modern languages met here; ``_WEAK_END`` counts half.
_LATIN_END = re.compile(r".*(?:us|um|am|is|or|ur|es|ae|em|unt|it|at|et|ix|ux|ox|ia|en|ant|ent|ra|bus|que|issim[aei])$")
_WEAK_END = re.compile(r".*(?:a|i|o|e)$")
_RUNNING = frozenset(
    """the of and to is are was were be been has have had this that these those for from with without by on as or but not no we you they our your their each all some than then which when where how it its an per about only both other another after before between into there will can does
    der die das den dem des ein eine einer eines einem einen und oder ist sind war wurde wird nicht mit von vom für auf aus bei nach zu zum zur je im wir sie ohne über kaum dass als auch
    le la les des du un une est sont pas pour par avec sans dans sur que qui ce cette ces nous vous au aux de après chaque on
    el los las una del y es son no por para con sin que se su sus al en lo más después cada un
    il gli di che per è una della dei delle nel non con""".split()
)
_STOCK = frozenset(
    """text texts paragraph paragraphs sample some words word more dummy copy filler placeholder bla blah blabla test tests testing foo bar
    baz qux abc def xyz blindtext platzhalter fülltext mustertext beispieltext noch mehr ein einige wörter absatz absätze
    texto textos relleno muestra más párrafo párrafos unas algunas palabras ejemplo prueba faux bidon texte encore plus du de d quelques mots
    paragraphe paragraphes exemple essai lorem ipsum is this on example segnaposto testo prova""".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm"), ("qwertzuiop", "asdfghjkl", "yxcvbnm"), ("azertyuiop", "qsdfghjklm", "wxcvbn")
_KEY_AT = [{c: (row, at) for row, keys in enumerate(rows) for at, c in enumerate(keys)} for rows in _ROWS]


@lru_cache(1 << 16)
def _mashed(word: str) -> bool:
    """Whether neighbouring letters are neighbouring keys, but for the seams of a few runs."""
    for key_at in _KEY_AT:
        places = [key_at.get(c) for c in word]
        if len(word) < 3 or None in places:
            continue
        breaks = sum(a[0] != b[0] or abs(a[1] - b[1]) > 2 for a, b in zip(places, places[1:]))
        if breaks <= (len(word) - 1) // 4:
            return True
    return False


@lru_cache(1 << 16)
def _latin(word: str) -> float:
    if word in _LATIN:
        return 1.0
    return 1.0 if _LATIN_END.match(word) else 0.5 if _WEAK_END.match(word) else 0.0


def is_latin_filler(words: list[str]) -> bool:
    """Whether words are imitation Latin: hardly a word that only running text of a modern language has, nearly all of Latin form.

    Two known words of the usual filler, of three letters or more, suffice with that; without, the words have to be
    eight or more, none of them such a word, and look Latin nearly throughout.
    """
    n, running = len(words), 0
    for w in words:
        running += w in _RUNNING and w not in _LATIN
        if running > n / 8:
            return False
    if n < 4:
        return False
    different = set(words)
    known = different & _LATIN
    if len(known) >= 0.6 * len(different):
        return True
    return (sum(len(w) > 2 for w in known) >= 2 or n >= 8 and not running) and sum(map(_latin, words)) >= 0.7 * n


def _is_mashed(words: list[str]) -> bool:
    """Whether at least three of four words are keys struck at random, and half of all words long enough to tell."""
    n = len(words)
    if n < 4 or sum(len(w) > 3 for w in words) < n / 2:
        return False
    spared = n - 0.75 * n
    for w in words:
        spared -= not _mashed(w)
        if spared < 0:
            return False
    return True


def is_filler(text: str, repeats: bool = True) -> bool:
    """Whether a passage consists of filler: imitation Latin, stock words over and over, or keys struck at random.

    With ``repeats`` also any few words over and over, which outputs may print for good reason.
    """
    words = _WORD.findall(text.lower())
    n = len(words)
    if n < 3:
        return False
    different = len(set(words))
    stock = sum(w in _STOCK for w in words)
    if stock == n and different <= max(2, n * 0.7) or n >= 6 and stock >= 0.9 * n and different <= n * 0.6:
        return True
    if repeats and n >= 8 and different <= n * 0.2 and "|" not in text:
        return True
    return is_latin_filler(words) or _is_mashed(words)
