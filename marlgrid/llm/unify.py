"""Bring visually identical text made of different characters to one form.

Per character, a quick-check property says whether a text may hold it
unchanged: it is stable under NFKC (Unicode's NFKC_Quick_Check = Yes), no
look-alike letter of another script, no invisible mark and no odd space, dash
or quote.  Text of stable characters only is never touched.  In other text the
unstable runs are isolated, each is extended to a normalisation boundary (the
starter before it, the combining marks after it), only those segments are
normalised, and the results are spliced into the unchanged rest.

A look-alike letter of another script becomes Latin only where its value is
Latin text: the value has Latin letters (compatibility forms of them included),
or every letter of it has a Latin look-alike.  A name really written in another
script keeps its letters.

ASCII text never leaves the JVM; other text is handled in Arrow batches with
every value of a batch done once.  Null stays null, empty stays empty, and the
form of a form is itself.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters and the Latin letters that they look like.
LOOKALIKES = {
    # Cyrillic, small
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p",
    "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ё": "ë", "ї": "ï",
    # Cyrillic, capital
    "А": "A", "В": "B", "С": "C", "Ԁ": "D", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "Ӏ": "I", "М": "M", "О": "O", "Р": "P",
    "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ё": "Ë", "Ї": "Ï",
    # Greek, small
    "α": "a", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    # Greek, capital
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    # Armenian
    "ա": "w", "գ": "q", "հ": "h", "ո": "n", "ս": "u", "օ": "o", "ց": "g", "յ": "j", "ք": "p", "զ": "q", "Ս": "U", "Օ": "O", "Լ": "L", "Տ": "S",
    # Latin letters of other alphabets than the ordinary ones
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ɪ": "i", "ı": "i", "ʏ": "y", "ʋ": "v", "ʟ": "l", "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ᴏ": "o", "ᴜ": "u", "ᴠ": "v",
    "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ⲟ": "o", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮤ": "W", "Ꮓ": "Z",
}

# Marks that stand for an ASCII character.
PUNCTUATION = {
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "˗": "-", "﹘": "-", "﹣": "-",
    "‘": "'", "’": "'", "‛": "'", "′": "'", "ʹ": "'", "ʻ": "'", "ʼ": "'", "ʽ": "'", "ˈ": "'", "´": "'", "ʹ": "'", "՚": "'", "ꞌ": "'",
    "“": '"', "”": '"', "‟": '"', "″": '"', "ʺ": '"',
    "⁄": "/", "∕": "/", "‚": ",", "․": ".", "։": ":", "∶": ":", "﹫": "@",
}

_SPACES = {"Zs", "Zl", "Zp"}
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Default_Ignorable_Code_Point}\p{Cc}\p{Co}]")
_ASCII_SPACING = set("\t\n\r\v\f")


@lru_cache(maxsize=None)
def _kind(ch: str) -> str:
    """'ok', 'letter' (look-alike), 'mark' (combining) or 'odd' (any other unstable character)."""
    if ch.isascii():
        return "ok" if ch.isprintable() or ch in _ASCII_SPACING else "odd"
    if ch in LOOKALIKES or unicodedata.normalize("NFD", ch)[0] in LOOKALIKES:
        return "letter"
    if unicodedata.combining(ch):
        return "mark"
    if ch in PUNCTUATION or unicodedata.category(ch) in _SPACES or _INVISIBLE.match(ch):
        return "odd"
    return "ok" if unicodedata.is_normalized("NFKC", ch) else "odd"


#: Characters whose quick-check property has to be looked up at all.
_LOOK_UP = regex.compile(r"[^\x09-\x0d\x20-\x7e]+")


def unstable_runs(text: str):
    """Spans (begin, end) of characters whose quick-check property is not Yes."""
    for run in _LOOK_UP.finditer(text):
        begin = None
        for at in range(run.start(), run.end()):
            if _kind(text[at]) != "ok":
                begin = at if begin is None else begin
            elif begin is not None:
                yield begin, at
                begin = None
        if begin is not None:
            yield begin, run.end()


def _fold(ch: str, latin: bool) -> str:
    kind = _kind(ch)
    if kind == "letter":
        return "".join(LOOKALIKES.get(c, c) for c in (ch if ch in LOOKALIKES else unicodedata.normalize("NFD", ch))) if latin else ch
    if kind in ("ok", "mark"):
        return "" if kind == "mark" and _INVISIBLE.match(ch) else ch
    if ch in PUNCTUATION:
        return PUNCTUATION[ch]
    if unicodedata.category(ch) in _SPACES:
        return " "
    if _INVISIBLE.match(ch):
        return ""
    plain = unicodedata.normalize("NFKC", ch)
    return "".join(_fold(c, latin) if c != ch else c for c in plain) if plain != ch else ch


def is_latin(text: str) -> bool:
    """Whether a text's look-alike letters stand for Latin ones."""
    has_latin, all_like = False, True
    for ch in text:
        if ch.isascii():
            has_latin |= ch.isalpha()
            continue
        base = unicodedata.normalize("NFKD", ch)[:1] or ch
        if base in LOOKALIKES or not base.isalpha():
            # An other script's letter, or a Latin one that only looks ordinary.
            continue
        if regex.match(r"\p{Latin}", base):
            has_latin = True
        else:
            all_like = False
    return has_latin or all_like


def unify(text: str | None) -> str | None:
    """The one form of a text."""
    if text is None or text.isascii() and text.isprintable():
        return text
    latin, out, done = None, [], 0
    for begin, end in unstable_runs(text):
        if begin < done:
            continue
        if latin is None:
            latin = is_latin(text)
        # Boundary context: the starter with which a mark of the run may compose, and the marks after the run.
        if begin > done and any(unicodedata.combining(c) for c in text[begin:end]):
            begin -= 1
        while end < len(text) and (unicodedata.combining(text[end]) or _kind(text[end]) != "ok"):
            end += 1
        segment = "".join(_fold(c, latin) for c in text[begin:end])
        out.append(text[done:begin])
        out.append(unicodedata.normalize("NFC", segment))
        done = end
    out.append(text[done:])
    joined = "".join(out)
    # Removing an invisible character can put a starter beside its mark.
    return joined if unicodedata.is_normalized("NFC", joined) else unicodedata.normalize("NFC", joined)


def has_odd_character(text: str | None) -> bool:
    """Whether a text holds a character other than the ordinary one."""
    if text is None or text.isascii() and text.isprintable():
        return False
    latin = None
    for ch in text:
        kind = _kind(ch)
        if kind == "ok":
            continue
        if kind in ("odd", "mark"):
            if kind == "mark" and not _INVISIBLE.match(ch):
                # A mark that nothing composes with is part of its script's ordinary spelling.
                if unicodedata.is_normalized("NFC", text) and not is_latin(text):
                    continue
            return True
        if latin is None:
            latin = is_latin(text)
        if latin:
            return True
    return not unicodedata.is_normalized("NFC", text) and unify(text) != text


def _batched(values: pd.Series, function) -> pd.Series:
    unique = {v: function(v) for v in values.dropna().unique()}
    return values.map(unique.get, na_action="ignore")


@F.pandas_udf(T.StringType())
def _unify_udf(values: pd.Series) -> pd.Series:
    return _batched(values, unify).astype(object).where(values.notna(), None)


def changed(text: str) -> bool:
    """Whether the operator gives a text another form, and an odd character is the reason (the exact check)."""
    return unify(text) != text and has_odd_character(text)


@F.pandas_udf(T.BooleanType())
def _odd_udf(values: pd.Series) -> pd.Series:
    return _batched(values, changed).fillna(False).astype(bool)


#: Plain ASCII text, decided inside the JVM.
PLAIN = r"^[\x20-\x7e\t\n\r\x0b\x0c]*$"


def unified(column: Column) -> Column:
    """Column of the one form; plain ASCII text stays in the JVM."""
    plain = column.rlike(PLAIN)
    return F.when(plain, column).otherwise(_unify_udf(F.when(~plain, column)))


def odd(column: Column) -> Column:
    """Whether the one form of the text is another one for an odd character; null text has none."""
    plain = column.rlike(PLAIN)
    return ~plain & _odd_udf(F.when(~plain, column))
