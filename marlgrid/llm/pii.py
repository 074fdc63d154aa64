"""Personal information in free text: find it behind disguises, replace it, keep the rest.

A text passes through transducers that write its plain form and, for every
character of that form, the place in the source it came from: look-alike and
full-width characters, invisible marks, "(at)" and "[dot]" in several languages,
a spaced @, and runs of spelled digits.  Identifiers are detected in the plain
form and their spans are carried back, so positions are code points of the text
as it was given and only the spans themselves change when it is redacted.

Types: email, phone, id_number, address, name.  A span belongs to one type; where
two would overlap, the order email, id_number, phone, address, name decides.
Names are full names (two words at least) where people are named: in forms and
signatures, after a title, greeted or spoken with, or opening a sentence before
what people do or where they belong.  Capitals, titles, ordinary words and the
context decide together; titles are not part of a name.  Null and empty texts hold nothing; texts of
any length are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marlgrid.llm.unify import _fold, _kind, is_latin, unstable_runs

TYPES = ("email", "phone", "id_number", "address", "name")

# The words that stand for @, dot and digits in English, Portuguese and Vietnamese.
_AT = r"at|arroba|a còng|a cong|aroba"
_DOT = r"dot|ponto|chấm|cham|punto|point"
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "um": "1", "uma": "1", "dois": "2", "duas": "2", "três": "3", "tres": "3", "quatro": "4", "cinco": "5", "seis": "6", "meia": "6", "sete": "7", "oito": "8", "nove": "9",
    "không": "0", "một": "1", "hai": "2", "ba": "3", "bốn": "4", "năm": "5", "sáu": "6", "bảy": "7", "tám": "8", "chín": "9",
}
_BRACKETS = frozenset("[({<")
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT_SIGN = re.compile(rf"(?i)[ \t]*{_OPEN} *(?:{_AT}|@) *{_CLOSE}[ \t]*|(?<=[\w+\-]) @ (?=[\w\-]+(?:\.| ?[\[(]))|(?<=[\w+\-]) (?:arroba|a còng) (?=[\w\-]+(?:\.| ?[\[(]| (?:{_DOT}) ))|(?<=[\w+\-]) at (?=[\w\-]+(?: (?:{_DOT}) [\w\-]+)* (?:{_DOT}) [a-z]{{2,}}\b)")
_DOT_SIGN = re.compile(rf"(?i)(?<=[\w])[ \t]*{_OPEN} *(?:{_DOT}|\.) *{_CLOSE}[ \t]*(?=\w)")
_BARE_DOT = re.compile(rf"(?i)(@[\w\-.]+) (?:{_DOT}) (?=\w)")
_SPELLED = re.compile(r"(?i)(?<!\w)(?:(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + r")[ ,\-]{1,2}){6,}(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + r")(?!\w)")


class Plain:
    """A text's plain form and the source place of each of its characters."""

    __slots__ = ("text", "at", "low", "marks", "places")

    def __init__(self, source: str):
        self.text, self.at = source, None  # None: every character stands where it stood
        self.low, self.marks, self.places = "", 0, []

    def place(self, i: int) -> int:
        return i if self.at is None else self.at[i]

    def splice(self, changes: list[tuple[int, int, str]]) -> None:
        """Apply replacements (begin, end, new) given in order of place."""
        if not changes:
            return
        at = range(len(self.text) + 1) if self.at is None else self.at
        text, places, done = [], [], 0
        for begin, end, new in changes:
            text += [self.text[done:begin], new]
            places.extend(at[done:begin])
            places.extend([at[begin]] * len(new))
            done = end
        text.append(self.text[done:])
        places.extend(at[done:])
        self.text, self.at = "".join(text), places
        self.low = self.text.lower()


def _as_number(digits: list[str]) -> str:
    """Spelled digits as a number is written, so that it reads as a phone and not as a code."""
    text = "".join(digits)
    if len(text) == 7:  # without an area; zeros stand for one
        return f"(000) {text[:3]}-{text[3:]}"
    head = min(4, max(2, len(text) - 7))
    return f"({text[:head]}) {text[head:-4] if len(text) - head > 6 else text[head:head + 3]}-{text[-4:] if len(text) - head > 6 else text[head + 3:]}"


#: Characters beyond ordinary Latin text and pictographs; without them nothing has to be folded.
_UNUSUAL = re.compile("[\x80-\xa9\xab-\xb9\xbb-\xbf\u0250-\u1dff\u1f00-\ufffd\U00010000-\U0001efff\U0001fb00-\U0010ffff]")


def plain_form(source: str) -> Plain:
    """Undo the disguises of a text."""
    plain = Plain(source)
    if not source.isascii() and _UNUSUAL.search(source):
        changes = []
        latin = None
        for begin, end in unstable_runs(source):
            if latin is None:
                latin = is_latin(source)
            for i in range(begin, end):
                if source[i] == "º" or source[i] == "ª" or _kind(source[i]) == "mark":
                    continue
                folded = _fold(source[i], latin)
                if folded != source[i]:
                    changes.append((i, i + 1, folded))
        plain.splice(changes)
    plain.low = plain.text.lower()
    plain.marks, plain.places = _marked(plain.low)
    before = plain.text
    if plain.marks & _AT_MARK or (plain.marks & _OPEN_MARK and "@" in plain.low) or any(b & _AT_WORD and (plain.marks & _DOT_MARK or plain.low[:i].rstrip(" ")[-1:] in _BRACKETS) for i, b in plain.places):
        plain.splice([(m.start(), m.end(), "@") for m in _AT_SIGN.finditer(plain.text)])
    if "@" in plain.text and plain.marks & (_DOT_MARK | _OPEN_MARK):
        plain.splice([(m.start(), m.end(), ".") for m in _DOT_SIGN.finditer(plain.text)])
        while found := [(m.end(1), m.end(), ".") for m in _BARE_DOT.finditer(plain.text)]:
            plain.splice(found)
    spelled = list(_SPELLED.finditer(plain.text)) if sum(b & _SPELLED_MARK for _, b in plain.places) >= 7 * _SPELLED_MARK else []
    if spelled:
        plain.splice([(m.start(), m.end(), _as_number([_DIGITS[w.lower()] for w in re.findall(r"[^\W\d_]+", m.group())])) for m in spelled])
    if plain.text is not before:
        plain.places = _marked(plain.low)[1]
    return plain


_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}")

_ID_VALUE = r"(?:[A-Z]{1,3} ?)?\d(?:[\d.\-/ ]{5,18})[\dXx](?![\w])"
_ID_LABEL = r"\b(?:CPF|CNPJ|RG|SSN|CCCD|CMND|doc|documento|document|ID(?: number| on file| no\.?)?|Registered under|số giấy tờ|giấy tờ|căn cước(?: công dân)?|chứng minh nhân dân|identidade|passport|passaporte|hộ chiếu)(?: do titular| da titular| of record)?"
_ID_LABELLED = re.compile(rf"(?i:{_ID_LABEL}) ?[:=#]? ?({_ID_VALUE}|[A-Z]{{2}}\d{{6,9}}\b)")
_ID_SHAPE = re.compile(r"(?<![\w.,/\-])(?:\d{3}\.\d{3}\.\d{3}-\d{2}|\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}|\d{2}\.\d{3}\.\d{3}-[\dXx]|\d{3}([\-. ])\d{2}\1\d{4}|[A-Z]{2}\d{6,9}|0\d{3}-\d{4}-\d{4}|0\d{2} \d{3} \d{3} \d{3}|00\d{10})(?![\w]|[.\-/]\d)")
#: What stands before codes that have the shape of an identifier or a phone but are none.
_CODE_BEFORE = re.compile(r"(?i)(?<!\w)(?:batch|lot|lote|lô|protocolo?|giao thức|tracking|rastreio|rastreamento|vận đơn|order|pedido|đơn(?: hàng)?|run|lượt)(?: (?:code|number|no|mã|số|código|número|n[º°]))?\.? ?[:=#]? ?$")

_SEP = r"[ .\-]?"
_PHONE = re.compile(
    r"(?<![\w.,/\-+])(?:"
    rf"\+\d{{1,3}}{_SEP}(?:\(\d{{2,4}}\)|\d{{2,4}})(?:{_SEP}\d{{2,5}}){{2,3}}"  # +55 (25) 3257-0394
    r"|\+\d{10,13}"
    r"|00\d{2} \d{2,3} \d{3,5} ?\d{3,4}"  # 0055 58 93575 4700
    rf"|(?:1{_SEP})?\(\d{{2,4}}\){_SEP}\d{{3,5}}{_SEP}\d{{3,4}}\d?"  # (25) 93715-0576, 1 (911) 555 0189
    r"|(?:1[ .\-])?\d{3}([ .\-])\d{3}\1\d{4}"  # 745-555-0164
    r"|\d{2}[ .\-]9[ .\-]\d{4}[ .\-]\d{4}"  # 52 9 5709 6322
    r"|\d{2}[ .\-]\d{4,5}[.\-]\d{4}"  # 76-94413.9732
    r"|[1-9]{2} 9\d{4} \d{4}"  # 11 98765 4321
    r"|0\d{3}([ .\-])\d{3}\2\d{4}"  # 0122.886.8663
    r"|0[1-9]\d{9,10}"  # 01297586828
    r"|0\d{2}(?P<d>[ .\-])\d{4}(?P=d)\d{4}|0\d{4}[ .\-]\d{6}"  # 020 7946 0958, 01632 960001
    r"|0[35789](?:\d{8}|\d{2}(?P<a>[ .\-])\d{3}(?P=a)\d{3}|\d(?P<b>[ .\-])\d{3}(?P=b)\d{4}|(?P<c>[ .\-])\d{4}(?P=c)\d{4}|\d{2}[ .\-]\d{6})"  # 0912 345 678
    r")(?![\w]|[.\-/,]\d)"
)

_WORD = r"[^\W\d_][\w'’\-]*"
_PT_STREET = r"Rua|Calle|Carrera|Via|Viale|Piazza|Plaza|R\.|Avenida|Av\.|Alameda|Al\.|Travessa|Trav\.|Tv\.|Pra[çc]a|P[çc]a\.|Estrada|Estr\.|Rodovia|Rod\.|Largo"
_EN_STREET = r"(?i:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?|Drive|Dr\.|Court|Ct\.|Boulevard|Blvd\.?|Terrace|Crescent)|CLOSE|Close|Way|Place|Row|Grove|Mews|close(?=,)"
_FR_STREET = r"rue|avenue|boulevard|quai|impasse|chemin"
_DE_STREET = r"stra(?:ß|ss)e|str\.|gasse|weg|platz|allee|ufer|damm"
_VI_STREET = r"đường|phố|ngõ|ngách|hẻm|duong|pho|ngo|ngach|hem"
_ADDRESS = [
    re.compile(rf"(?<![\w])(?i:{_PT_STREET}) +(?:{_WORD}\.? +){{0,5}}{_WORD},? +(?:(?i:n[º°o]?|número)\.? *)?\d{{1,5}}\b(?:,? (?:apto|apt|bloco|casa|- bloco)\.? ?\w+)?"),
    re.compile(rf"(?<![\w.,\-/])\d{{1,5}}[A-Za-z]?,? +(?:{_WORD} +){{1,4}}?(?:{_EN_STREET})(?![\w])(?:, (?:Apt|Flat|Unit|Suite)\.? ?\w+)?"),
    regex.compile(rf"(?<![\w.,\-/])\d{{1,5}}[A-Za-z]?(?:/\d{{1,4}}[A-Za-z]?)* +(?i:{_VI_STREET}) +(?:\p{{Lu}}\w*(?: \p{{Lu}}\w*){{0,3}}|{_WORD}(?: {_WORD})?)(?:, (?i:phường|phuong) ?\d+)?"),
    re.compile(rf"(?<![\w.,\-/])\d{{1,4}}(?: ?bis| ?ter)?,? +(?i:{_FR_STREET}) +(?:(?i:de|du|des|de la|d')[ ']?)?[A-ZÀ-Ý]\w*(?:[ \-][A-ZÀ-Ý]\w*){{0,3}}"),
    re.compile(rf"(?<![\w])(?:[A-ZÄÖÜ][\wäöüß\-]*(?:{_DE_STREET})|(?:[A-ZÄÖÜ][\wäöüß]*[ \-]){{1,2}}(?=[A-Z])(?i:{_DE_STREET})) +\d{{1,4}}(?: ?[a-z]\b)?(?![\w])"),
    regex.compile(rf"(?<![\w])(?:đường|phố|ngõ|hẻm|Đường|Phố|Ngõ|Hẻm) +\p{{Lu}}\w*(?: \p{{Lu}}\w*){{0,3}},? +(?:số *)?\d{{1,5}}[A-Za-z]?(?:/\d+)*\b"),
]

# How a name begins and what it may consist of: words, initials, and one comma (surname first).
_PART = r"(?:[^\W\d_]\.|[^\W\d_][\w'’\-]*)"
_RUN = rf"{_PART}(?: +{_PART}){{0,11}}"
_FULL = rf"(?:{_RUN}, +{_RUN}|{_RUN})"
_STOP = {"e", "and", "ở", "o", "đã", "da", "from", "ligou", "called", "với", "tại"}
_TITLE = r"(?i:(?:(?:a|o) )?(?:sra?|srta|dra?|mrs?|ms|miss|dona)\.? +|(?:anh|chị|ông|bà|cô|chú|chi|ong) +)?"
_NAMED = [
    re.compile(r"\b(?i:nome|name|buyer_name|tên|ten|ho_ten)=([^|\n;]+)"),
    re.compile(r"\"(?i:comprador|buyer|nguoi_mua|nome|name|cliente|customer|ten)\" ?: ?\"([^\"\n]+)\""),
    re.compile(rf"\b(?i:comprador|compradora|buyer|người mua|nguoi mua) \(([^()\n]{{3,80}}?), *(?=[^ ,()]+@)"),
    re.compile(rf"\b(?i:meu nome é|meu nome e|me chamo|my name is|tôi tên là|toi ten la) +({_FULL})"),
    re.compile(rf"\b(?i:quem recebeu foi|người nhận là|nguoi nhan la|received by) +{_TITLE}({_FULL})"),
    re.compile(rf"(?<![\w])(?i:ficha|contact card|liên hệ|lien he|contato|contact): *{_TITLE}([^;\n|]{{3,80}});"),
    re.compile(rf"\b(?i:nota emitida para|phiếu ghi cho|phieu ghi cho|issued to) +{_TITLE}({_FULL})(?=, *(?i:documento|giấy tờ|giay to|document|doc))"),
    re.compile(rf"\b(?i:registered under) [A-Z\d][\w.\-/ ]{{6,20}}? for +{_TITLE}({_FULL})"),
    re.compile(rf"(?<![\w])(?i:att|atenciosamente|abraços|signed|regards|sincerely|best|trân trọng|tran trong)\.?, *{_TITLE}({_FULL})"),
    re.compile(rf"(?<![\w])(?i:ms|mrs|mr|miss|dr|(?:a|o) sra?|(?:a|o) srta)\.? +({_FULL})(?= (?:ligou|called|pediu|asked|đã)\b)"),
    re.compile(rf"(?<![\w])(?i:chị|anh|ông|bà|chi|ong) +({_FULL})(?= (?:đã gọi|da goi|đã|xin)\b)"),
]
# How people are met in running text: greeted, spoken with, named after what they did.
_CAPITAL = r"[^\W\d_a-zà-öø-ÿ]"
_CAPITALS = rf"{_CAPITAL}[\w'’\-]*\.?(?: +(?:(?:d[aeiou]s?|e|van|von|der|den|bin|al) +)*{_CAPITAL}[\w'’\-]*(?:\.(?= ))?)+"
_MET = re.compile(
    rf"(?<![\w])(?:(?i:(?:spoke|spoken|talked|talk|speak|met|meeting) (?:with|to)|speak to|met with|emailed|phoned|dear|attn|attention|thanks to|on behalf of|ask for|asked for|falei com|conversei com|falar com|encontrei|prezad[oa]|car[oa]|aos cuidados de|em nome de|obrigad[oa] a|gặp|nói chuyện với|kính gửi|gửi tới|thay mặt)[:.]? +)"
    rf"{_TITLE}(?P<name>{_CAPITALS})"
)
_TITLED = re.compile(rf"(?<![\w])(?:(?i:mrs?|ms|miss|dr|prof|sra?|srta|dra|dona|seu|chị|anh|ông|bà|cô|chú))\.? +(?P<name>{_CAPITALS})")
#: What people do or where they belong, right after their name.  A name in small letters is taken before the first two only.
_DEEDS = re.compile(
    r" (?:(?:called|phoned|rang|wrote|writes|said|says|asked|replied|emailed|texted|complained|told|answered|insisted|apologi[sz]ed|thanked|"
    r"ligou|telefonou|escreveu|disse|pediu|respondeu|reclamou|avisou|contou|agradeceu|assinou|da goi|"
    r"đã (?:gọi|viết|nói|hỏi|trả lời|phàn nàn|ký|báo|yêu cầu))|"
    r"(?:from (?:the|our|your) (?:\w+ ){0,2}(?:shift|team|office|desk|department|warehouse|store|branch))|"
    r"(?P<there>d[aoe] (?:turno|equipe|time|loja|escritório|setor|filial)|(?:ở|thuộc|bên) (?:ca|đội|phòng|kho|cửa hàng|chi nhánh)))(?![\w])"
)
#: Words that no name has; a run in small letters is no name with one of them.
_ORDINARY = frozenset(
    "the a an my our your his her their this that these those he she they we you it i who what which one some any every all no not and or but if when then so as at by for from in of on to with than "
    "customer customers buyer seller courier driver neighbour neighbor friend manager agent clerk support service team someone somebody everyone nobody shop store office warehouse company people man woman "
    "o os as um uma meu minha nosso nossa seu sua ele ela eles elas nós você quem que cliente clientes comprador vendedor entregador motorista vizinho vizinha amigo amiga gerente equipe suporte loja alguém ninguém empresa quando mas já não e ou se "
    "tôi bạn anh chị ông bà cô chú họ khách hàng người mua bán giao shipper tài xế hàng xóm quản lý đội nhân viên cửa kho công ty ai khi nhưng và đã không có là".split()
)

#: Which of the contexts is the signature, and which begin with a title.
_SIGNATURE, _TITLED_CONTEXTS = 8, (9, 10)
#: Lower-case marks without which a detector cannot match: one automaton finds them all in one pass over the text.
_AT_MARK, _AT_WORD, _OPEN_MARK, _DOT_MARK, _SPELLED_MARK, _ID_MARK, _MET_MARK, _DEED_MARK, _TITLE_MARK = (1 << i for i in range(9))
_FREE = 9
_ADDRESS_MARKS = [
    ("rua", "r.", "avenida", "av.", "alameda", "al.", "travessa", "trav.", "tv.", "praça", "praca", "pça.", "pca.", "estrada", "estr.", "rodovia", "rod.", "largo", "calle", "carrera", "via", "viale", "piazza", "plaza"),
    ("street", " st", "avenue", " ave", "road", " rd", "lane", " ln", "drive", " dr", "court", " ct", "boulevard", "blvd", "terrace", "crescent", "close", "way", "place", "row", "grove", "mews"),
    ("đường", "phố", "ngõ", "ngách", "hẻm", " duong", " pho", " ngo", " ngach", " hem"),
    (" rue", " avenue", " boulevard", " quai", " impasse", " chemin"),
    ("straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "ufer", "damm"),
    ("đường", "phố", "ngõ", "hẻm"),
]
_NAME_MARKS = [
    ("nome=", "name=", "tên=", "ten="),
    ('"comprador', '"buyer', '"nguoi_mua', '"nome', '"name', '"cliente', '"customer', '"ten'),
    ("comprador (", "compradora (", "buyer (", "người mua (", "nguoi mua ("),
    ("meu nome ", "me chamo", "my name is", "tôi tên là", "toi ten la"),
    ("recebeu foi", "nhận là", "nhan la", "received by"),
    ("ficha:", "contact card:", "liên hệ:", "lien he:", "contato:", "contact:"),
    ("emitida para", "ghi cho", "issued to"),
    ("registered under",),
    ("att", "atenciosamente", "abraços", "signed", "regards", "sincerely", "best", "trân trọng", "tran trong"),
    (),
    (),
]
_ADDRESS_BITS = [1 << (_FREE + i) for i in range(len(_ADDRESS_MARKS))]
_NAME_BITS = [1 << (_FREE + len(_ADDRESS_MARKS) + i) for i in range(len(_NAME_MARKS))]
#: Marks that may stand anywhere, marks behind which no letter may follow, and marks at which a detector begins.
_ANYWHERE = [
    (_AT_MARK, (" @ ", "arroba", "aroba", "a còng", "a cong")),
    (_OPEN_MARK, ("[", "(", "{", "<")),
    *((bit, marks) for i, (bit, marks) in enumerate(zip(_NAME_BITS, _NAME_MARKS)) if i not in (_SIGNATURE, 9, 10)),
]
_ENDED = [
    (_DOT_MARK, ("dot", "ponto", "chấm", "cham", "punto", "point")),
    *zip(_ADDRESS_BITS, _ADDRESS_MARKS),
    (_NAME_BITS[_SIGNATURE], _NAME_MARKS[_SIGNATURE]),
]
_PLACED = [
    (_SPELLED_MARK, tuple(_DIGITS)),
    (_AT_WORD, ("at",)),
    (_ID_MARK, ("cpf", "cnpj", "rg", "ssn", "cccd", "cmnd", "doc", "documento", "document", "id", "registered under", "số giấy tờ", "giấy tờ", "căn cước", "căn cước công dân", "chứng minh nhân dân", "identidade", "passport", "passaporte", "hộ chiếu")),
    (_MET_MARK, tuple("spoke spoken talked talk speak met meeting emailed phoned dear attn attention thanks ask asked falei conversei falar encontrei prezado prezada caro cara aos em obrigado obrigada gặp gửi thay kính".split()) + ("on behalf", "nói chuyện")),
    (_TITLE_MARK, tuple("mr mrs ms miss dr prof sr sra srta dra dona seu chị anh ông bà cô chú chi ong".split()) + ("a sr", "o sr", "a sra", "o sra", "a srta", "o srta")),
    (_DEED_MARK, tuple(" " + w for w in "called phoned rang wrote writes said says asked replied emailed texted complained told answered insisted apologised apologized thanked ligou telefonou escreveu disse pediu respondeu reclamou avisou contou agradeceu assinou đã".split()) + (" da goi", " from the", " from our", " from your"))
]
_PLACED.append((_DEED_MARK, tuple(f" {d} {w}" for d in ("da", "do", "de") for w in "turno equipe time loja escritório setor filial".split()) + tuple(f" {d} {w}" for d in ("ở", "thuộc", "bên") for w in ("ca", "đội", "phòng", "kho", "cửa hàng", "chi nhánh"))))


@lru_cache(maxsize=1)
def _automaton():
    """All marks with (length, bits anywhere, bits if no letter follows, bits at whose place a detector begins)."""
    import ahocorasick

    bits: dict[str, list[int]] = {}
    for at, listed in enumerate((_ANYWHERE, _ENDED, _PLACED)):
        for bit, marks in listed:
            for mark in marks:
                bits.setdefault(mark, [0, 0, 0])[at] |= bit
    found = ahocorasick.Automaton()
    for mark, (anywhere, ended, placed) in bits.items():
        found.add_word(mark, (len(mark), anywhere, ended, placed))
    found.make_automaton()
    return found


def _marked(low: str) -> tuple[int, list[tuple[int, int]]]:
    """The detectors whose marks stand in a lower-case text, as bits, and the places where one begins."""
    mask, places = 0, []
    for end, (length, anywhere, ended, placed) in _automaton().iter(low):
        mask |= anywhere
        if ended | placed and not low[end + 1 : end + 2].isalpha():
            mask |= ended
            if placed:
                begin = end - length + 1
                if low[begin] == " " or not begin or not low[begin - 1].isalnum():
                    places.append((begin, placed))
    return mask, places


#: Where a number long enough for an identifier or a phone stands, and what may belong to it.
_NUMERIC = re.compile(r"[+(\d][\d .()/+\-]{5,}[\dXx]|[A-Z]{2}\d{6}")
_PARTICLES = {"de", "da", "do", "dos", "das", "di", "e", "van", "von"}
_TITLES = {"ms", "mrs", "mr", "miss", "dr", "chị", "anh", "ông", "bà"}
_OPENERS = {"ms", "mrs", "mr", "miss", "dr", "sra", "sr", "srta", "chị", "anh", "a", "o"}
_NOT_NAMES = {"the", "o", "a", "os", "as", "de", "i", "your", "our", "equipe", "team", "đội", "support", "suporte"}


_SIGNED = re.compile(r"(?i:(?<!\w)(?:att|atenciosamente|abraços|signed|regards|sincerely|best|trân trọng|tran trong)\.?, *)")


#: Where a sentence, or a field, ends before a name.
_BREAK = re.compile(r"\n|[!?;:]|(?<=[^\W\d_]{2})[.] |(?<=\d)[.] |[.] {2,}|\"|[})\]] ")
_NAME_WORD = re.compile(rf"{_PART},?")
#: Words that a name may have, initials and particles included, and characters that they may take.
_MOST_WORDS, _MOST_CHARS = 12, 240


def _like_name(words: list[str], small: bool = False) -> bool:
    """Whether a run of words is written as a name: all with capitals, or all small; no digit, none an ordinary word."""
    telling = [w.rstrip(".,") for w in words if w.lower() not in _PARTICLES]
    if any(w.lower() in _ORDINARY for w in telling if len(w) > 1) or any(c.isdigit() for w in words for c in w):
        return False
    return all(w[0].isupper() for w in telling) or (small and all(w.islower() for w in telling))


def _name_before(text: str, end: int, small: bool) -> tuple[int, int] | None:
    """The full name that ends just before ``end`` and opens its sentence."""
    line = _BREAK.split(text[max(0, end - _MOST_CHARS) : end])[-1]
    signed = None
    for signed in _SIGNED.finditer(line):
        pass
    if signed:
        line = line[signed.end() :]
    words = list(re.finditer(r"\S+", line))
    start = len(words)
    while start > 0 and len(words) - start < _MOST_WORDS:
        w = words[start - 1].group()
        if not _NAME_WORD.fullmatch(w) or (w.endswith(",") and start == len(words)):
            break
        start -= 1
    while start < len(words) and words[start].group().lower().rstrip(".,") in _OPENERS:
        start += 1
    if signed and len(words) - start >= 4:
        # The signature's own name stands before this one, with nothing between them.
        start = len(words) - (len(words) - start) // 2
    if start == len(words) or not _like_name([w.group() for w in words[start:]], small):
        return None
    base = end - len(line)
    return _trim_name(text, base + words[start].start(), base + len(line.rstrip()), False)


def _trim_name(text: str, begin: int, end: int, signature: bool) -> tuple[int, int] | None:
    """Cut a name's run where the sentence goes on; None if no full name is left."""
    words = [(m.start() + begin, m.end() + begin, m.group()) for m in re.finditer(_PART, text[begin:end])]
    comma = text.find(",", begin, end)
    if comma >= 0:
        # Surname first: one word, the comma, the rest.  After two words or more a comma ends the name.
        if sum(b <= comma for _, b, _ in words) > 1:
            words = [w for w in words if w[1] <= comma]
        else:
            second = text.find(",", comma + 1, end)
            words = [w for w in words if second < 0 or w[1] <= second]
    kept = []
    for i, (a, b, w) in enumerate(words):
        if i and w.lower() in _STOP and w.islower() and w.lower() not in ("da",):
            break
        if kept and ("\n" in text[kept[-1][1] : a] or len(kept) > 1 and w.lower().rstrip(".") in _TITLES):
            break
        kept.append((a, b, w))
    if signature:
        while kept and kept[-1][2].lower() in _PARTICLES:
            kept.pop()
    if signature and len(kept) > 2:
        # The next sentence may begin right behind.  A name is written in one case: stop where it changes.
        first = kept[0][2]
        if first.islower():
            stop = next((i for i, (_, _, w) in enumerate(kept) if not w.islower()), len(kept))
        elif first.isupper() and len(first) > 2:
            stop = next((i for i, (_, _, w) in enumerate(kept) if not w.isupper()), len(kept))
        else:
            stop = next((i - 1 for i, (_, _, w) in enumerate(kept) if i > 1 and w[0].islower() and w not in _PARTICLES), len(kept))
            if stop == len(kept) and re.match(r" +(?:[^\W\d_]*\d|[+(=:]|[^\W\d_])|[:=]", text[kept[-1][1] :]):
                stop -= 1
        kept = kept[: max(2, stop)]
    while kept and kept[-1][2].lower() in _PARTICLES:
        kept.pop()
    full = [w for _, _, w in kept if w.lower() not in _PARTICLES and not (len(w) == 2 and w.endswith("."))]
    if len(full) < 2 or full[0].lower() in _NOT_NAMES:
        return None
    return kept[0][0], kept[-1][1]


def spans(source: str | None) -> list[tuple[str, int, int]]:
    """(type, begin, end) of all personal information of a text, in order of place."""
    if not source:
        return []
    plain = plain_form(source)
    text = plain.text
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []  # disjoint and in order

    def free(a: int, b: int) -> bool:
        at = bisect_left(taken, (a, b))
        return (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b)

    def take(a: int, b: int, kind: str) -> None:
        insort(taken, (a, b))
        found.append((a, b, kind))

    marks = plain.marks
    # Where lower-casing changes the length, places in it are none in the text.
    places = plain.places if len(plain.low) == len(text) else [(i, -1) for i in range(len(text))]

    def met(bit: int, pattern):
        """Matches at the places where a mark of the detector stands."""
        return (m for at, placed in places if placed & bit and (m := pattern.match(text, at)))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            take(m.start(), m.end(), "email")
    for m in met(_ID_MARK, _ID_LABELLED):
        value = m.group(1).rstrip(" .-/")
        if 7 <= sum(c.isdigit() for c in value) <= 14 and free(m.start(1), m.start(1) + len(value)):
            take(m.start(1), m.start(1) + len(value), "id_number")
    windows = [w.span() for w in _NUMERIC.finditer(text)]
    for pattern, kind in ((_ID_SHAPE, "id_number"), (_PHONE, "phone")):
        for begin, end in windows:
            for m in pattern.finditer(text, begin, end + 20):
                if m.start() < end and free(m.start(), m.end()) and not _CODE_BEFORE.search(text, max(0, m.start() - 40), m.start()):
                    take(m.start(), m.end(), kind)
    for pattern, bit in zip(_ADDRESS, _ADDRESS_BITS):
        if marks & bit:
            for m in pattern.finditer(text):
                if free(m.start(), m.end()):
                    take(m.start(), m.end(), "address")

    def named(n: int) -> None:
        if n in _TITLED_CONTEXTS or marks & _NAME_BITS[n]:
            for m in met(_TITLE_MARK, _NAMED[n]) if n in _TITLED_CONTEXTS else _NAMED[n].finditer(text):
                end = m.end(1)
                if n == _SIGNATURE:  # what is known behind it is no part of it
                    after = bisect_left(taken, (m.start(1), 0))
                    end = min(end, taken[after][0]) if after < len(taken) else end
                span = _trim_name(text, m.start(1), end, n == _SIGNATURE)
                if span and free(*span):
                    take(*span, "name")

    for n in range(len(_NAMED)):
        if n != _SIGNATURE:
            named(n)
    for bit, pattern in ((_DEED_MARK, _DEEDS), (_TITLE_MARK, _TITLED), (_MET_MARK, _MET)):
        for m in met(bit, pattern):
            if bit == _DEED_MARK:
                span = _name_before(text, m.start(), m["there"] is None)
            else:
                span = _trim_name(text, m.start("name"), m.end("name"), False)
                span = span if span and _like_name(text[span[0] : span[1]].split()) else None
            if span and free(*span):
                take(*span, "name")
    # A signature ends where nothing marks it, so it comes last and yields to every other span.
    named(_SIGNATURE)
    placed = [(kind, a, b) if plain.at is None else (kind, plain.place(a), _source_end(plain, b)) for a, b, kind in found]
    return sorted(placed, key=lambda s: s[1:])


def _source_end(plain: Plain, b: int) -> int:
    """Source place just behind a plain span: before the next character's place, without blanks."""
    return plain.at[b] if b < len(plain.at) and plain.at[b] > plain.at[b - 1] else plain.at[b - 1] + 1


def redact(source: str | None) -> str | None:
    """The text with every span replaced by its typed placeholder."""
    if not source:
        return source
    out, done = [], 0
    for kind, begin, end in sorted(spans(source), key=lambda s: s[1:]):
        if begin >= done:
            out += [source[done:begin], f"<{kind.upper()}>"]
            done = end
    return "".join(out) + source[done:]


def find(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row (key, pii_type, start_char, end_char) per occurrence."""

    schema = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("pii_type", T.StringType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *span) for i, t in enumerate(batch.column(1).to_pylist()) for span in spans(t)]
            if rows:
                at, kind, begin, end = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(kind), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], schema=arrow)

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL AND t != ''").mapInArrow(run, schema).withColumnRenamed("k", key)


@F.pandas_udf(T.StringType())
def _redact_udf(values: pd.Series) -> pd.Series:
    return values.map(redact, na_action="ignore").astype(object).where(values.notna(), None)


def redacted(column: Column) -> Column:
    """Column with typed placeholders in place of personal information."""
    return _redact_udf(column)
