"""What a record asks, in three views of its SQL and its question.

``sql``: the query's tokens.  Comments, case, layout and output names go, aliases
become their tables, conditions are put in a plain form and in order; everything
else stays as it was written, tables, join conditions and operators included.  ``sql_clauses`` says
what is asked exactly, with equal expressions in one form, and decides between
near token lists.

``words``: the question's words, folded and spelled alike.  Numbers must agree,
and so must every slot that was read on both sides.

``facts``: metric, filters and grouping as a fixed reading of the questions'
domain has them.  It is the only view in which two languages, or a question and a
query, can meet, and it is used only where everything was understood: a query with
any other table, join or filter, or a question with a needed slot unread, has none.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import regex

from marlgrid.llm.unify import unify

# The state codes, months and cue words of the questions' domain.
STATES = frozenset("ac al am ap ba ce df es go ma mg ms mt pa pb pe pi pr rj rn ro rr rs sc se sp to".split())
MONTHS = {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}
METRICS = {
    "orders": [{"number", "orders"}, {"dem", "so"}, {"luong", "don"}],
    "buyers": [{"buyers"}, {"nguoi", "mua"}],
    "sellers": [{"sellers", "shipped"}, {"nguoi", "ban", "gui"}],
    "revenue": [{"product", "revenue"}, {"doanh", "thu"}],
    "freight": [{"freight", "total"}, {"tong", "phi"}],
    "mean": [{"mean", "item", "price"}, {"gia", "trung", "binh"}],
    "dearest": [{"dearest"}, {"dat", "nhat"}],
}
STATUSES = {"delivered": [{"delivered"}, {"giao"}], "canceled": [{"canceled"}, {"cancelled"}, {"huy"}], "shipped": [{"way"}, {"van", "chuyen"}]}
O, I, P, C, S = "olist_orders_dataset", "olist_order_items_dataset", "olist_products_dataset", "olist_customers_dataset", "olist_sellers_dataset"
#: Joins along the keys of the domain, and the tables that every one of its queries reads.
JOINS = {f"{I}.order_id={O}.order_id", f"{I}.product_id={P}.product_id", f"{C}.customer_id={O}.customer_id", f"{I}.seller_id={S}.seller_id"}
READ = {O, I, P, C}
SELECTED = {
    "count(*)": "orders",
    f"count(distinct {C}.customer_unique_id)": "buyers",
    f"count(distinct {I}.seller_id)": "sellers",
    f"sum({I}.price_cents)": "revenue",
    f"sum({I}.freight_value_cents)": "freight",
    f"round(avg({I}.price_cents),2)": "mean",
    f"max({I}.price_cents)": "dearest",
}
FILTERED = [
    (re.compile(rf"{O}\.order_status='(.*)'"), "status={}"),
    (re.compile(rf"{P}\.product_category_name='(.*)'"), "category={}"),
    (re.compile(rf"{C}\.customer_state='(.*)'"), "state={}"),
    (re.compile(rf"substr\({O}\.order_purchase_timestamp,1,7\)='(.*)'"), "month={}"),
    (re.compile(rf"{I}\.freight_value_cents\+{I}\.price_cents>(\d+)"), "total>{}"),
    (re.compile(rf"{I}\.freight_value_cents<(\d+)"), "freight<{}"),
    (re.compile(rf"{I}\.price_cents>(\d+)"), "price>{}"),
    (re.compile(rf"{P}\.product_weight_g>=(\d+)"), "weight>={}"),
]
#: Slots that every question of the domain has; the others are absent where nothing is asked.
NEEDED = ("metric", "month", "category", "state", "limit")

# -- queries ----------------------------------------------------------------------------------

_TOKEN = re.compile(r"'(?:[^']|'')*'|[^\W\d]\w*|\d+(?:\.\d+)?|<=|>=|<>|!=|\|\||[^\s\w]")
_HEADS = {"select": 1, "from": 1, "where": 1, "group": 2, "having": 1, "order": 2, "limit": 1}
_JOIN_WORDS = {"join", "inner", "left", "right", "full", "outer", "cross", "on", "as", ","}
_LITERAL = re.compile(r"'(?:[^']|'')*'|-?\d+(?:\.\d+)?")
_COMPARED = re.compile(r"'(?:[^']|'')*'|(?<![\w.,'(#])\d+(?:\.\d+)?")
_NAME = re.compile(r"[^\W\d]\w*")
_FLIPPED = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "=", "!=": "!="}


def sql_tokens(sql: str) -> list[str]:
    """Tokens without comments and the closing semicolon, in lower case outside quotes."""
    text = re.sub(r"('(?:[^']|'')*')|--[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", unify(sql), flags=re.S)
    found = [t if t[0] == "'" else t.lower() for t in _TOKEN.findall(text)]
    while found and found[-1] == ";":
        found.pop()
    return ["!=" if t == "<>" else t for t in found]


def _clauses(tokens: list[str]) -> dict[str, list[str]] | None:
    """The clauses of one plain SELECT; None for any other statement."""
    parts: dict[str, list[str]] = {}
    current, depth, i = None, 0, 0
    while i < len(tokens):
        if not depth:
            words_of_head = _HEADS.get(tokens[i], 0)
            if words_of_head and (words_of_head == 1 or tokens[i + 1 : i + 2] == ["by"]):
                current = tokens[i]
                if current in parts or (not parts and current != "select"):
                    return None
                parts[current] = []
                i += words_of_head
                continue
            if current is None or tokens[i] in ("union", "intersect", "except"):
                return None
        depth += (tokens[i] == "(") - (tokens[i] == ")")
        parts[current].append(tokens[i])
        i += 1
    return parts if "select" in parts and "from" in parts else None


def _split(tokens: list[str], at: str) -> list[list[str]]:
    """Pieces between a token outside brackets; the AND of a BETWEEN is none."""
    pieces, depth, between = [[]], 0, 0
    for t in tokens:
        depth += (t == "(") - (t == ")")
        if not depth and t == "between":
            between += 1
        if not depth and t == at and not (at == "and" and between):
            pieces.append([])
            continue
        if not depth and t == "and" and between:
            between -= 1
        pieces[-1].append(t)
    return [p for p in pieces if p]


def _sources(tokens: list[str]) -> tuple[dict[str, str], list[tuple[str, str, list[str]]]] | None:
    """Alias -> table, and (kind, table, join condition) of every relation; None for derived tables."""
    names, out, seen, kind, i = {}, [], Counter(), "join", 0
    while i < len(tokens):
        t = tokens[i]
        if t in ("inner", "join", "outer", ",", "as"):
            i += 1
            continue
        if t in ("left", "right", "full", "cross", "natural"):
            kind, i = f"{t} join", i + 1
            continue
        if t == "on":
            stop, depth = i + 1, 0
            while stop < len(tokens) and (depth or tokens[stop] not in ("join", "inner", "left", "right", "full", "cross", "natural", ",")):
                depth += (tokens[stop] == "(") - (tokens[stop] == ")")
                stop += 1
            if not out:
                return None
            out[-1] = (*out[-1][:2], tokens[i + 1 : stop])
            i = stop
            continue
        if not _NAME.fullmatch(t) or t == "using":
            return None
        seen[t] += 1
        table = t if seen[t] == 1 else f"{t}#{seen[t]}"
        out.append((kind, table, []))
        kind, i = "join", i + 1
        if i < len(tokens) and tokens[i] == "as":
            i += 1
        if i < len(tokens) and tokens[i] not in _JOIN_WORDS | {"using", "natural"} and _NAME.fullmatch(tokens[i]):
            names[tokens[i]] = table
            i += 1
        names.setdefault(t, table)
    return names, out


def _lent(tokens: list[str], names: dict[str, str]) -> dict[str, str]:
    """The names, with the one unknown qualifier given to the one relation that no qualifier means."""
    used = {a for a, dot in zip(tokens, tokens[1:]) if dot == "." and _NAME.fullmatch(a)}
    unknown, idle = used - set(names), set(names.values()) - {names[u] for u in used & set(names)}
    return {**names, unknown.pop(): idle.pop()} if len(unknown) == 1 and len(idle) == 1 else names


def _qualified(tokens: list[str], names: dict[str, str]) -> list[str]:
    """Columns as table.column; with one table the table goes without saying."""
    out, i = [], 0
    alone = len(set(names.values())) == 1
    while i < len(tokens):
        if i + 2 < len(tokens) and tokens[i + 1] == "." and tokens[i] in names:
            out.append(tokens[i + 2] if alone else f"{names[tokens[i]]}.{tokens[i + 2]}")
            i += 3
        else:
            out.append(tokens[i])
            i += 1
    return out


def _unnamed(item: list[str]) -> list[str]:
    return item[:-2] if len(item) > 2 and item[-2] == "as" else item


def _text(tokens: list[str]) -> str:
    """Tokens as one text: blanks only between words."""
    return re.sub(r" ?([=<>!(),+*/.|-]+) ?", r"\1", " ".join(tokens))


def _expression(tokens: list[str]) -> str:
    return tokens[0] if len(tokens) == 1 else _written(tuple(tokens))


@lru_cache(maxsize=20_000)
def _written(tokens: tuple[str, ...]) -> str:
    text = _text(tokens).replace("count(1)", "count(*)")
    text = re.sub(r"1\.0\*sum\(([\w.#]+)\)/count\(\1\)", r"avg(\1)", text)
    if "'" not in text and re.fullmatch(r"[\w.#]+(?:\+[\w.#]+)+", text):
        text = "+".join(sorted(text.split("+")))
    return text


def _conjunct(tokens: list[str]) -> list[str]:
    """One condition in its plain form; BETWEEN gives two."""
    return _condition(tuple(tokens))


@lru_cache(maxsize=20_000)
def _condition(tokens: tuple[str, ...]) -> list[str]:
    depth = 0
    for i, t in enumerate(tokens):
        depth += (t == "(") - (t == ")")
        if depth:
            continue
        if t == "between" and "and" in tokens[i:]:
            stop = len(tokens) - 1 - tokens[::-1].index("and")
            if tokens[i - 1 : i] != ("not",):
                left = _expression(tokens[:i])
                return [f"{left}>={_expression(tokens[i + 1 : stop])}", f"{left}<={_expression(tokens[stop + 1 :])}"]
        if t == "like" and tokens[i - 1 : i] != ("not",) and len(tokens) == i + 2:
            m = re.fullmatch(r"'([^%_']+)%'", tokens[i + 1])
            if m:
                return [f"substr({_expression(tokens[:i])},1,{len(m[1])})='{m[1]}'"]
        if t in _FLIPPED:
            left, right = _expression(tokens[:i]), _expression(tokens[i + 1 :])
            fixed = bool(_LITERAL.fullmatch(left)), bool(_LITERAL.fullmatch(right))
            turn = fixed == (True, False) or (t in ("=", "!=") and fixed[0] == fixed[1] and left > right)
            return [f"{right}{_FLIPPED[t]}{left}" if turn else f"{left}{t}{right}"]
    return [_expression(tokens)]


class Query:
    """A query's tokens for shingling, its clauses, and the literals that must agree."""

    def __init__(self, sql: str):
        found = sql_tokens(sql)
        parts = _clauses(found)
        read = _sources(parts["from"]) if parts else None
        self.select, self.group, self.tables, self.conjuncts = [], [], set(), set()
        if read is None:
            self.plain, self.tokens, self.clauses = False, found, ("statement " + " ".join(found),)
        else:
            self._plain(parts, *read)
        self.marks = " ".join(sorted(_COMPARED.findall(" ".join(self.clauses))))

    def _plain(self, parts: dict, names: dict, sources: list) -> None:
        self.plain = True
        names = _lent([t for v in parts.values() for t in v], names)
        parts = {k: _qualified(v, names) for k, v in parts.items() if k != "from"}
        self.select = sorted(_expression(_unnamed(x)) for x in _split(parts["select"], ","))
        self.group = [_expression(x) for x in _split(parts.get("group", []), ",")]
        self.tables = {t for _, t, _ in sources}
        order = [_expression([w for w in x if w != "asc"]) for x in _split(parts.get("order", []), ",")]
        conditions, outer, written = [], [], []
        for kind, table, on in sources:
            on = _split(_qualified(on, names), "and")
            written += [[kind, table, "on", *c] for c in on] or [[kind, table]]
            if kind == "join":
                conditions += on
            else:
                outer.append(f"{kind} {table} on {' and '.join(sorted(x for c in on for x in _conjunct(c)))}")
        where = parts.get("where", [])
        ored = len(_split(where, "or")) > 1
        pieces = [where] if ored else _split(where, "and")
        self.conjuncts = {x for c in conditions for x in _conjunct(c)} | ({"(" + _text(where) + ")"} if ored else {x for c in pieces for x in _conjunct(c)})
        clauses = ["select " + x for x in self.select if x not in self.group] + ["by " + g for g in self.group] + ["from " + t for t in self.tables] + sorted(outer)
        clauses += ["where " + c for c in self.conjuncts] + ["having " + x for c in _split(parts.get("having", []), "and") for x in _conjunct(c)]
        if order and order != self.group:
            clauses.append("order " + ",".join(order))
        if parts.get("limit"):
            clauses.append("limit " + _text(parts["limit"]))
        self.clauses = tuple(sorted(set(clauses)))
        self.other = bool(outer or ored or parts.get("having") or parts.get("limit") or (order and order != self.group))
        # What is shingled: as written, but for conditions in their plain form and a fixed order.
        tail = [t for k in ("having", "order", "limit") if k in parts for t in (k, *parts[k])]
        said = [_text(where)] if ored else sorted(x for c in pieces for x in _conjunct(c))
        body = [t for c in said for t in ("and", *_TOKEN.findall(c))]
        self.tokens = ["select", *(t for x in _split(parts["select"], ",") for t in (*_unnamed(x), ",")), "from", *(t for w in sorted(written, key=lambda w: w[1]) for t in w), "where", *body, *(("by", *parts["group"]) if self.group else ()), *tail]

    def facts(self) -> tuple[str, ...] | None:
        """The domain's facts; None unless every clause is one of the domain's."""
        if not self.plain or self.other:
            return None
        metrics = [x for x in self.select if x not in self.group]
        grouped = self.group == [f"{S}.seller_state"]
        if len(metrics) != 1 or metrics[0] not in SELECTED or (self.group and not grouped) or self.tables != (READ | {S} if grouped else READ):
            return None
        facts = ["metric=" + SELECTED[metrics[0]]] + (["by seller_state"] if grouped else [])
        joined = set()
        for c in self.conjuncts:
            if c in JOINS:
                joined.add(c)
                continue
            found = next((form.format(m[1].lower()) for pattern, form in FILTERED if (m := pattern.fullmatch(c))), None)
            if found is None:
                return None
            facts.append(found)
        if len(joined) != len(self.tables) - 1 or not all(any(f.startswith(k) for f in facts) for k in ("month=", "category=", "state=")):
            return None
        return tuple(sorted(facts)) if sum(f.split("=")[0].split(">")[0].split("<")[0] in ("total", "freight", "price", "weight") for f in facts) == 1 else None


def query(sql: str | None) -> Query | None:
    """A record's query; None for none."""
    return Query(sql) if sql is not None and sql.strip() else None


def digest(parts) -> str:
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


# -- questions --------------------------------------------------------------------------------

_GROUPED = re.compile(r"(?<![\d.,])(\d{1,3})((?:[ ,. ]\d{3})+)(?![\d])")


#: Combining marks.
_MARK = regex.compile(r"\p{M}+")


def words(question: str | None) -> list[str]:
    """Folded words and numbers of a question; digit groups make one number."""
    if question is None:
        return []
    text = unify(question).casefold()
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFD", text.replace("đ", "d").replace("¢", " cents ")))
    text = text.replace("_", " ")
    text = _GROUPED.sub(lambda m: m[1] + re.sub(r"\D", "", m[2]), text)
    return re.findall(r"\d+|[^\W\d]+", text)


def _cue(found: set[str], table: dict[str, list[set[str]]]) -> str | None:
    """The label whose cue words all stand there; the one with most cues, of two."""
    hits = [(len(cues), label) for label, sets in table.items() for cues in sets if cues <= found]
    return max(hits, key=lambda x: x[0])[1] if hits else None


def slots(read: list[str]) -> dict[str, str]:
    """Slots found in a question's words; "status" and "by" are there always, empty for none."""
    text = " ".join(read)
    month = None
    m = re.search(r"\b(" + "|".join(MONTHS) + r") (\d{4})\b", text)
    if m:
        month = f"{m[2]}-{MONTHS[m[1]]:02d}"
    else:
        m = re.search(r"\bthang (\d{1,2}) (?:[a-z]+ )?(\d{4})\b", text) or re.search(r"\b(\d{1,2}) nam (\d{4})\b", text)
        if m:
            month = f"{m[2]}-{int(m[1]):02d}"
    rest = text[: m.start()] + " " + text[m.end() :] if m else text
    category = re.search(r"\b(?:the )?([a-z]+ [a-z]+) category\b", rest) or re.search(r"\bdanh muc ([a-z]+ [a-z]+)\b", rest) or re.search(r"\b(?:danh|muc) ([a-z]+ [a-z]+)\b(?= (?:cua|mua|co|ton))", rest)
    state = re.search(r"\bcustomers (?:[a-z]{1,4} )?(" + "|".join(STATES) + r")\b", rest) or re.search(r"\bbang (" + "|".join(STATES) + r")\b", rest) or re.search(r"\bo [a-z]{2,6} (" + "|".join(STATES) + r")\b", rest)
    numbers = re.findall(r"\d+", rest)
    around = set(rest.split())
    limit = None
    if len(numbers) == 1:
        if around & {"grams", "gam", "least", "nang"}:
            limit = f"weight>={numbers[0]}"
        elif around & {"below", "under", "duoi"}:
            limit = f"freight<{numbers[0]}"
        elif around & {"above", "tren"}:
            limit = f"price>{numbers[0]}"
        elif around & {"costing", "than", "hon", "ton"}:
            limit = f"total>{numbers[0]}"
    grouped = bool(re.search(r"seller state|bang nguoi ban", rest)) or bool(around & {"split", "chia"})
    # Neither the grouping's nor a filter's own words are cues for the metric or the status.
    opening = re.sub(r"\b(?:split|chia) .*$", " ", rest)
    bare = re.sub(r"\b(?:with freight below|freight below|phi van chuyen duoi|ke ca phi|with freight|san pham nang|product of|an item above|dang van chuyen)\b", " ", opening)
    metric = _cue(set(bare.split()), METRICS)
    status = _cue(set(re.sub(r"\bphi van chuyen\b", " ", opening).split()), STATUSES)
    found = {"metric": metric, "month": month, "category": category and category[1].replace(" ", "_"), "state": state and state[1], "limit": limit}
    return {k: v for k, v in found.items() if v} | {"status": status or "", "by": "seller_state" if grouped else ""}


def slot_facts(found: dict[str, str]) -> tuple[str, ...] | None:
    """The facts of a question whose needed slots were all found."""
    if not all(k in found for k in NEEDED):
        return None
    facts = [found["limit"], *(f"{k}={found[k]}" for k in ("metric", "month", "category", "state"))]
    if found["status"]:
        facts.append(f"status={found['status']}")
    if found["by"]:
        facts.append(f"by {found['by']}")
    return tuple(sorted(facts))


def number_marks(read: list[str]) -> str:
    return " ".join(sorted(w for w in read if w.isdigit()))
