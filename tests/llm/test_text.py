"""One form of text, value mapping, and personal information."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlgrid.llm import canonical, pii, unify


@pytest.mark.parametrize(
    "text, form, found",
    [
        ("são paulo", "são paulo", False),
        ("  SAO  paulo-d'oeste 12 ", "  SAO  paulo-d'oeste 12 ", False),
        ("ｓãｏ　ｊｏｓé", "são josé", True),
        ("são", "são", True),
        ("vil​a", "vila", True),
        ("рorto", "porto", True),
        ("campo belo", "campo belo", True),
        ("d’oeste", "d'oeste", True),
        ("soleﬁna", "solefina", True),
        ("ⅿonte", "monte", True),
        ("guас̧u", "guaçu", True),
        ("GATUCΆ", "GATUCÁ", True),
        ("𝗏𝗂𝗅𝖺", "vila", True),
        ("Большая Ягодица", "Большая Ягодица", False),
        ("Ζωφυλιά", "Ζωφυλιά", False),
        ("みどり坂", "みどり坂", False),
        ("み​どり坂", "みどり坂", True),
        ("حي الزيتون", "حي الزيتون", False),
        ("Øksnebygd Żółwiec Đồi", "Øksnebygd Żółwiec Đồi", False),
        ("", "", False),
    ],
)
def test_unify(text, form, found):
    assert unify.unify(text) == form
    assert unify.has_odd_character(text) == found


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcã ́̃​ ＡｂАсрⅿﬁ’‑Ωж坂é-'"), max_size=20))
def test_form_is_stable(text):
    once = unify.unify(text)
    assert unify.unify(once) == once and unicodedata.is_normalized("NFC", once)
    assert unify.has_odd_character(text) or once == text or not text.isascii()


def test_unify_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ｖila"), (4, "vila"), (5, "x" * 50_000 + "ｖ")], "id int, t string")
    got = {r.id: (r.u, r.o) for r in df.select("id", unify.unified(F.col("t")).alias("u"), unify.odd(F.col("t")).alias("o")).collect()}
    assert got[1][0] is None and not got[1][1]
    assert got[2] == ("", False) and got[3] == ("vila", True) and got[4] == ("vila", False) and got[5] == ("x" * 50_000 + "v", True)


def osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_distance():
    rng = random.Random(4)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert canonical.distance(a, b) == osa(a, b), (a, b)


REFERENCE = [(1, "são benedito do sul", "SP", False), (2, "são benedito do sul", "RJ", False), (3, "vila nova", "MG", False), (4, "barra de ouro", "GO", False), (4, "antiga mina", "GO", True), (5, None, "GO", False)]
TYPED = [
    ("SAO BENEDITO DO SUL", "RJ", 2), ("são benedito do sul", "BA", 1), ("Sao Beneditto do Sul - sp", "SP", 1), ("s. benedito sul", "SP", 1), ("saobeneditodosul", "SP", 1),
    ("ｖila　nova", "MG", 3), ("b. de ouro", None, 4), ("mun. barra de ouro (GO)", "GO", 4), ("antiga mina", "GO", 4), ("outra cidade qualquer", "SP", None), ("00000", "SP", None), ("みどり坂", "SP", None), ("?", None, None),
]


def test_mapping(spark):
    values = spark.createDataFrame([(v, c) for v, c, _ in TYPED] * 2 + [(None, "SP")], "value string, context string")
    reference = spark.createDataFrame(REFERENCE, "entry_id bigint, name string, context string, former boolean")
    got = {(r.value, r.context): r.entry_id for r in canonical.match_values(values, reference).collect()}
    assert got == {(v, c): e for v, c, e in TYPED}


def test_candidates_against_all_entries(spark):
    """Every name within the allowed edits is found, whatever its cosine: recall 1 against brute force."""
    rng = random.Random(11)
    names = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(2, 14))) for _ in range(400)})
    asked = set()
    for name in names[::3]:
        text = list(name)
        for _ in range(rng.randint(1, 3)):
            at, what = rng.randrange(len(text) + 1), rng.choice("isdt")
            if what == "i":
                text.insert(at, rng.choice("abcdef"))
            elif at < len(text) and what == "s":
                text[at] = rng.choice("abcdef")
            elif at < len(text) and len(text) > 2 and what == "d":
                del text[at]
            elif at + 1 < len(text):
                text[at], text[at + 1] = text[at + 1], text[at]
        asked.add("".join(text))
    frame = lambda texts: spark.createDataFrame([(t, t) for t in sorted(texts)], "form string, whole string")
    got = {(r.form, r.name_form): (r.edits, r.cosine) for r in canonical.candidates(frame(asked), frame(names)).collect()}
    allowed = lambda t: 1 if len(t) <= 4 else 2 if len(t) <= 9 else 3
    want = {(a, n): d for a in asked for n in names if (d := osa(a, n)) <= allowed(a)}
    shared = {k for k in want if {f"^{k[0]}$"[i : i + 2] for i in range(len(k[0]) + 1)} & {f"^{k[1]}$"[i : i + 2] for i in range(len(k[1]) + 1)}}
    assert {k: v[0] for k, v in got.items()} == {k: want[k] for k in shared}, sorted(set(got) ^ shared)
    assert len(shared) > 200 and len(shared) >= 0.98 * len(want)
    assert all(0 < c <= 1 + 1e-9 for _, c in got.values())


def test_mapping_empty(spark):
    values = spark.createDataFrame([("vila", "MG")], "value string, context string")
    none = spark.createDataFrame([], "entry_id bigint, name string, context string, former boolean")
    assert canonical.match_values(values, none).first().entry_id is None
    assert canonical.match_values(values.limit(0), none).count() == 0


CASES = [
    ("Meu nome é Ana Souza e meu telefone é (11) 93715-0576.", [("name", "Ana Souza"), ("phone", "(11) 93715-0576")]),
    ("Please write to ana-souza+x [at] mail [dot] example [dot] org instead.", [("email", "ana-souza+x [at] mail [dot] example [dot] org")]),
    ("cc: a.b＠x.example, c_d @ y.test", [("email", "a.b＠x.example"), ("email", "c_d @ y.test")]),
    ("x (arroba) correio (ponto) test", [("email", "x (arroba) correio (ponto) test")]),
    ("CPF do titular: 123.456.789-09.", [("id_number", "123.456.789-09")]),
    ("nome=Souza, Ana|doc=12.345.678-X", [("name", "Souza, Ana"), ("id_number", "12.345.678-X")]),
    ("Registered under 666 53 1177 for Jarek O'Neil.", [("id_number", "666 53 1177"), ("name", "Jarek O'Neil")]),
    ("Entregar em Rua das Flores, nº 12, fundos.", [("address", "Rua das Flores, nº 12")]),
    ("He moved from 2344 Mowick Avenue, Flat 14B to 7 Hill Close in spring.", [("address", "2344 Mowick Avenue, Flat 14B"), ("address", "7 Hill Close")]),
    ("Giao tới 532A đường Đồng Sim, phường 24, cửa sau.", [("address", "532A đường Đồng Sim, phường 24")]),
    ("Tôi tên là Lê Văn Tám, số điện thoại +84-124-384-5720.", [("name", "Lê Văn Tám"), ("phone", "+84-124-384-5720")]),
    ("Ms. ANA SOUZA called twice about it.", [("name", "ANA SOUZA")]),
    ("The lid broke. ana s. souza from the night shift took the parcel.", [("name", "ana s. souza")]),
    ("Tel five five five, one two three, four five six seven now", [("phone", "five five five, one two three, four five six seven")]),
    ("Trân trọng, Lê Văn Tám\nChị Bùi Thị Hoa đã gọi hai lần.", [("name", "Lê Văn Tám"), ("name", "Bùi Thị Hoa")]),
    ("Handle @toy_desk asked. Protocol 2022.852.058-43 closed. Tracking ZZ018766277QX, order 746b5c0b87d4, batch 20217528986, near -17.418391, -48.181831 on 12.7.2021.", []),
    ("Enviado para São Brujarim, GO; a nota chegou. Ficha: Ana; x", []),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_spans(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.spans(text)] == want


UNLABELLED = [
    ("On file 123-45-6789 and 987-65-4321.", [("id_number", "123-45-6789"), ("id_number", "987-65-4321")]),
    ("Shown: BC1234567, 001234567890, 012 345 678 901.", [("id_number", "BC1234567"), ("id_number", "001234567890"), ("id_number", "012 345 678 901")]),
    ("Căn cước công dân: 036123456789.", [("id_number", "036123456789")]),
    ("Gọi 0912345678, 0912 345 678 hay 091.234.5678.", [("phone", "0912345678"), ("phone", "0912 345 678"), ("phone", "091.234.5678")]),
    ("Zap 11 98765 4321 agora", [("phone", "11 98765 4321")]),
    ("Lot 123-45-6789, batch: BC1234567, protocolo 001234567890, tracking no. 0912345678, đơn 008332280509, on 08-12-2021 10.", []),
]


@pytest.mark.parametrize("text, want", UNLABELLED)
def test_spans_without_label(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.spans(text)] == want


GENERAL = [
    ("reach joao at gmail dot com, look at example.com", [("email", "joao at gmail dot com")]),
    ("or ana at mail dot example dot org.", [("email", "ana at mail dot example dot org")]),
    ("Ring 020 7946 0958 or 01632 960001.", [("phone", "020 7946 0958"), ("phone", "01632 960001")]),
    ("Tel one two three four five six seven now, one two three no", [("phone", "one two three four five six seven")]),
    ("Wohnt Hauptstrasse 5, spielt 3 mal; 12 rue Victor Hugo; Via Roma 10.", [("address", "Hauptstrasse 5"), ("address", "12 rue Victor Hugo"), ("address", "Via Roma 10")]),
    ("I spoke with Maria Silva about it.", [("name", "Maria Silva")]),
    ("John Smith from the day shift took it. Maria Silva phoned us again.", [("name", "John Smith"), ("name", "Maria Silva")]),
    ("Maria Aparecida da Silva dos Santos Lima ligou duas vezes.", [("name", "Maria Aparecida da Silva dos Santos Lima")]),
    ("Dear Ana Souza, Dr. Paul Meyer will write. Conversei com João Lima.", [("name", "Ana Souza"), ("name", "Paul Meyer"), ("name", "João Lima")]),
    ("The courier called. My old neighbour called twice. Customer Service replied. São Brujarim, GO. Order Summary arrived.", []),
    ("khách hàng đã gọi hai lần. o cliente ligou. nắp thay thế còn nằm ở kho.", []),
]


@pytest.mark.parametrize("text, want", GENERAL)
def test_spans_of_no_fixed_sentence(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.spans(text)] == want


def test_text_whose_lower_case_is_longer():
    text = "İ" * 5 + " CPF: 123.456.789-09. Ms. Ana Souza called."
    assert [(k, text[a:b]) for k, a, b in pii.spans(text)] == [("id_number", "123.456.789-09"), ("name", "Ana Souza")]


GATED = [
    ("write ana(  at  )x.com now", [("email", "ana(  at  )x.com")]),
    ("write ana@x{ . }com or bo@y<  dot  >org", [("email", "ana@x{ . }com"), ("email", "bo@y<  dot  >org")]),
    ("RG=1234567-8", [("id_number", "1234567-8")]),
    ("ID#123456789", [("id_number", "123456789")]),
]


@pytest.mark.parametrize("text, want", GATED)
def test_spans_with_rare_blanks_and_signs(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.spans(text)] == want


def test_offsets_behind_disguises():
    text = "Ａ👍 ​ok. Xin gửi về a​b (arroba) mail (ponto) example. 👍 Meu nome é Ａna Ѕouza e meu"
    got = pii.spans(text)
    assert [(k, text[a]) for k, a, _ in got] == [("email", "a"), ("name", "Ａ")]
    assert pii.redact(text).count("<EMAIL>") == 1 and "Xin gửi về <EMAIL>." in pii.redact(text) and "<NAME> e meu" in pii.redact(text)


def test_pii_columns(spark):
    long = "x " * 40_000 + "mail a@b.example"
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, long, "z"), (3, long, "z")], "doc bigint, text string, pii_type string")
    assert sorted((r.doc, r.pii_type, r.start_char) for r in pii.find(df, "doc", "text").collect()) == [(3, "email", 80_005)] * 2
    got = [r[0] for r in df.select(pii.redacted(F.col("text"))).collect()]
    assert got[0] is None and got[1] == "" and got[2].endswith("mail <EMAIL>")
    assert pii.find(df.limit(0), "doc", "text").count() == 0
