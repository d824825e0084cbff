"""Personal information: golden texts in six languages, checksums, round trips and edges."""

import json

import pytest

from gleanmark.llm import personal

FOUND = [
    ("Call me at +1 212 555 0190 after six.", {"phone"}),
    ("打我电话19900006904。", {"phone"}),
    ("我的身份证号990101198806013641被拍下来了。", {"id_number"}),
    ("Ruf mich unter (040) 66969-151 an.", {"phone"}),
    ("My mail is CEDAR.FAN76@BREVKASSE.TEST, please.", {"email"}),
    ("write to dornesco81 [at] postbox [dot] example [dot] com today", {"email"}),
    ("请发到cedarfox@postbox.example。", {"email"}),
    ("Send the parcel to 131 Old Mill Road, Brinac 99173.", {"address"}),
    ("Ich wohne Lindenhofweg 92 in Brinette, komm vorbei.", {"address"}),
    ("J’habite 113 bis, rue des Tamaris à Fenholt.", {"address"}),
    ("Vivo en Plaza del Molino 124, 5º B, 99759 Drastad.", {"address"}),
    ("Moro na Rua do Curtume, nº 117, Ostfield.", {"address"}),
    ("快递寄到石潭区河湾巷85号2单元1002室。", {"address"}),
    ("It was Nora Dornesco who sold me the bike.", {"name"}),
    ("Mein Nachbar Diego Haspbury sagt das auch.", {"name"}),
    ("Danke, Frau Ostenko", {"name"}),
    ("Thanks, Mr Tolstedt Our team cut the tree.", {"name"}),
    ("Gracias, Louis Pellovar El ayuntamiento evita la línea.", {"name"}),
    ("Meu número: (00) 90000-0370 A moça joga aqui.", {"phone"}),
    ("Mon numéro fiscal 9 59 13 99 483 923 80 figure dessus.", {"id_number"}),
    ("Mi número: 600000890 Mi DNI X0003418R se quedó allí.", {"phone", "id_number"}),
    ("型号为XB-3225。登记时填了990101197706165682这个证件号。", {"id_number"}),
    ("可以问邻居罗雨棠。", {"name"}),
    ("是吴星野卖给我的。", {"name"}),
    ("Pediram o meu CPF, 000.348.224-14.", {"id_number"}),
    ("My social security number 962-43-7645 is on the form.", {"id_number"}),
    ("Me pidieron el número fiscal, 00208252A.", {"id_number"}),
    ("Steuernummer L01X36T47 gehört mir.", {"id_number"}),
]
CLEAN = [
    "The ISBN on the cover ends in 555-765.",
    "See version 2.107.14 and ticket 2024-306.",
    "It cost $612.81, down from £515.27.",
    "现价691元，原价859元。",
    "Velbury Ltd opened a branch near Ulmlane Station.",
    "La société Fernique SARL a ouvert à Valmont.",
    "Die Velique GmbH hat in Lushaven eröffnet.",
    "@velvet.heron wrote the same yesterday.",
    "He lost a shoe. @moss.kettle disait pareil.",
    "El pedido TA-3070 llegó en 117 días.",
    "Der Koch läuft schnell.",
    "mail them via the form, no address given",
    "",
    None,
]


@pytest.mark.parametrize(("text", "kinds"), FOUND)
def test_found(text, kinds):
    assert {s.kind for s in personal.find(text)} == kinds


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert personal.find(text) == []
    assert personal.redact(text) == text


@pytest.mark.parametrize(
    ("author", "kinds"),
    [
        ("Greta Fernbury", {"name"}), ("Tolovar, Felix", {"name"}), ("S. Tolthorne", {"name"}), ("吴青禾", {"name"}), ("港口办公室", set()), ("编辑部", set()), ("Repo Quay Team", set()),
        ("Redaktion Halbrück", set()), ("Fenhaven Harbour Office", set()), ("Fernaldo SARL", set()), ("u/quiet.kettle", set()), ("cedar-wren", set()), ("Irene Quillwyn (923-23-7218)", {"name", "id_number"}),
        ("cedarbaker, tel. +44 7700 900236", {"phone"}), ("Papelar Team, paperbaker@brevkasse.example", {"email"}), ("Anna Braehagen, 32 Harrow Crescent, Wexfalk 99374", {"name", "address"}),
    ],
)
def test_authors(author, kinds):
    assert {s.kind for s in personal.find(author, author=True)} == kinds


def test_checksums():
    assert personal.luhn("4111111111111111") and not personal.luhn("4111111111111112")
    assert personal.mod97("GB82WEST12345698765432") and not personal.mod97("GB82WEST12345698765431")
    assert personal.cpf("52998224725") and not personal.cpf("52998224724")
    assert personal.resident_id("11010519491231002X") and personal.nif("12345678Z") and not personal.nif("12345678A")
    assert personal.insee("255081416802538")


def test_rest_stays_as_it_was():
    text = "Hello,\n call +1 212 555 0190 — or mail a.b@c.example ; bye\t"
    assert personal.redact(text) == "Hello,\n call [PHONE] — or mail [EMAIL] ; bye\t"


def test_names_end_where_they_end():
    assert personal.redact("Thanks, Mr Felix Tolstedt Our team") == "Thanks, [NAME] Our team"
    assert personal.redact("Danke, Clara Quillwyn Das Team") == "Danke, [NAME] Das Team"


def test_very_long_text():
    text = "The ferry follows the tram line. " * 20_000 + "Mail x.y@z.example now."
    assert personal.redact(text).endswith("Mail [EMAIL] now.")


SCHEMA = "content_id long, author string, comments string, kind string, place string"


def test_found_over_records(spark):
    tree = json.dumps([{"id": "a", "text": "Call me at +1 212 555 0190", "account": {"name": "Nora Dornesco"}, "replies": [{"id": "b", "body": "Thanks, Mr Velwyn and x@y.example"}]}])
    rows = [(1, "Greta Fernbury", tree), (1, "Greta Fernbury", tree), (2, None, "{broken x@y.example"), (3, "", None), (4, "team", "[]"), (None, "Greta Fernbury", None)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    assert {tuple(r) for r in personal.found(df).collect()} == {(1, "author", "name"), (1, "a", "phone"), (1, "b", "name"), (1, "b", "email")}
    assert {r.place: r.text for r in personal.redacted(df).where("content_id = 1").collect()}["b"] == "Thanks, [NAME] and [EMAIL]"
    assert personal.found(df.where("content_id = 9")).count() == 0


@pytest.mark.parametrize(
    ("author", "kinds"),
    [
        ("north.boot – 600000008", {"phone"}), ("quiet-heron47, tel. 02.61.91.84.72", {"phone"}), ("cedar / 555-0127", {"phone"}), ("Elena Velenko (00 133632 K 247)", {"name", "id_number"}),
        ("MARTA LINDOVAR", {"name"}), ("ULMONA HARBOUR OFFICE", set()), ("paper_baker83", set()), ("Stat Meadow Team", set()), ("ticket 2024-764", set()),
    ],
)
def test_author_fields(author, kinds):
    assert {s.kind for s in personal.find(author, True)} == kinds


def test_context_after_a_number_counts():
    assert {s.kind for s in personal.find("Give 949-69-1130 as my social security number.")} == {"id_number"}
    assert personal.redact("Order 00 133632 was late.") == "Order 00 133632 was late."
