import pytest

from corvane.llm import pii
from corvane.llm.queries import QUERIES


def kinds(t):
    return {x.type for x in pii.find_spans(t)}


@pytest.mark.parametrize(("text", "type"), [
    ("Contact is lena.ford@mail.site.example, cc the list.", "email"), ("write to bob [at] corp.example now", "email"), ("ann (at) lab (dot) test", "email"),
    ("x_y @ host . example asked", "email"), ("ANN+TAG@HOST.EXAMPLE", "email"), ("u＠host.test", "email"), ("<mailto:a.b@c.example>", "email"),
    ("call +1-335-555-0189 now", "phone"), ("(278) 555-0153", "phone"), ("8(050)181 50 73", "phone"), ("+7 (025) 186-67-50", "phone"), ("07700 900719", "phone"), ("+49 (0)30 23125 513", "phone"), ("460-555-0120 x48", "phone"),
    ("SSN 915-56-8090", "id_number"), ("паспорт серии 00 01 № 978817", "id_number"), ("СНИЛС 000-709-700 95", "id_number"), ("ИНН физлица 000099761977", "id_number"), ("passport no. ZX3152802", "id_number"), ("Personalausweis L0X95T829", "id_number"),
    ("ул. Лесная, д. 4, кв. 45, г. Озёрск", "address"), ("г. Озёрск, Лесная 115-59", "address"), ("Озёрск, пр-т Лесная 85 корп. 1", "address"), ("Flat 12, 170 Ostgate Close, Brindle Falls", "address"), ("154A NETTLE LANE BRINDLE FALLS 00207", "address"), ("Amselweg 161, 00200 Oberfelden", "address"),
    ("Ask Otto H. Brenner about it", "name"), ("Ask Soltamire, Nadia about", "name"), ("G. Feltaforsky said", "name"), ("ОСКОДИН ПЁТР в отпуске", "name"), ("Илдлеков А. Г. ушёл", "name"), ("спроси: Вера Романовна Солвина.", "name"), ("sent by lena nymriska here", "name"),
])
def test_found(text, type):
    assert type in kinds(text)


@pytest.mark.parametrize("text", [
    None, "", " \n", "Remote is git@forge.site.test:team/loss.git", "Pin merge@0.21.6 and bf16@8192", "Offset 000019091396 is past the end", "Build 20261014-176955, ticket 412-88-9322",
    "Серийный номер платы 0006298452 сменили", "We saw 8 000 9673 tokens in shard 00", "зал Б, ряд 14, стойка 7", "/mnt/street/12", "lane 4 of the test track", "Страж Дрейфа", "Ask the Quill team", "Latent Router and Block Median", "паспорт корпуса пересобрал 4321 строк", "ops@12b",
])
def test_not_found(text):
    assert kinds(text) == set()


def test_redaction_keeps_the_rest():
    t = '{"note": "Ask Otto Brenner\\nat otto@x.example or +1-335-555-0189", "n": 3}'
    assert pii.redact(t) == '{"note": "Ask <NAME>\\nat <EMAIL> or <PHONE>", "n": 3}'
    assert pii.redact("ot​to@x.example") == "<EMAIL>" and pii.redact(None) is None and pii.redact("plain") == "plain"


def test_long_text_and_many_spans():
    t = ("filler words here. " * 5000) + "mail a.b@c.example " * 300
    assert len(pii.find_spans(t)) == 300


def test_validators():
    assert pii.luhn("046454286") and not pii.luhn("046454287")
    assert pii.mod97("85073003328") and pii.mod101("11223344595") and pii.mod11("500100732259")


def test_operator(spark):
    schema = "turn_id long, content string, pii_type string"
    df = spark.createDataFrame([(1, "a@b.example and c@d.example", "z")] * 2 + [(2, None, "z"), (None, "a@b.example", "z")], schema)
    assert sorted((r[0], r[1]) for r in pii.found_types(df.where("turn_id IS NOT NULL")).collect()) == [(1, "email")]
    assert pii.found_types(spark.createDataFrame([], schema)).count() == 0
    assert [r["content"] for r in pii.redacted(df).orderBy("turn_id").collect()][1:3] == ["<EMAIL> and <EMAIL>"] * 2


@pytest.mark.parametrize(
    ("text", "kind"),
    [("hauptstrasse 5, 10115 berlin", "address"), ("Lindenweg5, 10115 Berlin", "address"), ("Москва, ш. Энтузиастов, 12", "address"), ("Москва, туп. Садовый, 3", "address"), ("Тверь, линия Садовая, 3", "address"), ("с. Покровское, Садовая, 3", "address"),
     ("anna.weber (ät) firma.example", "email"), ("anna.weber [ät] firma.example", "email"), ("anna.weber < at > firma.example", "email")],
)
def test_conditions_let_through_what_the_patterns_take(text, kind):
    assert [s[2] for s in pii.find_spans(text)] == [kind]


ORDINARY = pii.ordinary_words()
needs_words = pytest.mark.skipif(not ORDINARY, reason="no vocabulary file")


@needs_words
@pytest.mark.parametrize("text", ["Ask Priya Ramaswamy about the rollback.", "Hiroshi Tanaka asked for the log.", "We met with Kwame Mensah today.", "Owner: Mohammed Hassan", "Thanks, Zofia Kowalska", "A call from Fatima Al-Sayed came in.",
    "Спроси Гульнару Ахметову про откат.", "Автор: Рустам Сафиуллин", "Письмо от Айгуль Нургалиевой пришло."])
def test_names_outside_the_lists(text):
    assert [x.type for x in pii.find_spans(text, ORDINARY)] == ["name"]


@needs_words
@pytest.mark.parametrize("text", ["Hi Block Median, one more thing.", "We borrowed the board from Gate Keeper v2 in spring.", "Пропуск на имя Страж Дрейфа не сработал.", "По blame это Медиана Блоков.", "Ревью закрыл(а) Полярный Экспресс.",
    "As Latent Router put it, the gate is only a hint.", "Laut Bericht erweitert der alte Packschritt den langen Weg.", "Priya Ramaswamy Foundation"[:0]])
def test_names_of_things(text):
    assert pii.find_spans(text, ORDINARY) == []


NUMBERS = {
    "The insurance number that came by post shows 11223344595 on it.": True, "The insurance number that came by post shows 11223344580 on it.": False, "Her passport copy, as scanned last week, ends 046 454 286 here.": True,
    "Her passport copy, as scanned last week, ends 046 454 287 here.": False, "Board 112-233-445 95 is mine": True, "Board 112-233-445 96 is mine": False,
}


def test_checksums_decide(monkeypatch):
    assert {t: "id_number" in kinds(t) for t in NUMBERS} == NUMBERS
    monkeypatch.setattr(pii, "VALIDATORS", ())
    monkeypatch.setattr(pii, "mod101", lambda d: False)
    assert not any("id_number" in kinds(t) for t in NUMBERS)


def test_numbering_plan_and_context_decide(monkeypatch):
    assert kinds("call 4605550120 now") == {"phone"} and kinds("rows 4605550120 now") == set() and kinds("call 1605550120 now") == set()
    assert kinds("ticket 460-555-0120") == set() and kinds("see 460-555-0120") == {"phone"} and kinds("see 460-155-0120") == set()
    monkeypatch.setattr(pii, "_PHONE_CTX", pii.re.compile("(?!)"))
    assert kinds("call 4605550120 now") == set()
    monkeypatch.setattr(pii, "_NUMBER_CTX", pii.re.compile("(?!)"))
    assert kinds("ticket 460-555-0120") == {"phone"}


@needs_words
def test_context_of_persons_decides(monkeypatch):
    assert pii.find_spans("Owner: Mohammed Hassan", ORDINARY)
    monkeypatch.setattr(pii, "_PERSON", pii.re.compile("(?!)"))
    assert not pii.find_spans("Owner: Mohammed Hassan", ORDINARY)


def test_no_vocabulary_file(spark, tmp_path):
    assert pii.ordinary_words(str(tmp_path / "none")) == frozenset()
    df = spark.createDataFrame([(1, "Ask Otto Brenner")], "turn_id long, content string")
    assert [tuple(r) for r in pii.found_types(df, str(tmp_path / "none")).collect()] == [(1, "name")]


def test_missing_or_broken_vocabulary_is_an_error(spark, tmp_path, monkeypatch):
    none, broken, empty = (str(tmp_path / x) for x in ("none", "broken", "empty"))
    (tmp_path / "broken").write_bytes(b"IGFzaw== 0\nversion https://example.test/spec\n")
    (tmp_path / "empty").write_bytes(b"")
    spark.createDataFrame([(1, "user", "text", "Ask Priya Ramaswamy")], "turn_id long, role string, kind string, content string").write.parquet(f"{tmp_path}/turns.parquet")
    for path, error in ((none, FileNotFoundError), (broken, ValueError), (empty, ValueError)):
        monkeypatch.setattr(pii, "VOCABULARY", path)
        for name in ("p1_found", "p1_redacted"):
            with pytest.raises(error, match=path):
                QUERIES[name](spark, str(tmp_path))
    with pytest.warns(UserWarning, match=none):
        pii.found_types(spark.read.parquet(f"{tmp_path}/turns.parquet"), none)
