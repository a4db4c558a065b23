from __future__ import annotations

import pytest

from marketloom.llm.mojibake import DEFAULT, cost, profile_of, restore, restored_texts

PL = "Święto i duża wilgotność mogą spowolnić grę. Źródło podało godzinę, a zakładka Łódź była pusta."
DE = "Über 2.5 Tore erscheint ungewöhnlich, weil größere Abweichungen auffallen."
ES = "¿Quién revisó la captura? Faltaban 46 filas en la pestaña Handicap asiático."
FINE = [
    "Skrót „ę¹” to tylko odsyłacz do uwagi.", "Oznaczenie Å oraz Ÿ w nazwie VÂLTORA jest poprawne.", "Kurs w £ i € podano obok ¥ dla porównania.", "Boisko ma 7140 m², a trybuna 3½ piętra.",
    "Dane z kolumny A³ i przypis¹ pozostały bez zmian.", "Gäste aus SÃO RAFINO reisten früh an.", "Le château de Brêvane fût rénové à l’été.", "Emotikon 😀 i znak ✅ dopisał redaktor.", "&amp; and &eacute; stay", PL, DE, ES, "",
]


def sloppy(data: bytes, page: str) -> str:
    return "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in data)


@pytest.mark.parametrize("text", [PL, DE, ES])
@pytest.mark.parametrize("page", ["cp1252", "latin-1", "cp1250", "iso8859-2", "cp852", "cp437", "mac-roman"])
def test_utf8_read_with_another_page(text, page):
    assert restore(sloppy(text.encode(), page)) == text


@pytest.mark.parametrize(("written", "read"), [("cp1250", "cp1252"), ("iso8859-2", "latin-1"), ("iso8859-2", "cp1252"), ("cp1250", "latin-1")])
def test_one_byte_pages(written, read):
    assert restore(sloppy(PL.encode(written), read)) == PL


@pytest.mark.parametrize(("text", "written", "read"), [
    (PL, "iso8859-2", "cp1250"), (PL, "cp1250", "iso8859-2"), (PL, "cp1250", "cp1251"), (PL, "cp1250", "mac-roman"), (PL, "cp852", "cp1250"), (PL, "cp852", "cp850"),
    (PL, "iso8859-2", "iso8859-15"), (PL, "cp1250", "mac-latin2"), (ES, "cp1252", "cp1250"), (ES, "cp1252", "iso8859-2"), ("Cada año se revisó la pestaña.", "cp1252", "cp1250"),
])
def test_one_byte_pages_read_with_any_other(spark, text, written, read):
    garbled = sloppy(text.encode(written), read)
    assert garbled != text and restore(garbled) == text
    rows = spark.createDataFrame([(1, garbled)], "doc_id bigint, text string")
    assert [r["restored"] for r in restored_texts(rows, "doc_id", "text").collect()] == [text]


def test_cyrillic_text_stays():
    text = "Сегодня хорошая погода, и матч начнётся вовремя."
    assert restore(text) == text and restore(PL + " " + text) == PL + " " + text


def test_no_step_that_suits_all_of_a_part_garbled_text_half():
    text = "Um 12:01 wurde der Reiter Top erneut geöffnet und vollständig gelesen. Für den Markt Ecken gesamt zählt nur die reguläre Spielzeit ohne Verlängerung."
    first, second = text.split(". ")
    assert restore(sloppy(first.encode(), "cp1252") + ". " + second) == text


def test_twice_and_partly():
    assert restore(sloppy(sloppy(PL.encode(), "cp1252").encode(), "cp1252")) == PL
    sentences = PL.split(". ")
    assert restore(sentences[0] + ". " + sloppy(sentences[1].encode(), "cp1252")) == PL
    assert restore(sloppy(ES[:24].encode(), "cp1252") + "\n" + sloppy(ES[24:].encode(), "cp1250")) == ES[:24] + "\n" + ES[24:]
    assert restore(FINE[4] + "\n" + sloppy(PL.encode(), "cp1250")) == FINE[4] + "\n" + PL


@pytest.mark.parametrize("text", FINE)
def test_fine_texts_stay(text):
    assert restore(text) == text


def test_rows(spark):
    rows = [(1, sloppy(PL.encode(), "cp1252")), (2, "lost � here"), (3, PL), (4, None), (5, ""), (6, "x" * 300_000 + sloppy(DE.encode(), "latin-1")), *[(10 + i, t) for i, t in enumerate(FINE)]]
    got = {r["doc_id"]: r["restored"] for r in restored_texts(spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, restored int"), "doc_id", "text").collect()}
    assert got == {1: PL, 2: None, 6: "x" * 300_000 + DE}
    assert restored_texts(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_cost_orders_texts():
    assert cost(PL) == cost(DE) == cost(ES) == 0 < cost(FINE[6]) < cost(sloppy(FINE[6].encode(), "cp1252"))


FOREIGN = {
    "cs": "Příliš žluťoučký kůň úpěl ďábelské ódy. Zápas začne v neděli odpoledne.", "hu": "Győri csapat a fővárosban. Az árvíztűrő tükörfúrógép működött.", "fr": "Le garçon a été reçu à l’école où naïveté et forêt se mêlent, ça brûle.",
    "ru": "Сегодня хорошая погода, и матч начнётся вовремя.", "ro": "Meciul început în București s-a întrerupt după două goluri, încă și mâine.",
}


@pytest.mark.parametrize("lang", FOREIGN)
def test_texts_of_other_languages_stay_and_come_back(lang):
    text = FOREIGN[lang]
    assert restore(text) == text
    for page in ("latin-1", "cp1252"):
        assert restore(sloppy(text.encode(), page)) == text


@pytest.mark.parametrize(("lang", "written", "read"), [("cs", "cp1250", "cp1252"), ("cs", "iso8859-2", "latin-1"), ("hu", "cp1250", "cp1252"), ("hu", "iso8859-2", "latin-1")])
def test_one_byte_pages_of_languages_that_the_corpus_is_written_in(spark, lang, written, read):
    text = FOREIGN[lang].replace("’", "'")
    rows = [(i, f"{FOREIGN[lang]} {i}") for i in range(30)] + [(100, sloppy(text.encode(written), read)), (101, PL)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert lang in profile_of(df, "text").home
    got = {r["doc_id"]: r["restored"] for r in restored_texts(df, "doc_id", "text").collect()}
    assert got == {100: text}


def test_escapes_of_garbled_text():
    assert restore("g&Atilde;&sup3;l w meczu") == "gól w meczu" and restore("g\\u00c3\\u00b3l") == "gól" and restore("g&#195;&#179;l") == "gól"
    assert restore("&amp; &oacute; &lt;b&gt;") == "&amp; &oacute; &lt;b&gt;" and restore("AT&T; x & y;") == "AT&T; x & y;"


def test_runs_are_judged_where_they_stand():
    assert restore("Nazwa kůň i Łódź") == "Nazwa kůň i Łódź"


def test_profile_of_an_empty_or_plain_corpus(spark):
    for rows in ([], [("abc",), (None,), ("",)]):
        assert profile_of(spark.createDataFrame(rows, "text string"), "text").home == DEFAULT.home


def test_languages_are_counted_over_all_documents(spark):
    """A language of two in a hundred documents, all of them with greater hashes than the first five thousand others."""
    rows = [(i, f"{DE} {i}") for i in range(6_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bound = df.selectExpr("xxhash64(text) AS h").orderBy("h").collect()[5_000]["h"]
    czech = spark.createDataFrame([(10_000 + i, f"{FOREIGN['cs']} {i}") for i in range(2_000)], "doc_id bigint, text string")
    late = [tuple(r) for r in czech.where(f"xxhash64(text) > {bound}").orderBy("doc_id").limit(120).collect()]
    garbled = sloppy(FOREIGN["cs"].encode("cp1250"), "cp1252")
    assert len(late) == 120
    df = spark.createDataFrame([*rows, *late, (1, garbled)], "doc_id bigint, text string")
    assert profile_of(df, "text").home == ("de", "cs")
    assert [(r["doc_id"], r["restored"]) for r in restored_texts(df, "doc_id", "text").collect()] == [(1, FOREIGN["cs"])]


def test_languages_are_told_by_whole_sound_documents(spark):
    sound = ["Größe, Übung, Höhe, weiß"] * 10
    other = ["Größe, Übung, Höhe 😀weiß w😀eiß", "Größe kůň žluť", "äö äö", "½ Größe, Übung, Höhe", None, ""]
    assert profile_of(spark.createDataFrame([(t,) for t in sound], "text string"), "text").home == ("de",)
    assert profile_of(spark.createDataFrame([(t,) for t in sound[1:] + other], "text string"), "text").home == DEFAULT.home
