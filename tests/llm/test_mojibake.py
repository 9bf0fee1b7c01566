import random

from gaugeworks.llm import mojibake as M

TEXTS = [
    "Außerdem fehlt noch eine größere Größe für Woche 570.", "L’équipe a noté une différence où la référence était répétée.", "¿Por qué la región está vacía? El niño añade una señal.",
    "Proszę wyjaśnić, dlaczego wartość jest pusta.", "A exceção última não foi lida; atenção: são 12.", "It’s the team’s job – not “mine” … 54.7 € ≥ 3 × 2 → done.",
    "如果列表是空白的，就返回记录。我们在第 950 周修改了记录，因为列表太慢。", "Zmieniliśmy moduł parser, ponieważ kolejność była zbyt wolna.",
]


def wrong(text, encoding):
    return "".join(M.TABLES[encoding][b] for b in text.encode("utf-8"))


def test_round_trip_of_all_pairs():
    for encoding in M.UTF8_READ_AS:
        for t in TEXTS:
            if t.isascii():
                continue
            bad = wrong(t, encoding)
            fixed, garbled, whole = M.repair(bad)
            assert garbled and whole and fixed == t, (encoding, t, bad, fixed)


def test_twice_garbled():
    for t in TEXTS[:6]:
        bad = wrong(wrong(t, "cp1252"), "cp1252")
        assert M.repair(bad)[:2] == (t, True), bad


def test_other_pairs():
    zh = TEXTS[6]
    bad = "".join(M.TABLES["latin-1"][b] for b in zh.encode("gb18030"))
    assert M.repair(bad)[:2] == (zh, True)
    pl = TEXTS[7]
    bad = pl.encode("cp1250").decode("cp1252")
    assert M.repair(bad)[:2] == (pl, True)
    assert M.repair(zh.encode("utf-8").decode("gb18030", "replace"))[1]


def test_right_text_is_untouched():
    for t in TEXTS:
        assert M.repair(t) == (t, False, True), t
    for t in (
        "The preview prints “Ã©” where the file has “é”, so set the charset.", "A stray Â in front of a space hints at the wrong charset.", "Search for â€™ in the raw dump and write it down.",
        "The old viewer showed � for unknown bytes.", "ATENÇÃO: SÃO 668 LINHAS, NÃO 652. AÇÃO PENDENTE", "5 m³ à 20 °C ± 2", "ÄÖÜ äöü ß", "", None, "plain",
    ):
        assert M.repair(t) == (t, False, True), t


def test_only_matched_spans_change():
    rnd = random.Random(8)
    for _ in range(60):
        lines = [rnd.choice(TEXTS) for _ in range(5)]
        at = rnd.randrange(5)
        bad = list(lines)
        bad[at] = wrong(lines[at], rnd.choice(["cp1252", "cp437", "mac_roman"]))
        assert M.repair("\n".join(bad))[0] == "\n".join(lines)


def test_lost_characters_are_found():
    text, garbled, whole = M.repair("Das Ergebnis h�ngt davon ab")
    assert garbled and not whole and text == "Das Ergebnis h�ngt davon ab"


def test_frame(spark):
    bad = wrong(TEXTS[0], "cp1252")
    rows = [(1, bad, "x")] * 2 + [(2, TEXTS[0], "x"), (3, None, "x"), (4, "", "x"), (None, bad, "x"), (5, "é" * 300_000 + "\n" + bad, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, restored string")
    assert sorted(r.doc_id for r in M.garbled_documents(df).collect()) == [1, 5]
    assert {r.text for r in M.repaired(df).where("doc_id = 1").collect()} == {TEXTS[0]}
    assert M.garbled_documents(df.limit(0)).count() == 0


def test_letters_read_as_letters():
    for t in ("Proszę wyjaśnić, dlaczego wartość jest pusta po kroku 927.", "Później późniejsza odpowiedź zostanie usunięta z pamięci."):
        for true, bad in (("cp1250", "cp1252"), ("iso8859-2", "latin-1")):
            assert M.repair("".join(M.TABLES[bad][b] for b in t.encode(true)))[:2] == (t, True), (t, true)
    # evidence of short lines counts together
    t = "Trzeba to\nwyjaśnić\ndziś, bo jest\nwartość\npusta"
    assert M.repair(t.encode("cp1250").decode("cp1252"))[:2] == (t, True)
    t = "Die Prüfung läuft für alle Träger und Märkte."
    assert M.repair(t.encode("mac_roman").decode("cp1252"))[:2] == (t, True)
    for t in ("El niño añade una señal.\nVocê lê a ciência e a experiência.\nLe cœur, l’œdème et le fœtus.", "Hun skal være med og læse; larvæ, formulæ.", "Škoda řídí, Žižka šel; MŠMT", "DŸ"):
        assert M.repair(t) == (t, False, True), t
