import pytest

from symweave.llm import garbling as g

CLEAN = [
    "Le problème a été signalé à l’équipe déjà prévue.", "Für die Prüfung fehlt ein gültiger Schlüssel, größer als nötig.", "Осталось восемь задач, снимок пришёл поздно, индекс перестроен.",
    "Błąd zgłoszono już wcześniej, gdyż próbę powtórzyć trzeba później.", "El análisis falló sin razón aparente mañana también.", "A função não devolve três exceções até à próxima revisão.",
    "スナップショットの到着が遅れたため、索引を再構築しました。", "Memory grows like O(n³) ± 5 ½ — “as usual” → №7 ├── └── ™ 🚀",
]
SCHEMA = "doc_id long, text string, parts string, stretches string"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(CLEAN * 20)]
    return g.train(spark.createDataFrame(rows, SCHEMA))


CASES = [(0, (("utf-8", "cp1252"),)), (1, (("utf-8", "latin-1"),) * 2), (2, (("koi8_r", "cp1251"),)), (2, (("cp1251", "cp1252"),)), (3, (("cp1250", "cp1252"),)), (4, (("utf-8", "cp437"),)), (5, (("utf-8", "mac_roman"),)), (6, (("utf-8", "cp1252"),)), (3, (("utf-8", "cp1250"),))]


def test_finds_and_restores(spark, model):
    rows = [(i, t, "x", "y") for i, t in enumerate(CLEAN)] + [(100 + i, g.garble(CLEAN[n], chain), "x", "y") for i, (n, chain) in enumerate(CASES)]
    rows += [(200, None, "x", "y"), (201, "", "x", "y"), (202, "plain ascii", "x", "y"), (203, "pr�vue", "x", "y"), (204, "naïve café    ", "x", "y"), (205, "é " * 20_000, "x", "y")]
    found = {r.doc_id: r for r in g.garbled_texts(spark.createDataFrame(rows, SCHEMA), model, with_text=True).collect()}
    assert set(found) == {203, *(100 + i for i in range(len(CASES)))}
    assert found[203].stretches[0].original is None and found[203].stretches[0].chain == []
    whole = sum(found[100 + i].restored == CLEAN[n] for i, (n, _) in enumerate(CASES))
    assert whole >= 6


def test_held_out_words(model):
    """Words that the small sample of this test doesn't hold: nearly all clean ones stay, most garbled ones are found."""
    words = ["dépôt", "référence", "Vögel", "Straße", "überprüft", "соединение", "библиотека", "książka", "żółty", "niño", "corazón", "coração", "evolução"]
    assert sum(v is None for v in model.judge(words)) >= len(words) - 1
    garbled = [w for w in (g.garble(w, (("utf-8", r),)) for w in words for r in ("cp1252", "latin-1", "cp437")) if w]
    assert sum(v is not None for v in model.judge(garbled)) >= 0.85 * len(garbled)


def test_inversion_is_strict():
    assert g.invert("déjà", (("utf-8", "cp1252"),)) is None and g.invert("ascii", (("utf-8", "cp1252"),)) is None
    for chain in g.chains():
        for text in CLEAN:
            garbled = g.garble(text, chain)
            if garbled not in (None, text):
                assert g.invert(garbled, chain) == text


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert g.garbled_texts(empty).collect() == []
    assert g.garbled_texts(spark.createDataFrame([(1, "plain", "x", "y"), (2, None, "x", "y")], SCHEMA)).collect() == []


def test_chain_of_a_text_holds_for_its_short_stretches(spark):
    known = [*CLEAN, "Ошибка в файле, не в индексе, а в ссылке.", "La tâche est prête."]
    model = g.train(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(known * 20)], SCHEMA))
    text = "Осталось восемь задач, в индексе в файле."
    garbled = g.garble(text, (("cp1251", "cp1252"),)) + " La tâche est prête."
    rows = [(1, garbled, "x", "y"), (2, "Route\xa0lookups\xa0through\xa0it", "x", "y"), (3, "problÃ¨me dÃ©jÃ  signalÃ© Ã l’équipe", "x", "y")]
    found = {r.doc_id: r for r in g.garbled_texts(spark.createDataFrame(rows, SCHEMA), model, with_text=True).collect()}
    assert set(found) == {1, 3} and found[1].restored == text + " La tâche est prête."
    assert [s.original for s in found[3].stretches if s.stretch in ("Ã", "dÃ©jÃ")] == [None, None]


def test_runs_within_stretches(spark, model):
    ja, once = CLEAN[6], (("utf-8", "cp1252"),)
    rows = [(1, "signalÃ©,Ã©quipe,dÃ©jÃ  lu", "x", "y"), (2, ja[:8] + g.garble("déjà signalé".split()[1], once) + ja[8:], "x", "y"), (3, "→problÃ¨me→", "x", "y"), (4, ja + "— “naïve”", "x", "y")]
    found = {r.doc_id: r for r in g.garbled_texts(spark.createDataFrame(rows, SCHEMA), model, with_text=True).collect()}
    assert set(found) == {1, 2, 3}
    assert [s.original for s in found[1].stretches] == [None] and found[1].restored == rows[0][1]
    assert found[2].restored == ja[:8] + "signalé" + ja[8:] and found[3].restored == "→problème→"


def test_runs_are_whole_characters():
    assert g.invert_runs("“Ã©tÃ©”", (("utf-8", "cp1252"),)) == ("“été”", False)
    assert g.invert_runs("dÃ©jÃ", (("utf-8", "latin-1"),)) == ("déjÃ", True)
    assert g.invert_runs("→Îøèáêà→", (("cp1251", "cp1252"),)) == ("→Ошибка→", False)
    assert g.invert_runs("déjà", (("utf-8", "cp1252"),)) is None
    garbled = g.garble("ボタン", (("cp932", "cp1252"),))
    assert "{" in garbled and g.re.findall(g.STRETCH, "a " + garbled + " {b}") == [garbled]


def test_every_chain_within_the_margin_is_tried():
    """The true chain is the least likely one of all that clear the margin."""
    known, text = g.chains(), g.garble("été", (("utf-8", "cp1252"),))
    true = known.index((("utf-8", "cp1252"),))
    weights = g.np.zeros((g.BUCKETS, len(known) + 1), g.np.float32)
    weights[:, 0] = -9.0
    weights[g._bigrams(["été"])[0], 0] = -2.0
    weights[g._bigrams([text])[0], 0] = -9.0
    for i, chain in enumerate(known):
        if i != true and g.invert(text, chain) is None and g.invert_runs(text, chain) is None:
            weights[:, i + 1] = -1.0
        elif i != true:
            weights[:, i + 1] = -20.0
    weights[:, true + 1] = -7.0
    assert (weights[0, 1:] > -7.0).sum() > 16
    assert g.Model(weights, known).judge([text]) == [(known[true], "été")]


def test_held_out_accuracy(spark, model):
    words = spark.createDataFrame([(1, "prête réglée über Schrägstrich оставить задачей później Übung"), (2, None), (3, "plain")], "doc_id long, text string")
    rows = {r.chain: r for r in g.held_out_accuracy(model, words).collect()}
    assert len(rows) == len(g.chains()) and all(r.n >= r.n_found >= max(r.n_chain, r.n_restored) for r in rows.values())
    one = rows["utf-8>cp1252"]
    assert one.n >= 5 and one.n_restored >= 0.8 * one.n
    assert sum(r.n for r in g.held_out_accuracy(model, words.limit(0)).collect()) == 0
