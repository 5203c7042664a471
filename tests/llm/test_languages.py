import numpy as np

from linkspark.llm import languages

SENTENCES = {
    "en": ["We have checked the old catalogue again and found that it is still not where it should be.", "Please do not forget that the broken cassette must be returned next week.", "They have been asking for the label sheet since the spring and nobody knows why."],
    "de": ["Wir haben den alten Katalog noch einmal geprüft und dabei das Gerät nicht gefunden.", "Bitte vergessen Sie nicht, die fehlende Rechnung zusammen mit dem Heft zurückzugeben.", "Soweit ich sehe, passt die Nummer nicht zu dem, was auf der Liste steht."],
    "fr": ["Nous avons encore vérifié la facture manquante, mais nous ne la trouvons toujours pas.", "Depuis le printemps, on me demande le mauvais code et je ne sais pas quoi répondre.", "Si ce n'est pas ce que vous vouliez, il faudrait regarder notre liste ensemble."],
    "es": ["Hemos revisado el catálogo viejo otra vez y todavía no encontramos la factura que falta.", "Por favor, no olvide que hay que devolver la cinta rota con el archivo exportado.", "Si esto no es lo que usted quería, deberíamos mirar el formulario juntos."],
    "pt": ["Verificamos o arquivo exportado mais uma vez e ainda não encontramos o formulário.", "Por favor, não esqueça que temos de devolver a capa nova com a entrega do porto.", "Se não é isso que você queria, deveríamos ver a carta assinada juntos."],
    "ru": ["Мы ещё раз проверили старый каталог, но не нашли того, что искали.", "Пожалуйста, не забудьте, что мы должны вернуть посылку из порта.", "Насколько я вижу, номер не совпадает со списком, и я не знаю почему."],
}


def mail(*paragraphs):
    return "From: a@b.example\nSubject: x\nContent-Type: text/plain; charset=utf-8\n\nHello X,\n\n" + "\n\n".join(paragraphs) + "\n\nBest,\nY\n"


def corpus(n=60):
    rng = np.random.default_rng(0)
    out = []
    for k in range(n):
        lang = list(SENTENCES)[k % len(SENTENCES)]
        label = lang if k % 10 else "en"  # a tenth of the labels is wrong or right by chance
        out.append((k, mail(*[SENTENCES[lang][i] for i in rng.permutation(3)[:2]]), label))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lab, "s", 0.1) for i, t, lab in rows], "doc_id long, text string, lang string, segment string, confidence double")


def test_sets_of_mixed_documents(spark):
    s = SENTENCES
    asked = [
        (1000, mail(s["en"][0], s["de"][1]), "en"), (1001, mail(s["pt"][2]), None), (1002, mail(s["es"][1], s["es"][0]), "und"), (1003, mail(s["ru"][0]), "en"), (1004, mail(s["fr"][0]), "fr"), (1005, mail("> " + s["ru"][1], s["fr"][2], s["es"][2]), "fr"),
        (1006, None, "en"), (1007, "", "en"), (1008, mail(), None), (1004, mail(s["fr"][0]), "fr"), (1009, mail(*(s["en"] * 3000)), "en"),
    ]
    got = languages.identify(frame(spark, corpus() + asked)).where("doc_id >= 1000").collect()
    found = sorted({(r.doc_id, r.lang) for r in got if r.segment == -1 and r.written and not r.label_fits})
    assert found == [(1000, "de"), (1000, "en"), (1001, "pt"), (1002, "es"), (1003, "ru"), (1005, "es"), (1005, "fr"), (1005, "ru")]
    assert [r.lang for r in sorted((r for r in got if r.doc_id == 1000 and r.segment >= 0), key=lambda r: r.segment)] == ["en", "de"]
    assert all(0 < r.confidence <= 1 for r in got) and not [r for r in got if r.doc_id in (1006, 1007)]
    assert {r.written for r in got if r.doc_id == 1008} == {False}  # nobody wrote a paragraph; its words have a language all the same


def test_paragraphs_with_addresses_count_unless_they_are_disclaimers(spark):
    s = SENTENCES
    asked = [(1000 + k, mail(s["en"][k % 3], f"Diese Nachricht von haus{k}.example ist vertraulich. Wenn Sie nicht der richtige Empfänger sind, so löschen Sie diese bitte sofort."), "en") for k in range(5)]
    asked.append((1100, mail(s["en"][0], "Bitte schicken Sie die fehlende Rechnung zusammen mit dem Heft noch heute an archiv@klang.example, damit wir das Gerät nicht vergessen."), "en"))
    got = languages.identify(frame(spark, corpus() + asked)).where("doc_id >= 1000 and segment = -1").collect()
    assert {r.doc_id: {x.lang for x in got if x.doc_id == r.doc_id} for r in got} == {**{1000 + k: {"en"} for k in range(5)}, 1100: {"en", "de"}}


def test_empty_table(spark):
    assert languages.identify(frame(spark, [])).count() == 0


def test_held_out_accuracy_on_the_archive(spark, data):
    rows = languages.identify(spark.read.parquet(f"{data}/sf0.01/documents.parquet")).where("segment = -1").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, (r.label, set()))[1].add(r.lang)
    labelled = [(lab, langs) for lab, langs in by.values() if lab in languages.LANGUAGES]
    # labels are wrong for a few per cent of the messages; the rest must contain theirs
    assert sum(lab in langs for lab, langs in labelled) / len(labelled) > 0.92


def test_em_recovers_shares():
    ll = np.log(np.array([[0.9, 0.1], [0.9, 0.1], [0.9, 0.1], [0.1, 0.9]])) * 20
    share, posterior, _ = languages.fit_shares(ll)
    assert np.allclose(share, [0.75, 0.25], atol=1e-3) and posterior.argmax(axis=1).tolist() == [0, 0, 0, 1]
    assert languages.language_set(ll)[0] == [0, 1] and languages.language_set(ll, penalty=1e9)[0] == [0]


def test_long_texts_score_like_their_parts():
    model = np.random.default_rng(0).normal(size=(languages.BUCKETS, 3)).astype(np.float32)
    texts = ["ab cd", "x" * 900_000, "éü " * 10]
    whole = languages.likelihoods(texts, model)
    for k, t in enumerate(texts):
        slots, _ = languages.ngram_slots([t])
        assert np.allclose(whole[k], model[slots].sum(axis=0, dtype=np.float64) / languages.TEMPER, rtol=1e-2, atol=2)
