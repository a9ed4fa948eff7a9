import numpy as np

from lettermill.llm.language import LANGS, base_language, fit, languages, paragraphs, prose, score, segments, train

TEXTS = {
    "en": "The harbour board decided that the report will be shared with everyone before the next meeting on Monday",
    "de": "Die Hafenbehörde hat beschlossen, dass der Bericht vor der nächsten Sitzung am Montag an alle verteilt wird",
    "fr": "Le conseil du port a décidé que le rapport sera envoyé à tout le monde avant la prochaine réunion de lundi",
    "es": "La junta del puerto decidió que el informe se enviará a todo el mundo antes de la próxima reunión del lunes",
    "pl": "Zarząd portu zdecydował, że raport zostanie wysłany do wszystkich przed następnym spotkaniem w poniedziałek",
    "ru": "Совет порта решил, что отчёт будет отправлен всем до следующего собрания в понедельник после обеда и ужина",
}
HELD = {
    "en": "Could you check whether the invoice was sent to the right address and tell me what we should change",
    "de": "Könnten Sie bitte prüfen, ob die Rechnung an die richtige Adresse ging und was wir noch ändern sollten",
    "fr": "Pourriez-vous vérifier si la facture a été envoyée à la bonne adresse et me dire ce qu'il faut changer",
    "es": "¿Podrías comprobar si la factura se envió a la dirección correcta y decirme qué deberíamos cambiar ahora",
    "pl": "Czy możesz sprawdzić, czy faktura została wysłana pod właściwy adres, i powiedzieć mi, co trzeba zmienić",
    "ru": "Не могли бы вы проверить, что счёт отправлен по верному адресу, и написать мне, что нам нужно поменять",
}


def weights(noise=0.0):
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for k, l in enumerate(LANGS):
        words = TEXTS[l].split()
        for _ in range(40):
            texts.append(" ".join(rng.permutation(words)))
            labels.append(int(rng.integers(6)) if rng.random() < noise else k)
    return fit(texts, np.array(labels))


def test_held_out_accuracy_with_wrong_labels():
    for noise in (0.0, 0.25):
        lang, conf = score([HELD[l] for l in LANGS], weights(noise))
        assert [LANGS[x] for x in lang] == list(LANGS) and (conf > 0.5).all()


def test_paragraphs():
    text = "Hi Ann,\n\n" + TEXTS["en"] + ".\n\n> " + TEXTS["de"] + ".\n\nFrom: Ann <a@b.test>\n- " + TEXTS["fr"] + "\n--\nAnn"
    assert [p for _, p, _ in prose(text)] == [TEXTS["en"] + ".", TEXTS["de"] + "."]
    words = TEXTS["en"].split()
    lines = "> " + " ".join(words[:9]) + "\r\n> " + " ".join(words[9:])
    assert [p for _, p in paragraphs(lines)] == [TEXTS["en"]]
    assert prose("") == [] and prose("one two") == []


def test_frame(spark):
    rows = [(i, TEXTS[l] + f" {i}.", l if i % 7 else "xx", "x") for k, l in enumerate(LANGS) for i in range(k * 50, k * 50 + 50)]
    rows += [rows[0], (900, HELD["en"] + ".\n\n" + HELD["ru"] + ".", "EN_gb", "x"), (901, None, None, "x"), (902, "", "", "x"), (None, HELD["pl"], "und", "x")]
    df = spark.createDataFrame(rows, "message_id bigint, text string, lang string, confidence string")
    w = train(df.where("message_id < 900"), "message_id", "text", "lang", sample=30)
    got = {(r.record_id, r.lang) for r in languages(df.where("message_id >= 900 or message_id is null"), "message_id", ["text"], w).collect()}
    assert got == {(900, "en"), (900, "ru"), (None, "pl")}
    assert [r[0] for r in df.where("message_id in (900, 902)").orderBy("message_id").select(base_language(df.lang)).collect()] == ["en", None]
    empty = df.limit(0)
    assert languages(empty, "message_id", ["text"], train(empty, "message_id", "text", "lang")).collect() == []


def test_every_value_and_stretch(spark):
    rows = [(1, HELD["en"] + ".\n\nVielen Dank für Ihre Antwort.", HELD["ru"]), (2, "Спасибо большое", None), (3, "", "12 / 7"), (4, "- " + HELD["fr"], HELD["pl"] + ".\n\n" + HELD["es"] + ".")]
    df = spark.createDataFrame(rows, "message_id bigint, text string, extracted_text string")
    got = {(r.field, r.record_id, r.place): r for r in segments(df, "message_id", ["text", "extracted_text"], weights()).collect()}
    lang = {k: r.lang for k, r in got.items()}
    assert lang == {
        ("text", 1, None): "en", ("text", 1, 0): "en", ("text", 1, 2): "de", ("extracted_text", 1, None): "ru", ("extracted_text", 1, 0): "ru", ("text", 2, None): "ru", ("text", 2, 0): "ru",
        ("text", 3, None): "und", ("extracted_text", 3, None): "und", ("text", 4, None): "fr",
        ("extracted_text", 4, None): lang["extracted_text", 4, None], ("extracted_text", 4, 0): "pl", ("extracted_text", 4, 2): "es",
    }
    assert all((r.confidence > 0.5) == (r.lang != "und") for r in got.values()) and got["text", 1, None].n_words == got["text", 1, 0].n_words + 5
