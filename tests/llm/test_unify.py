import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm.unify import REASONS, consistent_form, p2_forms, unify


def brute(text):
    """Full-width letters and ligatures by the standard's tables, one character after the other."""
    out = []
    for c in text:
        d = unicodedata.decomposition(c)
        out.append(unicodedata.normalize("NFKC", c) if d.startswith(("<font>", "<wide>")) or "ﬀ" <= c <= "ﬆ" else " " if c in "\u00a0\u2003\u3000" else c)
    return unicodedata.normalize("NFC", "".join(out))


def test_reasons():
    cases = {
        "ｆｕｌｌ": ("full", "styled"), "𝐛𝐨𝐥𝐝": ("bold", "styled"), "ﬁne": ("fine", "ligature"), "re\u0301sume\u0301": ("résumé", "decomposed"), "a\u00adb": ("ab", "invisible"), "a\u00a0b": ("a b", "space"),
        "bоard": ("board", "lookalike"), "можнo": ("можно", "lookalike"), "οtοñο": ("otoño", "lookalike"), "раrа": ("para", "lookalike"), "и\u0306": ("\u0439", "decomposed"), "e\u0323\u0302": ("ệ", "decomposed"),
    }
    forms, why = unify(list(cases))
    assert {k: (f, w) for k, f, w in zip(cases, forms, why)} == {k: (f, REASONS[w]) for k, (f, w) in cases.items()}


def test_sound_text_stays():
    sound = ["", "plain", "“quotes” – dash…", "👩\u200d💻 ok", "Да, Москва и Paris", "Ελλάδα", "µm kΩ", "Δxy", "\ufeffstart", "x" * 300_000, "naïve café"]
    forms, why = unify(sound)
    assert forms == sound and not why.any()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abÀé ｆＺ𝐚ﬁﬃ\u0301\u0308\u00a0\u3000ñ7."), max_size=40))
def test_against_brute_force(text):
    assert unify([text, "x", text])[0][0] == brute(text)


def test_frame(spark):
    rows = [(1, "a\u200bb", "<p>a&#8203;b</p>", "x"), (1, "a\u200bb", None, "x"), (None, None, "", "x"), (2, "plain", "<b>r</b>&nbsp;s", "x")]
    df = spark.createDataFrame(rows, "message_id bigint, text string, html string, form string")
    got = consistent_form(df, "message_id", {"text": False, "html": True}).collect()
    assert sorted((r.field, str(r.record_id), r.form.strip()) for r in got) == [("html", "1", "ab"), ("html", "2", "r s"), ("html", "None", ""), ("text", "1", "ab"), ("text", "1", "ab"), ("text", "2", "plain")]
    assert consistent_form(df.limit(0), "message_id", {"text": False}).collect() == []
    assert {(r.field, r.record_id) for r in consistent_form(df, "message_id", {"text": False, "html": True}, True).collect()} == {("text", 1), ("html", 1), ("html", 2)}


def test_forms_of_equal_looking_bodies(spark, tmp_path):
    rows = [(1, "cafe\u0301", "<p>caf&eacute;</p>"), (1, "cafe\u0301", "<p>caf&eacute;</p>"), (2, "café", "<p>cafe&#769;</p>"), (3, "coffee", None)]
    spark.createDataFrame(rows, "message_id bigint, text string, html string").write.parquet(f"{tmp_path}/messages.parquet")
    got = {(r.field, r.message_id): r for r in p2_forms(spark, str(tmp_path)).collect()}
    assert set(got) == {("text", 1), ("text", 2), ("text", 3), ("html", 1), ("html", 2)}
    for f in ("text", "html"):
        assert got[f, 1].form.strip() == "café" and got[f, 1].form_hash == got[f, 2].form_hash
    assert got["text", 3].form_hash != got["text", 1].form_hash


def test_signs_that_are_letters_and_half_width_forms():
    cases = {"5 \u2126": "5 Ω", "3 \u212b": "3 Å", "\uff76\uff9e": "ガ", "h\u0585me wｏrk": "home work", "ᏚᎪLE": "SALE", "a\0b\u00a0c": "a\0b c", "é\0": "é\0"}
    assert dict(zip(cases, unify(list(cases))[0])) == cases
