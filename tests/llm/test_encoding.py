import random

import numpy as np

from lettermill.llm.encoding import K, fold, from_content, garbled, mapped, repair, segments, surprisal
from lettermill.llm.unify import code_points

SENTENCES = ["Nous avons décidé à l'étage que le relevé de février sera présenté à la direction.", "Die Übersicht der Kosten für März wird später geprüft, während wir möglichst früh anfangen.", "Мы решили в портовом офисе, что новый отчёт ещё не готов и нужно обсудить его позже.", "The café invoice was sent to the wrong address, so we could finish this early next week."]


def corpus(n=300):
    r = random.Random(3)
    return [" ".join(r.choice(SENTENCES) for _ in range(4)) for _ in range(n)]


def table():
    c = fold(code_points(corpus())[0]).astype(np.int64)
    n = np.bincount(c[:-1] * K + c[1:])
    at = np.flatnonzero(n)
    return surprisal(at, n[at].astype(float))


def test_round_trips():
    t = table()
    for right, wrong in (("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1252", "cp1251"), ("cp1251", "cp1252"), ("koi8-r", "cp1251")):
        for s in SENTENCES[:3]:
            try:
                bad = s.encode(right).decode(wrong)
            except UnicodeError:
                continue
            if bad.isascii() or bad == s:
                continue
            new, gain, name = repair(bad, t)
            assert name and gain > 3, (right, wrong, bad)
            if right == "utf-8":
                assert new == s


def test_sound_and_partly_garbled():
    t = table()
    assert all(repair(s, t) == (s, 0.0, "") for s in SENTENCES)
    mixed = SENTENCES[0] + " " + "für später".encode().decode("cp1252") + " " + SENTENCES[2]
    assert repair(mixed, t)[0] == SENTENCES[0] + " für später " + SENTENCES[2]


def test_segments_against_brute_force():
    r = random.Random(1)
    for _ in range(50):
        x = np.array([r.choice([-2, -1, 1, 3]) for _ in range(12)], float)
        got = segments(x)
        best = max(x[a:b].sum() for a in range(12) for b in range(a + 1, 13))
        assert not got and best <= 0 or max(x[a:b].sum() for a, b in got) == best


def test_frame(spark):
    rows = [(i, s, "x") for i, s in enumerate(corpus(60))] + [(100, "dÃ©cidÃ© Ã  l'Ã©tage", "x"), (100, "dÃ©cidÃ© Ã  l'Ã©tage", "x"), (101, "caf\ufffd", "x"), (102, None, "x"), (103, "", "x"), (None, "plain", "x")]
    df = spark.createDataFrame(rows, "attachment_id bigint, extraction string, restored string")
    got = garbled(df, "attachment_id", "extraction").collect()
    assert sorted(r.record_id for r in got) == [100, 100, 101]
    assert garbled(df.limit(0), "attachment_id", "extraction").collect() == []


def test_mappings_against_codecs():
    for right, wrong in (("utf-8", "cp1252"), ("cp1251", "cp1252"), ("koi8_r", "cp1251")):
        bad = "новый".encode(right).decode(wrong) if right != "utf-8" else "déjà vu".encode(right).decode(wrong)
        assert {"новый", "déjà vu"} & set(mapped(bad))
    assert mapped("plain") == {} and mapped("日本") == {}


def test_lost_characters_come_from_the_bytes(spark):
    text = "Die Prüfung im Lager ist später für alle möglich.\n" * 3
    hurt = text.encode("cp1252").decode("utf-8", "replace")
    rows = [(k, "Wir haben die Übersicht geprüft.") for k in range(20)] + [(100, hurt), (101, hurt[:70]), (102, hurt), (103, hurt), (None, hurt)]
    found = garbled(spark.createDataFrame(rows, "a bigint, t string"), "a", "t")
    files = [(100, text.encode("cp1252"), "x.txt", "text/plain"), (101, text.encode("cp1252"), None, None), (102, b"another text \xfc", "x.txt", None), (100, text.encode("cp1252"), "x.txt", "text/plain"), (103, None, None, None)]
    out = {r.record_id: r for r in from_content(found, spark.createDataFrame(files, "a bigint, c binary, n string, ct string"), "a", "c", "n", "ct").collect()}
    assert out[100].restored.strip() == text.strip() and out[100].mapping == "content" and out[100].lost == 0
    assert text.startswith(out[101].restored) and out[101].lost == 0
    assert out[102].restored == hurt and out[102].lost > 0 and out[103].lost > 0 and out[None].lost > 0
