import itertools

import numpy as np

from lettermill.llm import personal as P

HEADER = "From: Ann Poe <ann.poe@x.test>\nFrom: Bob Lee <blee7@x.test>\n"


def lex():
    return P.Lexicon.of(["Ann", "Bob", "Maud"], ["Poe", "Lee", "Grimsand"])


def found(text):
    s, labels = P.mentions([text], lex())
    return sorted((P.LABELS[y], k) for y, k in zip(labels.tolist(), s.keys) if y)


def test_mentions():
    cases = {
        "Write to Ann.Poe+x@mail.x.test now.": [("email", "annpoexmailxtest")],
        "Write to ann [dot] poe [at] x [dot] test now.": [("email", "anndotpoeatxdottest")],
        "Copy ann dot poe at x dot test please.": [("email", "anndotpoeatxdottest")],
        "Ring +44 (0)20 7946-0752 today": [("phone", "4402079460752")],
        "Ring 01.99.00.47.22 or (312) 555-0191": [("phone", "0199004722"), ("phone", "3125550191")],
        "Payroll has 000-98-4127 on file": [("idno", "000984127")],
        "The pass number is 00998644189.": [("idno", "00998644189")],
        "My mobile is 02079460219.": [("phone", "02079460219")],
        "It is DE00 6164 0046 1890 0000 00 here": [("idno", "de00616400461890000000")],
        "Send it to 46a Copper St., second bell": [("address", "46acopperst")],
        "Er wohnt Mühlenallee 37b.": [("address", "mühlenallee37b")],
        "au 30 bis rue des Tanneurs, troisième": [("address", "30bisruedestanneurs")],
        "en Calle del Molino, 189, tercer piso": [("address", "calledelmolino189")],
        "signed by Ann Poe and Lee, Bob": [("name", "annpoe"), ("name", "leebob")],
        "ANN POE": [("name", "annpoe")],
        "Hi Ann,\nBob": [],
        "Order 48-727, ticket #889, invoice INV-2024-327, 2024-09-17 19:24, 09.05.2025 um 16:50, build 10.2.6.1": [],
        "> Ring 020\n> 7946 0689 when": [],
    }
    wrong = {k: (found(k), v) for k, v in cases.items() if found(k) != v}
    assert not wrong
    long = "We looked at the report again and it seems that you should ring 020\n> 7946 0689 when it is here"
    assert found("> " + long) == [("phone", "02079460689")]


def test_lone_digits():
    cases = {
        "He lives at 5 Barley Close now.": [("address", "5barleyclose")],
        "en Calle del Molino, 7": [("address", "calledelmolino7")],
        "8b Rowan Close": [("address", "8browanclose")],
        "Er wohnt Mühlenallee 3.": [("address", "mühlenallee3")],
        "Ring +4 4 2 0 7 9 4 6 0 7 5 today": [("phone", "44207946075")],
        "Item 5 of the list": [],
    }
    wrong = {k: (found(k), v) for k, v in cases.items() if found(k) != v}
    assert not wrong
    assert P.redact(["Come to 5 Barley Close now"], lex()) == ["Come to [ADDRESS] now"]


def test_beliefs_on_a_tree_are_exact():
    rng = np.random.default_rng(0)
    unary = rng.normal(size=(4, 6)).astype(np.float32)
    a, b, kind = np.array([0, 1, 2]), np.array([1, 2, 3]), np.array([0, 1, 2])
    pair = P.HAND[kind]
    exact = np.zeros((4, 6))
    for ys in itertools.product(range(6), repeat=4):
        p = np.exp(sum(unary[i, y] for i, y in enumerate(ys)) + sum(pair[e, ys[a[e]], ys[b[e]]] for e in range(3)))
        for i, y in enumerate(ys):
            exact[i, y] += p
    got = np.exp(P.propagate(unary, a, b, kind, P.HAND, rounds=60))
    assert np.allclose(got / got.sum(1, keepdims=True), exact / exact.sum(1, keepdims=True), atol=1e-3)


def test_repeats_agree():
    s = "Maud Quill wrote. " + "x " * 60 + "Mail maud.quill@x.test to reach Maud Quill."
    assert ("name", "maudquill") in found(s)


def test_redaction_keeps_the_rest():
    text = "Ring 020 7946 0689, says Ann Poe.\r\nBye"
    assert P.redact([text, None, ""], lex()) == ["Ring [PHONE], says [NAME].\r\nBye", None, ""]


def test_frame(spark):
    rows = [(1, HEADER + "Call Ann Poe", "x"), (1, HEADER + "Call Ann Poe", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 100_000 + HEADER, "x"), (None, "Bob Lee", "x")]
    df = spark.createDataFrame(rows, "message_id bigint, text string, mention string")
    sent = spark.sparkContext.broadcast(P.lexicon(df, "text"))
    got = {(r.record_id, r.pii_type, r.mention) for r in P.personal(df, "message_id", ["text"], sent).collect()}
    assert {(1, "name", "annpoe"), (4, "email", "blee7xtest"), (None, "name", "boblee")} <= got and not any(r[0] in (2, 3) for r in got)
    assert P.personal(df.limit(0), "message_id", ["text"], sent).collect() == [] and not len(P.lexicon(df.limit(0), "text").keys)
    assert {r.record_id for r in P.personal(df, "message_id", ["text"], sent, True).collect()} == {1, 3, 4, None}


def test_skip_edges_find_names_that_no_header_has():
    text = "Zbyszko Krawcow wrote. " + "x " * 60 + "Mail zbyszko.krawcow@x.test again."
    assert ("name", "zbyszkokrawcow") in found(text)
    s, labels = P.mentions([text], lex())
    alone = np.array(s.unary).argmax(1)
    assert (alone != labels).any()  # the span's own potentials say none
    assert ("name", "zbyszkokrawcow") not in found(text.replace("zbyszko.krawcow", "office"))


def test_lexicon_counts_exactly(spark, monkeypatch):
    rows = [(HEADER,)] * 3 + [("From: Ann Poe <a.poe@x.test>\nFrom: Rare Once <r.once@x.test>",), (None,), ("",)]
    df = spark.createDataFrame(rows, "text string")
    one = P.lexicon(df, "text")
    names = ("Ann", "POE", "bob", "Lee", "Rare", "Once", "Other")
    assert [one.kind(x) for x in names] == [1, 2, 1, 2, 0, 0, 0]
    # More names than are sent as hashes go by a table of fixed size.
    monkeypatch.setattr(P, "MOST_NAMES", 1)
    monkeypatch.setattr(P, "PLACES", 1 << 20)
    table = P.lexicon(df, "text")
    assert table.table is not None and [table.kind(x) for x in names] == [1, 2, 1, 2, 0, 0, 0]


def test_edges_are_fitted_to_the_corpus():
    texts = [f"Ann Poe <ann.poe@x.test> said {k} and Ann Poe, {k}" for k in range(400)]
    pair = P.fit_edges(texts, lex())
    assert pair.shape == P.HAND.shape and np.isfinite(pair).all() and not np.allclose(pair, P.HAND)
    assert np.allclose(P.fit_edges([], lex()), P.HAND)


def test_edges_are_fitted_to_all_texts(spark):
    plain = [HEADER] * 2 + [f"Nothing here, {k}" for k in range(2_100)]
    more = [f"Ann Poe <ann.poe@x.test> said {k} and Ann Poe, {k}" for k in range(200)]
    long = ["Ann Poe <ann.poe@x.test> said it and Ann Poe too. " * 600]
    for rest in (more, long):
        df = spark.createDataFrame([(t,) for t in [*plain, *rest, None, ""]], "text string")
        one = P.lexicon(df.coalesce(1), "text")
        # As over the texts at once, whatever the partitions are, and other than without the last texts.
        assert (one.pair == P.fit_edges([*plain, *rest], one)).all()
        assert (one.pair == P.lexicon(df.repartition(3), "text").pair).all()
        assert not np.allclose(one.pair, P.fit_edges(plain, one), atol=0.05)


def test_edges_weigh_the_same_in_a_corpus_of_any_size():
    texts = [f"Ann Poe <ann.poe@x.test> said {k} and Ann Poe, {k}" for k in range(1_000)]
    sums = P.edge_sums(texts, lex())
    assert np.allclose(P.fitted(sums * 10), P.fitted(sums * 10_000), atol=1e-6)
    assert np.allclose(P.fitted(sums * 0), P.HAND)


def test_scanners_find_the_same_about_digits():
    rng = np.random.default_rng(0)
    parts = ["0", "00", "+", "12", "345", "1234", "12345678", "1234567890", "AB", "DE00", "X1Y", "-", " ", "  ", ".", ", ", "(", ")", "/", " Street", "rue de la ", "Calle del Molino", "ul. Nowa", "Mühlenallee", " Ring ", "ул. Мира", "д. ", "Ann", "@", "[at]", " dot ", " at ", "\n", "٣", "a"]
    for _ in range(3_000):
        view = "".join(rng.choice(parts, rng.integers(2, 30)))
        brute = [(m.start(), m.end(), y) for k, (y, x) in enumerate(P.SCANNERS) if y != P.EMAIL or (P._AT, P._DOT)[k].search(view) for m in x.finditer(view)]
        assert sorted(P.scanned(view)) == sorted(brute)
