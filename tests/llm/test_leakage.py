import random

from lettermill.llm.leakage import alike, build, leaked, leaks, stream

R = random.Random(4)
NAMES = [a + b + c for a in ("Nes", "Hol", "Bar", "Cras", "Dul", "Ulm", "Fal", "Jar", "Sel", "Yar") for b in ("in", "ar", "ov", "er") for c in ("court", "wick", "bell", "stock", "gate", "rell", "thorp")]
VERBS = ["took a lease of", "gave a full account of", "spoke in favour of", "found considerable damage at", "promised to report upon"]
PLACES = ["the ropewalk beside the canal", "the old corn exchange", "the reading room in the lane", "a schooner laden with slate", "the bandstand in the gardens"]
TAILS = ["which has been the talk of the district", "but no lives were lost", "whereupon the chairman left the room", "for reasons that were not made public"]


def sentence(names):
    return f"Miss {R.choice(names)} {R.choice(VERBS)} {R.choice(PLACES)} near {R.choice(names)}, {R.choice(TAILS)}."


ITEMS = [(k, " ".join(sentence(NAMES) for _ in range(6))) for k in range(40)]
OTHER = [a + b + c for a in ("Tor", "Wen", "Gor", "Kel") for b in ("il", "un", "es") for c in ("dale", "mir", "vane", "heim")]
R.shuffle(NAMES)


def wrapped(words, width=7, hyphen=True):
    lines = [words[k : k + width] for k in range(0, len(words), width)]
    out = [" ".join(x) for x in lines]
    if hyphen and len(out) > 1 and len(lines[0][-1]) > 5:
        w = lines[0][-1]
        out[0] = out[0][: -len(w)] + w[:3] + "-"
        out[1] = w[3:] + " " + out[1]
    return "\n".join(out)


def page(n=None, item=0, at=5, noise=0.0):
    words = " ".join(sentence(OTHER) for _ in range(8)).split()
    if n:
        part = ITEMS[item][1].split()[at : at + n]
        part = [w[:1] + "c" + w[2:] if len(w) > 4 and R.random() < noise else w for w in part]
        words[60:60] = part
    return wrapped(words)


def test_runs():
    ix = build(ITEMS)
    for n in (22, 30, 50):
        got = {i: run for i, kind, run, _, _ in leaks(page(n), None, ix) if kind == "verbatim"}
        assert abs(got[0] - n) <= 2, (n, got)
    assert all(run < 20 for _, kind, run, _, _ in leaks(page(), None, ix) if kind == "verbatim")
    assert all(run < 20 for _, kind, run, _, _ in leaks(page(14), None, ix) if kind == "verbatim")
    assert {i: r for i, _, r, _, _ in leaks(page(40, noise=0.1), None, ix)}[0] >= 30


def test_misread_in_every_window():
    ix = build(ITEMS)
    part, slot = ix.words[0][5:35], ix.slots[0][5:35]
    raw = ITEMS[0][1].split()[5:35]
    plain = [k for k, s in enumerate(slot) if not s and len(part[k]) > 3]
    for k in plain[::2]:
        raw[k] = raw[k][:1] + "c" + raw[k][2:]
    first = slot.index(True)
    raw[first] = raw[first][:2] + "q" + raw[first][3:]
    text = wrapped([*sentence(OTHER).split(), *raw, *sentence(OTHER).split()], hyphen=False)
    got = {i: run for i, kind, run, _, n in leaks(text, None, ix) if kind == "verbatim"}
    assert not any(n for i, kind, _, _, n in leaks(text, None, ix) if i == 0 and kind == "verbatim") and got[0] >= 26
    # Names of which two letters differ are others.
    for k, s in enumerate(slot):
        if s:
            raw[k] = raw[k][:1] + "qx" + raw[k][3:]
    text = wrapped([*sentence(OTHER).split(), *raw, *sentence(OTHER).split()], hyphen=False)
    assert all(run < 20 for _, kind, run, _, _ in leaks(text, None, ix) if kind == "verbatim")


def test_columns_and_adverts():
    ix = build(ITEMS)
    words = ITEMS[3][1].split()[:48]
    left = [" ".join(words[k : k + 6]) for k in range(0, 48, 6)]
    right = [" ".join(sentence(OTHER).split()[:6]) for _ in left]
    merged = "\n".join(f"{a}  | {b}" for a, b in zip(left, right))
    assert {i: r for i, _, r, _, _ in leaks(merged, None, ix)}[3] >= 44
    both = [x for p in zip(left, right) for x in p]
    assert {i: r for i, _, r, _, _ in leaks("\n".join(both), [100, 700] * len(left), ix)}[3] >= 44
    advert = "\n".join([*left[:4], "GRAND SALE", "Box 80", *left[4:]])
    assert {i: r for i, _, r, _, _ in leaks(advert, None, ix)}[3] >= 44


def test_other_names_are_no_verbatim_leak():
    ix = build(ITEMS)
    text = ITEMS[5][1]
    for k, name in enumerate(NAMES):
        text = text.replace(name, OTHER[k % len(OTHER)])
    assert all(run < 20 for _, kind, run, _, _ in leaks(text, None, ix) if kind == "verbatim")


def test_words():
    assert stream("a big con-\ncert hall\n\nof the so- \nciety") == ["a", "big", "concert", "hall", "of", "the", "society"]
    assert alike("chairman", "chairrnan") and alike("board", "hoard") and not alike("chairman", "district") and not alike("12", "13")


def test_frame(spark):
    rows = [(1, page(40, 7), "x"), (1, page(40, 7), "x"), (2, page(), "x"), (3, None, "x"), (4, "", "x"), (5, "word " * 200_000, "x"), (None, page(40, 7), "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, run string")
    items = spark.createDataFrame([*ITEMS, (900, None), (901, ""), ITEMS[0]], "item_id bigint, passage string")
    got = {(r.doc_id, r.item_id) for r in leaked(docs, items, "doc_id", "text", "item_id", "passage", None, 20).where("kind = 'verbatim'").collect()}
    assert got == {(1, 7), (None, 7)}
    assert leaked(docs, items.limit(0), "doc_id", "text", "item_id", "passage").collect() == [] and leaked(docs.limit(0), items, "doc_id", "text", "item_id", "passage").collect() == []


def test_passage_without_names():
    plain = "we walked along the river until the evening light was gone and then we sat by the fire and talked of old times while the rain went on and nobody wanted to leave"
    ix = build([*ITEMS, (99, plain)])
    text = wrapped(sentence(OTHER).split() + plain.split() + sentence(OTHER).split())
    assert {i: r for i, k, r, _, _ in leaks(text, None, ix) if k == "verbatim"}[99] >= 28


def test_reparameterised_item():
    fresh = iter([a + b + c for a in ("Mar", "Lud", "Pel", "Vis", "Ost") for b in ("in", "ar", "ov", "er", "um") for c in ("court", "wick", "bell", "stock", "gate", "rell", "thorp")])
    items = [(k, " ".join(f"Miss {next(fresh)} {VERBS[k]} {PLACES[n]} near {next(fresh)}, {TAILS[(n + k) % 4]}." for n in range(5))) for k in range(5)]
    ix = build(items)
    own = items[0][1].split()
    put = {w: OTHER[k] for k, w in enumerate(dict.fromkeys(w.strip(".,") for w, s in zip(own, ix.slots[0]) if s))}
    assert len(put) == 10
    page_of = lambda put: wrapped(sentence(OTHER).split() + [w.replace(w.strip(".,"), put.get(w.strip(".,"), w.strip(".,"))) for w in own] + sentence(OTHER).split(), hyphen=False)
    assert {i: k for i, k, r, _, _ in leaks(page_of(put), None, ix) if r >= 20} == {0: "reparameterised"}
    # All values replaced by one word: another text of the template, not this item's.
    assert not [i for i, _, r, _, _ in leaks(page_of(dict.fromkeys(put, OTHER[0])), None, ix) if r >= 20]
