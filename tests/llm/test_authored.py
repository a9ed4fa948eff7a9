from lettermill.llm.authored import KINDS, newly_written, spans

PROSE = "We looked at the report again and it seems that it needs one more signature before Monday."
SIG = "--\nAnn Poe\nBuyer, Orrin Mill\nTel. 020 7946 0219\n46a Copper Road"
NOTICE = "This message is meant only for the addressee and may be confidential; if you got it by mistake please tell us."


def kinds(text, markup=False):
    return sorted({KINDS[y] for y, t in spans(text, markup) if y and t.strip()})


def authored(text, markup=False):
    return "\n".join(t for y, t in spans(text, markup) if y == 0).strip()


def test_text():
    cases = [
        (PROSE, []),
        (f"{PROSE}\n\nOn Mon, Jan 6, 2025 at 9:00 AM, Bob Lee <bob@x.test> wrote:\n> {PROSE}", ["history"]),
        (f"{PROSE}\n\n2025-06-06 7:27 GMT+02:00 Bob Lee <bob@x.test>:\n{PROSE}", ["history"]),
        (f"> {PROSE}\n> {PROSE}\n\n{PROSE}\n\n> {PROSE}\n> {PROSE}", ["history"]),
        (f"{PROSE}\n\n---- Mensaje original ----\nDe: Bob <bob@x.test>\nAsunto: x\n\n{PROSE}", ["history"]),
        (f"{PROSE}\n\n{SIG}", ["signature"]),
        (f"{PROSE}\n\nAnn Poe\nBuyer | Orrin Mill\nann@x.test", ["signature"]),
        (f"{PROSE}\n\nSent from my pocket phone", ["signature"]),
        (f"{PROSE}\n\nKind regards,\nAnn", []),
        (f"{PROSE}\n\n{NOTICE}", ["disclaimer"]),
        (f"{PROSE}\n\n{SIG}\n\nFrom: Bob <bob@x.test>\nSent: Monday\nTo: Ann\nSubject: x\n\n{PROSE}\n\n{NOTICE}", ["disclaimer", "history", "signature"]),
        # what only looks so
        (f"{PROSE}\nOn Tuesday the night shift wrote: nothing to report.", []),
        (f"{PROSE}\nFrom: the gate, to: the yard.", []),
        (f"{PROSE}\n> 5 boxes are left, not > 8.", []),
        (f"{PROSE}\n-- and that is all I know.\n_____ fill in your own number here", []),
        (f"{PROSE}\nKeep this confidential between us, please.\nCan you unsubscribe me from the rota?", []),
        (f"{PROSE}\n\n| a | b |\n|:---|---:|\n| c | 4 |", []),
        ("", []),
        ("\r\n \r\n", []),
    ]
    wrong = [(t, kinds(t), k) for t, k in cases if kinds(t) != k]
    assert not wrong
    assert authored(f"{PROSE}\n\n{SIG}") == PROSE and authored(f"> {PROSE}\n> {PROSE}\n\nMy answer\n\n> {PROSE}") == "My answer"


def test_html():
    assert kinds(f"<div>{PROSE}</div><blockquote>{PROSE}</blockquote>", True) == ["history"]
    assert kinds(f'<div>{PROSE}</div><div class="gmail_signature"><div>Ann Poe</div><div>Buyer, Orrin Mill</div></div>', True) == ["signature"]
    assert kinds(f"<p>{PROSE}</p><p>{NOTICE}</p>", True) == ["disclaimer"]
    assert authored(f"<p>{PROSE}</p><BLOCKQUOTE>old</BLOCKQUOTE><p>Bye</p>", True).split() == (PROSE + " Bye").split()
    assert kinds(f"<p>{PROSE}</p><p>&gt; 5 boxes are left, not &gt; 8.</p>", True) == []
    assert kinds("<div>" * 900 + PROSE, True) == []


def test_frame(spark):
    rows = [(1, f"{PROSE}\n\n{SIG}", f"<p>{PROSE}</p>", "x"), (1, f"{PROSE}\n\n{SIG}", None, "x"), (2, "", "", "x"), (3, None, None, "x"), (4, (PROSE + "\n") * 3000 + "> a b\n" * 3000, None, "x"), (None, NOTICE, None, "x")]
    df = spark.createDataFrame(rows, "message_id bigint, text string, html string, kinds string")
    got = {(r.record_id, r.field): (r.authored, r.kinds) for r in newly_written(df, "message_id", {"text": False, "html": True}).collect()}
    assert got[1, "text"] == (PROSE, ["signature"]) and got[1, "html"] == (PROSE, []) and got[2, "text"] == ("", []) and got[None, "text"][1] == ["disclaimer"] and got[4, "text"][1] == ["history"]
    assert (3, "text") not in got
    assert {r.record_id for r in newly_written(df, "message_id", {"text": False}, True).collect()} == {1, 4, None}
    assert newly_written(df.limit(0), "message_id", {"text": False}).collect() == []
