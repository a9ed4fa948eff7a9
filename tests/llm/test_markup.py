from lettermill.llm import markup
from lettermill.llm.markup import Deduced, clean, clean_text, residue, roles, slots, templates, token_statistics


def test_families():
    cases = {
        "a <b>c</b> d": ["html"], "a &amp; b &#8211; c": ["html"], "x <!-- y -->": ["html"], "## Head\ntext": ["markdown"], "a **b** c": ["markdown"], "see [this](https://x.test/a)": ["markdown"], "- [ ] do": ["markdown"],
        "Title\n=======\ntext": ["markdown"], "|:---|---:|": ["markdown"], "run `x.sh`": ["markdown"], "== Head ==\ntext": ["wiki"], "[[a|b]]": ["wiki"], "''it'' is": ["wiki"], "{{Box|n=1}}": ["wiki"], "{quote}a{quote}": ["wiki"], "[https://x.test a b]": ["wiki"],
        "\\section{A}": ["latex"], "\\begin{itemize}\n\\item a": ["latex"], "so $x_{1} = \\frac{a}{b}$": ["latex"], "\\[ E = \\alpha \\]": ["latex"],
        # plain
        "": [], "- a\n- b\n1. c": [], "--\nAnn": [], "____\n* * *": [], "> quoted": [], "4 < 5 and 7 > 6, so x*y stays": [], "from $12 to $15 (see note [1])": [], "C:\\temp\\run_07 and var_name_2": [], "Ann <ann@x.test> wrote:": [],
        "=== Sheet1 ===\na\tb\nc\td": [], "Use 5_000 units; ~10 and ^ keys": [], "Item #3 * 2 = 6, i.e. 100 % of it -- fine": [], "R&D and Q&A": [], "a;b;c\n1;2;3": [],
    }
    wrong = {k: residue(k) for k, v in cases.items() if residue(k) != v}
    assert not wrong


def test_structure_is_kept():
    text = slots("<h2>Head</h2><p>a <b>b</b></p><ul><li>one</li><li>two</li></ul><pre>x = 1</pre><p>c &lt; d</p>")
    assert [x for x in clean(text).split("\n") if x] == ["## Head", "a b", "- one", "- two", "```", "x = 1", "```", "c < d"]
    assert clean("== Head ==\n'''a''' [[b|c]]\n\\section{D}\n\\begin{equation}\nx\n\\end{equation}") == "# Head\na c\n# D\n$$\nx\n$$"
    assert clean("plain ") == "plain"


PAGE = '<html><body><x:frame><div class="top">{}</div></x:frame><p>{}</p></body></html>'


def test_frame(spark):
    rows = [(i, "h.test", PAGE.format("menu", f"text {i}"), "x") for i in range(6)] + [(100 + i, "g.test", f"<div>only {i}</div>", "x") for i in range(5)]
    rows += [(200, None, "<b>a</b> &lt;i&gt;b", "x"), (201, "h.test", None, "x"), (202, "h.test", "", "x"), (202, "h.test", "", "x"), (None, "q.test", "<jonas> said 'hi'", "x")]
    df = spark.createDataFrame(rows, "message_id bigint, host string, html string, text string")
    template = templates(token_statistics(df, "message_id", "host", "html"))
    own = {tuple(r.tags) for r in template.where("host = 'h.test'").collect()}
    assert any({"x:frame", "/x:frame", "html", "/html"} <= set(t) for t in own)
    got = {r.record_id: r for r in clean_text(df, "message_id", {"html": True}, Deduced(template), "host").collect()}
    # The host's own tags are template and go; a name in angle brackets elsewhere is text.
    assert got[0].text.split() == ["menu", "text", "0"] and got[200].families == ["html"] and got[202].text == "" and got[None].text == "<jonas> said 'hi'" and 201 not in got
    assert {r.record_id for r in clean_text(df, "message_id", {"html": True}, Deduced(template), "host", True).collect()} == {200}
    assert clean_text(df.limit(0), "message_id", {"html": True}, Deduced(templates(token_statistics(df.limit(0), "message_id", "host", "html"))), "host").collect() == []
    plain = clean_text(df.where("message_id = 200"), "message_id", {"html": False}, Deduced(template)).first()
    assert plain.families == ["html"]


def test_joined_templates_are_the_sent_ones(spark):
    rows = [(i, "h.test", PAGE.format("menu", f"text {i}")) for i in range(6)] + [(100, "g.test", "<x:frame>own</x:frame>"), (101, None, "<x:frame>none</x:frame>")]
    df = spark.createDataFrame(rows, "message_id bigint, host string, html string")
    # Over all hosts the tag stands in a class of its own.
    template = templates(token_statistics(df, "message_id", "host", "html")).persist()

    def texts(host, most):
        return {r.record_id: r.text for r in clean_text(df, "message_id", {"html": True}, Deduced(template, most), host).collect()}

    sent = texts("host", 100), texts(None, 100)
    joined = texts("host", 0), texts(None, 0)
    assert joined == sent and all("x:frame" not in t for x in joined for t in x.values())


def test_deep_pages():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000 + "</p>"
    counts, good = roles(deep)
    assert len(counts) == 40_001 and counts[("div", 0)] == [1, 0] and counts[("/div", 0)] == [1, 39_999] and not good
    assert slots(deep).strip() == "x"


def test_classes_nest(spark):
    page = "<x:page><x:head>h{0}</x:head><ul>{1}</ul><x:foot/></x:page>"
    rows = [(i, "h.test", page.format(i, "".join(f"<li>{k}</li>" for k in range(i % 3 + 1)))) for i in range(9)]
    df = spark.createDataFrame(rows, "message_id bigint, host string, html string")
    got = {tuple(r.tags): r for r in templates(token_statistics(df, "message_id", "host", "html")).where("host = 'h.test'").collect()}
    whole, item = got["x:page", "x:head", "/x:head", "ul", "/ul", "x:foot", "/x:page"], got["li", "/li"]
    assert whole.parent_id is None and item.parent_id == whole.class_id and whole.pages == item.pages == 9
