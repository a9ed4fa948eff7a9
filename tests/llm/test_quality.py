from functools import reduce

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm.quality import COUNTS, count_texts, cuts, finish, merge, partials, quality_counts, ratios, tree

PROSE = "It was stated by the harbour board that\nthe east pier will be repaired before the\nwinter, and that the cost is not known."
LIST = "1. the east pier\n2. the old mill\n3. the school\nArr. Kestrel, Poe, from Orrin"
TABLE = "Wheat   16 4  20 0  391\nMon 3 ........ 3.53 1.27 21ft\nOrrin | 87 | 69 | 48\n30.86\t45\t63\tS.\t0.54"
JUNK = "ttt tt .\n|||| |\n~:l^ !` \\^-`,\nN%o| |iqorc^ B0ru#ng h;c~ es"


def kind(text):
    c = dict(zip(COUNTS, count_texts([text])[0].tolist()))
    return max(("n_list", "n_table", "n_junk"), key=c.get) if max(c["n_list"], c["n_table"], c["n_junk"]) * 2 > c["n_lines"] else "prose"


def test_kinds():
    assert [kind(x) for x in (PROSE, LIST, TABLE, JUNK)] == ["prose", "n_list", "n_table", "n_junk"]


def test_counts():
    got = dict(zip(COUNTS, count_texts(["The cat sat.\n\nOn it"])[0].tolist()))
    assert got == {"n_lines": 2, "n_words": 5, "word_chars": 13, "n_chars": 19, "n_symbols": 1, "n_punct_lines": 1, "n_common": 3, "n_list": 0, "n_table": 0, "n_junk": 0, "n_mirrored": 0}


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab T1.,|\n-\t\0", max_size=200), st.integers(8, 40))
def test_chunks_merge_to_the_whole(text, size):
    chunks = list(cuts(text, size))
    assert "".join(chunks) == text
    if max(map(len, text.replace("\n", " ").split(" ")), default=0) >= size:
        return  # a word longer than a chunk is defined to be cut
    parts = partials(chunks)
    each = [parts.take(np.array([k])) for k in range(len(chunks))]
    left, right = reduce(merge, each), reduce(lambda b, a: merge(a, b), reversed(each))
    whole = count_texts([text], 1 << 20).tolist()
    assert finish(left).tolist() == finish(right).tolist() == finish(tree(parts, np.zeros(len(chunks), np.int64))).tolist() == whole


def test_long_word_counts_once_a_chunk():
    c = dict(zip(COUNTS, count_texts(["ab" * 500 + " end"], 100)[0].tolist()))
    assert c["n_words"] == 11 and c["word_chars"] == 1003 and c["n_chars"] == 1004 and c["n_lines"] == 1


def test_frame_spreads_long_texts(spark):
    long = (PROSE + "\n") * 40 + LIST
    line = "the cost of it is not known and " * 200
    rows = [(1, PROSE, 0), (1, PROSE, 0), (2, None, 0), (3, "", 0), (4, long, 0), (4, long, 0), (None, long, 0), (None, long + TABLE, 0), (5, PROSE[::-1], 0), (6, line, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int")
    whole = sorted(map(str, quality_counts(df, "doc_id", "text").collect()))
    split = sorted(map(str, quality_counts(df, "doc_id", "text", chunk=100, spread=150, fan=4).collect()))
    assert whole == split and len(whole) == len(rows)
    out = {r.doc_id: r for r in ratios(quality_counts(df, "doc_id", "text")).collect()}
    assert out[2].n_words == 0 and out[2].mean_word_length is None and out[5].kind == "junk" and out[4].kind == "prose"
    assert quality_counts(df.limit(0), "doc_id", "text").collect() == []
