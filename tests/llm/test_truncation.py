import random

import numpy as np
import pandas as pd

from lettermill.llm.truncation import _lognormal_fit, fit_source, shape, truncated


def test_shapes():
    cases = {
        "All is done.": "sentence", "It goes on and": "line", "It goes on and…": "mark", "It goes on [...]": "mark", "Text.\n\n- one pier\n- two piers": "item", "a\tb\tc\nd\te\tf\ng\th": "short_row", "a\tb\tc\nd\te\tf\ng\th\ti": "row",
        "All is done.\n\nKind regards,\nAnn Poe": "name", "\\end{tabular}": "closed", "": "sentence",
    }
    assert {k: shape(k)[0] for k in cases} == cases


def test_censored_fit_recovers_the_law():
    r = np.random.default_rng(0)
    x = r.normal(7.0, 0.5, 20_000)
    limit = 7.3
    cens = x > limit
    mu, sd, _ = _lognormal_fit(np.minimum(x, limit), np.ones(len(x)), cens)
    assert abs(mu - 7.0) < 0.02 and abs(sd - 0.5) < 0.02


def test_limits():
    r = np.random.default_rng(1)
    n = np.exp(r.normal(7.2, 0.5, 4000)).astype(int)
    hist = lambda x: pd.DataFrame({"unit": "char", "length": x}).groupby(["unit", "length"]).size().reset_index(name="n")
    assert fit_source(hist(np.minimum(n, 1800)))["limit"].tolist() == [1800]
    assert len(fit_source(hist(n))) == 0


def test_limit_of_spread_cuts():
    r = np.random.default_rng(2)
    n = np.exp(r.normal(6.2, 0.6, 1200)).astype(int)
    # Every cut at another length below 1000, some lengths more often than any of them, one longer outlier.
    n = np.where(n > 980, 1000 - np.arange(len(n)) % 17, n)
    n = np.concatenate([n, np.repeat([210, 260, 310, 360, 410, 460, 510, 560], 40), [1900]])
    length, count = np.unique(n, return_counts=True)
    assert not np.isin(length[np.argsort(-count)][:8], np.arange(984, 1001)).any()
    got = fit_source(pd.DataFrame({"unit": "char", "length": length, "n": count}))
    assert len(got) == 1 and 992 <= got["limit"][0] <= 1000


def test_frame(spark):
    r = random.Random(5)
    word = lambda: r.choice(["pier", "mill", "harbour", "school", "board", "winter"])
    texts = [". ".join(" ".join(word() for _ in range(9)) for _ in range(r.randint(2, 30))) + "." for _ in range(400)]
    rows = [(i, t[:700] if i % 2 else t, "extracted", "x") for i, t in enumerate(texts)]
    rows += [rows[0], (1000, None, "failed", "x"), (1001, "", "extracted", "x"), (1002, "a text that ends", "extracted", "x"), (1003, "whole text.", "failed", "x"), (None, "whole text.", "extracted", "x")]
    results = spark.createDataFrame(rows, "attachment_id bigint, extraction string, status string, source string")
    sources = spark.createDataFrame([(i, "limited" if i % 2 else "free") for i in range(400)] + [(1002, None)], "attachment_id bigint, source_system string")
    got = {x.record_id: x for x in truncated(results, sources, "attachment_id", "extraction", "source_system", "status").collect()}
    assert {k for k, v in got.items() if v.truncated} == {i for i in range(1, 400, 2) if len(texts[i]) > 700} | {1002, 1003}
    assert 1000 not in got and 1001 not in got and got[1002].source == "(none)" and got[1].limit == 700
    assert truncated(results.limit(0), sources.limit(0), "attachment_id", "extraction", "source_system").collect() == []


def test_short_last_lines(spark):
    """A line without a stop is whole if its last word mostly ends sentences elsewhere."""
    texts = [(k, "We will look at the plan with the supplier. You may have it in the office. It is the supplier again. We go to the office.", "s") for k in range(40)]
    texts += [(100, "First a line.\nwe meet the supplier", "s"), (101, "First a line.\nwe meet the sup", "s"), (102, "First a line.\nand then we go with the", "s"), (103, "First a line.\nwe go t", "s")]
    df = spark.createDataFrame(texts, "a bigint, t string, s string")
    got = {r.record_id: r.truncated for r in truncated(df, df, "a", "t", "s").collect()}
    assert [got[k] for k in (0, 100, 101, 102, 103)] == [False, False, True, True, True]
