"""Text cut off by field limits (problem 7).

Lengths of complete values follow a lognormal law of their source; a source with
a field limit L turns every longer value into one of about L characters, so its
lengths are right-censored there.  For each source the candidate limits (in
characters and in UTF-8 bytes) are tried: the law is fitted by maximum likelihood
with the mass in the window under L as censored, and the limit stands where the
likelihood beats the fit without one.  A value's posterior of being cut joins the
censored share of its length with the evidence of its ending: inside a sentence,
a list item or row that occurs longer elsewhere, an ellipsis put on by the cutter.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import cut_lineage, load, map_batches

#: A cutter that stops at the last whole word, or adds a mark, ends up to so much off the limit.
BELOW, ABOVE = 16, 8
_MARK = re.compile(r"(?:\s*\[(?:\.\.\.|…|cut|truncated)\]|(?<=[^\W_])(?:\.\.\.|…)|\s+(?:\.\.\.|…))\s*$")
_SENTENCE = re.compile(r"[.!?][\"'”»’)\]*_]*\s*$")
_CLOSED = re.compile(r"[\]})>|`$*_~\\]\s*$")
_BULLET = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)]|#|\\item)\s+")
_DELIMITERS = "\t;,|"
_NAME = re.compile(r"[^\W\d_][\w.'’-]*(?:,?\s+[^\W\d_][\w.'’-]*){0,3}$")
SHAPES = ("mark", "sentence", "closed", "row", "short_row", "item", "name", "line", "open")


#: A word that was misread tells nothing of its being whole.
_GARBLED = re.compile(r"[^\w.'’&/()-]|[a-zà-ÿ][а-я]|[а-я][a-zà-ÿ]|�")


def last_word(unit: str) -> str:
    words = unit.split()
    word = words[-1].strip(".,;:").casefold() if words else ""
    return "" if _GARBLED.search(word) else word


def shape(text: str) -> tuple[str, str]:
    """(kind of ending, last word of its list item or cell, to be looked up among those of the corpus)."""
    body = text.rstrip()
    if not body:
        return "sentence", ""
    if _MARK.search(text):
        return "mark", ""
    cut = body.rfind("\n")
    line, before = body[cut + 1 :], body[:cut].rstrip("\n") if cut > 0 else ""
    prev = before[before.rfind("\n") + 1 :]
    earlier = before[: -len(prev) - 1]
    earlier = earlier[earlier.rfind("\n") + 1 :]
    for d in _DELIMITERS:
        n = prev.count(d)
        if n >= 2 and earlier.count(d) == n and not (d == "|" and line.endswith("|")):
            m = line.count(d)
            if m < n and not _SENTENCE.search(body):
                return "short_row", ""
            if m == n:
                return "row", last_word(line[line.rfind(d) + 1 :])
    if _SENTENCE.search(body) and not _BULLET.match(line):
        return "sentence", ""
    if _CLOSED.search(body):
        return "closed", ""
    m = _BULLET.match(line)
    if m and len(line) < 120:
        return "item", last_word(line[m.end() :])
    # A closing with a name below it.
    if len(line) < 60 and _NAME.match(line) and prev and len(prev) < 60 and (prev.rstrip().endswith(",") or not _SENTENCE.search(prev)) and "\n\n" in text[-len(line) - len(prev) - 6 :]:
        words = line.replace(",", " ").split()
        if all(w[0].isupper() for w in words):
            return "name", ""
    # A short line of its own may be whole without a stop: its last word tells.
    return ("line", last_word(line)) if len(line) < 120 else ("open", "")


def units(text: str) -> list[str]:
    """Last words of list items and of rows, but for the value's last line."""
    out = []
    for line in text.split("\n")[:-1]:
        m = _BULLET.match(line)
        if m and len(line) < 120:
            out.append(last_word(line[m.end() :]))
        else:
            for d in _DELIMITERS:
                if line.count(d) >= 2:
                    out.append(last_word(line[line.rfind(d) + 1 :]))
                    break
    return [u for u in out if u]


#: A word and what stands right behind it.
_SPOKEN = re.compile(r"([^\s.!?,;:]+)([.!?](?=\s|\Z))?")


def closings(text: str) -> dict[str, list[int]]:
    """Of each word: how often it occurs, and how often it ends a sentence."""
    out: dict[str, list[int]] = {}
    for word, end in _SPOKEN.findall(text):
        n = out.setdefault(word.casefold(), [0, 0])
        n[0] += 1
        n[1] += end != ""
    return out


def _lognormal_fit(x: np.ndarray, n: np.ndarray, censored: np.ndarray) -> tuple[float, float, float]:
    """(mu, sigma, log-likelihood) of right-censored log-lengths by EM from sufficient counts."""
    free = ~censored
    if n[free].sum() < 5:
        return 0.0, 1.0, -math.inf
    mu, sd = np.average(x[free], weights=n[free]), 0.6
    phi = lambda z: np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    tail = lambda z: np.maximum(0.5 * np.array([math.erfc(v / math.sqrt(2)) for v in z]), 1e-12)
    for _ in range(60):
        z = (x[censored] - mu) / sd
        h = phi(z) / tail(z)
        m1 = mu + sd * h
        m2 = mu * mu + sd * sd + sd * (x[censored] + mu) * h
        total = n.sum()
        new = (np.dot(n[free], x[free]) + np.dot(n[censored], m1)) / total
        var = (np.dot(n[free], x[free] ** 2) + np.dot(n[censored], m2)) / total - new * new
        done = abs(new - mu) < 1e-7
        mu, sd = new, math.sqrt(max(var, 1e-4))
        if done:
            break
    z = (x[censored] - mu) / sd
    ll = float(np.dot(n[free], -0.5 * ((x[free] - mu) / sd) ** 2 - math.log(sd) - x[free] - 0.919) + np.dot(n[censored], np.log(tail(z))))
    return float(mu), sd, ll


def crowded(length: np.ndarray, n: np.ndarray, often: set[int]) -> list[int]:
    """Lengths, of increasing ``length`` with counts ``n``, whose window holds many values, the lengths below it few and those above it hardly any.

    Those in ``often`` all; of others, whose windows overlap, the fullest.
    """
    below = np.concatenate([[0.0], np.cumsum(n)])  # values below each place
    upto = lambda x: below[np.searchsorted(length, x, "left")]
    low, high = upto(length - BELOW), upto(length + ABOVE + 1)
    share = high - low
    fit = np.flatnonzero((share >= 5) & (below[-1] - high <= 0.02 * share) & (share >= 4 * (low - upto(length - 6 * BELOW)) / 5))
    out = [x for x in length[fit].tolist() if x in often]
    for k in sorted(fit.tolist(), key=lambda k: (-share[k], -n[k], -length[k])):
        if all(abs(length[k] - x) > BELOW + ABOVE for x in out):
            out.append(int(length[k]))
    return out


def fit_source(hist: pd.DataFrame) -> pd.DataFrame:
    """Limits of one source from its histogram of (unit, length, n)."""
    rows = []
    for unit, g in hist.groupby("unit"):
        g = g[g["length"] > 0].sort_values("length")
        length, n = g["length"].to_numpy(np.int64), g["n"].to_numpy(np.float64)
        if n.sum() < 20:
            continue
        # A limit's window holds far more values than the law allows and hardly any stand above it.
        top = int(length[-1])
        often = {top, *(c for c in length[np.argsort(-n)][:8].tolist())}
        # Cuts spread over many lengths pile up at none of them, but crowd a window.
        marks = np.array(sorted({*often, *crowded(length, n, often)}))
        x = np.log(length)
        none = np.zeros(len(x), bool)
        mu0, sd0, ll0 = _lognormal_fit(x, n, none)
        best = None
        for limit in marks:
            above = n[length > limit + ABOVE].sum()
            window = (length >= limit - BELOW) & (length <= limit + ABOVE)
            share = n[window].sum()
            side = n[(length >= limit - 6 * BELOW) & (length < limit - BELOW)].sum() / 5
            if above > 0.02 * share or share < 5 or share < 4 * side:
                continue
            cens = length >= limit - BELOW
            y = np.where(cens, math.log(max(limit - BELOW, 1)), x)
            mu, sd, ll = _lognormal_fit(y, n, cens)
            # Censored values carry the density of their spread over the window.
            gain = ll - share * math.log(BELOW + ABOVE) - ll0
            expected = share and (BELOW + 1) * math.exp(-0.5 * ((math.log(limit) - mu) / sd) ** 2) / (sd * math.sqrt(2 * math.pi) * limit) * n.sum()
            if gain > 2 and (best is None or gain > best["gain"]):
                spread = float(np.average((length[window] - limit) ** 2, weights=n[window]) ** 0.5)
                best = {"unit": unit, "limit": int(limit), "gain": gain, "censored": float(max(share - expected, 0.0)), "natural": float(expected), "spread": spread, "mu": mu, "sigma": sd}
        if best:
            rows.append(best)
    cols = ["unit", "limit", "gain", "censored", "natural", "spread", "mu", "sigma"]
    out = pd.DataFrame(rows, columns=cols)
    if len(out):  # the unit that tells more is the one the system counts in
        out = out.sort_values("gain", ascending=False).head(1)
    return out


def limits(values: DataFrame) -> DataFrame:
    """source, unit, limit, ...; from values with columns source, n_chars, n_bytes.  A source's histogram has a row a length."""
    long = values.select("source", F.explode(F.array(F.struct(F.lit("char").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("byte").alias("unit"), F.col("n_bytes").alias("length")))).alias("u"))
    hist = long.groupBy("source", "u.unit", "u.length").agg(F.count("*").alias("n"))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = fit_source(pdf)
        out.insert(0, "source", key[0])
        return out

    return hist.groupBy("source").applyInPandas(fit, "source string, unit string, limit bigint, gain double, censored double, natural double, spread double, mu double, sigma double")


#: Log odds of a cut from the kind of ending (complete texts end so rarely, or always).
EVIDENCE = {"mark": 6.0, "sentence": -4.0, "closed": -3.0, "row": -3.0, "short_row": 5.0, "item": -3.0, "name": -3.0, "line": 5.0, "open": 5.0}
#: Share of its occurrences in which a word ends a sentence, from which on a line that ends in it is whole.
ENDS = 0.25
#: Letters of such a word: shorter ones are as well the beginnings of others.
LEAST_LETTERS = 3


def truncated(results: DataFrame, sources: DataFrame, record_id: str, text: str, source: str, status: str | None = None) -> DataFrame:
    """record_id, source, posterior, truncated - one row per record with a text.

    results has record_id and text (repeated rows count once), sources record_id
    and source (null: a source of its own).  status: a column that may say "failed".  Null and empty texts are left out;
    other columns are ignored.
    """
    src = results.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(text).cast("string").alias("text"), (F.coalesce(F.col(status) == "failed", F.lit(False)) if status else F.lit(False)).alias("broken")).where("text is not null and text <> ''")

    def ending(batch: pa.RecordBatch) -> dict[str, list]:
        texts = batch.column(1).to_pylist()
        kinds = [shape(t) for t in texts]
        return {
            "record_id": batch.column(0).to_pylist(),
            "broken": batch.column(2).to_pylist(),
            "n_chars": [len(t) for t in texts],
            "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
            "ending": [k[0] for k in kinds],
            "last": [k[1] for k in kinds],
        }

    ends = map_batches(src, ending, "record_id bigint, broken boolean, n_chars bigint, n_bytes bigint, ending string, last string").dropDuplicates(["record_id"])
    where = sources.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(source).cast("string").alias("source")).dropDuplicates(["record_id"])
    # Lengths and endings are read several times below; the texts they come from need not be.
    ends = cut_lineage(ends.join(where, "record_id", "left").withColumn("source", F.coalesce("source", F.lit("(none)"))))

    # How often each word ends a list item or row in the corpus, how often it occurs, and how often it ends a sentence.
    def inner(batch: pa.RecordBatch) -> dict[str, list]:
        count: dict[str, list[int]] = {}
        for t in batch.column(1).to_pylist():
            for u in units(t):
                count.setdefault(u, [0, 0, 0])[0] += 1
            for w, (n, e) in closings(t).items():
                c = count.setdefault(w, [0, 0, 0])
                c[1] += n
                c[2] += e
        return {"unit": list(count), "n": [c[0] for c in count.values()], "said": [c[1] for c in count.values()], "closed": [c[2] for c in count.values()]}

    whole = map_batches(src, inner, "unit string, n bigint, said bigint, closed bigint").groupBy("unit").agg(F.sum("n").alias("n_whole"), F.sum("said").alias("n_said"), F.sum("closed").alias("n_closed"))
    asked = ends.where("ending in ('row', 'item', 'line')").select(F.col("last").alias("unit")).distinct()
    known = asked.join(whole, "unit", "left").select(F.col("unit").alias("last"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_whole", "n_said", "n_closed")])
    # A word that ends items elsewhere ends a whole one here; one that never does is the rest of a longer one.
    ends = ends.join(known, "last", "left")
    fits = limits(ends)
    joined = ends.join(F.broadcast(fits) if fits.count() <= 100_000 else fits, "source", "left")
    size = F.when(F.col("unit") == "byte", F.col("n_bytes")).otherwise(F.col("n_chars"))
    near = F.col("limit").isNotNull() & size.between(F.col("limit") - BELOW, F.col("limit") + ABOVE)
    at = near & (F.abs(size - F.col("limit")) <= F.greatest(F.lit(0.0), F.least(F.col("spread"), F.lit(8.0))))
    cens = F.when(near, F.log((F.col("censored") + 0.5) / (F.col("natural") + 0.5))).otherwise(F.lit(-3.0)) + F.when(at & (F.col("spread") < 1.5), F.lit(2.0)).otherwise(F.lit(0.0))
    kind = F.lit(0.0)
    for name, w in EVIDENCE.items():
        kind = F.when(F.col("ending") == name, F.lit(w)).otherwise(kind)
    kind = F.when(F.col("ending").isin("row", "item") & (F.col("last") != "") & (F.coalesce("n_whole", F.lit(0)) == 0), F.lit(5.0)).otherwise(kind)
    kind = F.when((F.col("ending") == "line") & (F.length("last") >= LEAST_LETTERS) & (F.col("n_closed") >= 2) & (F.col("n_closed") >= ENDS * F.col("n_said")), F.lit(EVIDENCE["item"])).otherwise(kind)
    odds = cens + kind + F.when(F.col("broken"), F.lit(8.0)).otherwise(F.lit(0.0))  # text kept from a file that ended too soon
    out = joined.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.select("record_id", "source", "ending", "n_chars", "n_bytes", "limit", "unit", "posterior", (F.col("posterior") > 0.5).alias("truncated"))


def _of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(load(spark, sf_dir, "attachment_results"), load(spark, sf_dir, "attachments"), "attachment_id", "extraction", "source_system", "status")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir).where("truncated").select(F.col("record_id").alias("attachment_id")).distinct()


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source_system: texts, truncated ones, and their share."""
    cut = F.col("truncated").cast("bigint")
    return _of(spark, sf_dir).groupBy(F.col("source").alias("source_system")).agg(F.count("*").alias("n_texts"), F.sum(cut).alias("n_truncated"), F.avg(cut.cast("double")).alias("share"), F.max("limit").alias("field_limit"), F.max("unit").alias("limit_unit"))
