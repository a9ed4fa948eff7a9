"""Missing or wrong document language labels (problem 6).

A paragraph's features are the character n-grams of 2 to 4 letters that occur in
it (blended-spectrum presence kernel), hashed to ``DIM`` places.  Nyström
landmarks are paragraphs of a bounded training sample; one-versus-rest kernel
ridge regression gives six weight vectors over them, which a product with the
landmarks' features turns into weights over places.  Paragraphs are scored in
batches: presence matrix times weight matrix, divided by the paragraph's norm.

Training labels are the declared ones, which are partly wrong: after a first fit
the sample is relabelled where the model contradicts it clearly, and fitted again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import load, map_batches, one_blas_thread

LANGS = ("en", "de", "fr", "es", "pl", "ru")
DIM, ORDERS, LEAST_WORDS = 1 << 13, (2, 3, 4), 12
#: Bound of the training sample, of the landmarks of a language, and the ridge.
SAMPLE, LANDMARKS, RIDGE, SEED = 400, 80, 1e-2, 7
TRAIN_CHARS = 20_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_QUOTE = re.compile(r"^[ \t]*(?:[>|][ \t]?)+")
_SKIP = re.compile(r"<[^<>\s]+@[^<>\s]+>|^\s*[^\W\d_][\w .-]{0,14}:\s\S.{0,80}$|^\s*(?:[-*+•#]|\d{1,2}[.)])\s|^\s*(?:-{3,}|_{3,}|={3,})|^\s*[|{}\\\[!=`]|[\w.+-]+@[\w-]+\.\w+\s*[>)]?:?\s*$")
#: Markup and addresses are no words.
_SIGN = re.compile(r"[<{\\$@\[|]|://")
_MARKUP = re.compile(r"<[^<>]*>|\{\{.*?\}\}|\\[A-Za-z]+|\$[^$]*\$|https?://\S+|\S+@\S+|\[\[|\]\]|\{[^{} ]*\}|\|[^|]*\|")
_WORD = re.compile(r"[^\W\d_]{2,}|[^\W\d_]")
_SENTENCE_END = re.compile(r"[.!?…:;][\"'”»)]*\s*$")


def paragraphs(text: str) -> list[tuple[int, str]]:
    """(place of the first line, text) of each paragraph; wrapped lines are joined, quote marks taken off."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out: list[tuple[int, str]] = []
    buf: list[str] = []
    first = 0
    depth = -1
    widths = [len(x) for x in lines]
    wrap = max((w for w in widths if w <= 100), default=0) if sum(w > 100 for w in widths) * 4 < sum(w > 40 for w in widths) else 0

    def flush() -> None:
        if buf:
            out.append((first, " ".join(buf)))
            buf.clear()

    prev = ""
    for k, raw in enumerate(lines):
        m = _QUOTE.match(raw)
        body = raw[m.end() :] if m else raw
        d = m[0].count(">") + m[0].count("|") if m else 0
        line = body.strip()
        if not line or _SKIP.search(line) and len(line) < 160:
            flush()
            prev = ""
            depth = d
            continue
        if buf and (d != depth or not wrap or len(prev) > wrap + 4 or (_SENTENCE_END.search(prev) and len(prev) + 1 + len(line.split(None, 1)[0]) < wrap)):
            flush()
        elif buf and len(prev) < max(45, 0.6 * wrap):  # a line this short wasn't wrapped
            flush()
        if not buf:
            first = k
        buf.append(line)
        prev, depth = raw.rstrip(), d
    flush()
    return out


def prose(text: str, least: int = LEAST_WORDS) -> list[tuple[int, str, int]]:
    """(place, text, words) of the paragraphs of prose with ``least`` words or more."""
    out = []
    for k, p in paragraphs(text):
        n = len(_WORD.findall(_MARKUP.sub(" ", p) if _SIGN.search(p) else p))
        if n >= least:
            out.append((k, p, n))
    return out


def presence(texts: list[str]) -> np.ndarray:
    """0/1 matrix of hashed n-grams."""
    out = np.zeros((len(texts), DIM), np.uint8)
    joined = " " + " \0 ".join(texts).lower() + " "
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.cumsum(c == 0)
    blank = (c < 65) & (c > 0)  # spaces, digits, punctuation
    c = np.where(blank, np.uint64(32), c)
    h = np.zeros(len(c), np.uint64)
    for k in range(max(ORDERS)):
        n = len(c) - k
        h = ((h[:n] ^ c[k:]) * _MULT) ^ np.uint64(k + 1)
        if k + 1 in ORDERS:
            ok = (c[:n] != 0) & (c[k:] != 0) & (row[:n] == row[k:])
            out[row[:n][ok], ((h ^ (h >> np.uint64(31))) % np.uint64(DIM))[ok].astype(np.int64)] = 1
    return out


def normed(texts: list[str]) -> np.ndarray:
    x = presence(texts).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit(texts: list[str], labels: np.ndarray, seed: int = SEED) -> np.ndarray:
    """DIM x languages weights."""
    if not len(texts):
        return np.zeros((DIM, len(LANGS)), np.float32)
    x = normed(texts)
    rng = np.random.default_rng(seed)
    labels = labels.copy()
    for step in range(3):
        marks = np.concatenate([rng.permutation(np.flatnonzero(labels == k))[:LANDMARKS] for k in range(len(LANGS))])
        z = x[marks]
        y = np.where(labels[:, None] == np.arange(len(LANGS)), 1.0, -1.0)
        # Languages weigh alike, whatever their number of texts.
        w = (1 / np.maximum(np.bincount(labels, minlength=len(LANGS)), 1))[labels]
        w = w / w.mean()
        knm, kmm = (x @ z.T).astype(np.float64), (z @ z.T).astype(np.float64)
        a = knm.T @ (w[:, None] * knm) + RIDGE * len(texts) * (kmm + 1e-6 * np.eye(len(marks)))
        alpha = np.linalg.solve(a, knm.T @ (w[:, None] * y))
        weights = (z.T.astype(np.float64) @ alpha).astype(np.float32)
        if step < 2:
            s = x @ weights
            top = s.argmax(1)
            sure = s[np.arange(len(s)), top] - s[np.arange(len(s)), labels] > 0.4
            labels = np.where(sure, top, labels)
    return weights


def score(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, confidence) of each text."""
    lang = np.zeros(len(texts), np.int64)
    conf = np.zeros(len(texts))
    for at in range(0, len(texts), 128):
        s = normed(texts[at : at + 128]) @ weights
        two = np.sort(s, 1)[:, -2:]
        lang[at : at + 128] = s.argmax(1)
        conf[at : at + 128] = 1 / (1 + np.exp(-6 * (two[:, 1] - two[:, 0])))
    return lang, conf


#: Three-letter codes.
THREE = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "pol": "pl", "rus": "ru"}


def base_language(label: F.Column) -> F.Column:
    """Base code of a declared label; null where it declares nothing."""
    code = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    two = F.create_map(*[F.lit(x) for pair in THREE.items() for x in pair])
    code = F.coalesce(F.try_element_at(two, code), code)
    return F.when(~code.isin("", "und", "xx", "zxx", "mul"), code)


def train(df: DataFrame, record_id: str, text: str, label: str, sample: int = SAMPLE) -> np.ndarray:
    """Fits on at most about ``sample`` records of each declared language, chosen by a hash of their id."""
    src = df.select(F.xxhash64(F.col(record_id), F.lit(SEED)).alias("h"), F.col(text).cast("string").alias("t"), base_language(F.col(label)).alias("l")).where(F.col("l").isin(*LANGS))
    n = {r["l"]: r["n"] for r in src.where("t is not null").groupBy("l").agg(F.count("*").alias("n")).collect()}
    # Hashes are uniform, so a threshold takes the wanted number in one pass.
    keep = F.lit(False)
    for k, c in n.items():
        keep = keep | ((F.col("l") == k) & (F.col("h") < min(2**63 - 1, int(-(2**63) + min(1.0, sample / c) * 2**64))))
    # The first two paragraphs train; the cut bounds what the driver gets of very long texts.
    rows = src.where(keep & F.col("t").isNotNull()).select("h", F.substring("t", 1, TRAIN_CHARS).alias("t"), "l").collect() if n else []
    texts, labels = [], []
    for r in sorted(rows, key=lambda r: (r["h"], r["t"])):
        for _, p, _ in prose(r["t"])[:2]:
            texts.append(p)
            labels.append(LANGS.index(r["l"]))
    return fit(texts, np.array(labels, np.int64))


def languages(df: DataFrame, record_id: str, fields: list[str], weights: np.ndarray, keep: list[str] = ()) -> DataFrame:
    """field, record_id, place, n_words, lang, confidence of each paragraph of prose, and the columns ``keep`` as strings.

    Null, empty and short values give no row; other columns are ignored.
    """
    sent = df.sparkSession.sparkContext.broadcast(weights)  # DIM x 6
    src = df.select(F.col(record_id).cast("bigint").alias("__id"), *[F.col(f).cast("string").alias(f"__f{k}") for k, f in enumerate(fields)], *[F.col(c).cast("string").alias(f"__k{k}") for k, c in enumerate(keep)])
    names = ["field", "record_id", "place", "n_words", "lang", "confidence", *keep]

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        one_blas_thread()
        cols = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        out: dict[str, list] = {n: [] for n in names}
        texts: list[str] = []
        for k, f in enumerate(fields):
            for i, v in enumerate(cols[1 + k]):
                if v:
                    for place, p, n in prose(v):
                        texts.append(p)
                        for name, x in zip(names, (f, cols[0][i], place, n)):
                            out[name].append(x)
                        for j, c in enumerate(keep):
                            out[c].append(cols[1 + len(fields) + j][i])
        lang, conf = score(texts, sent.value)
        out["lang"] = [LANGS[x] for x in lang.tolist()]
        out["confidence"] = conf.tolist()
        return out

    return map_batches(src, run, "field string, record_id bigint, place int, n_words int, lang string, confidence double" + "".join(f", {c} string" for c in keep))


def segments(df: DataFrame, record_id: str, fields: list[str], weights: np.ndarray) -> DataFrame:
    """field, record_id, place, n_words, lang, confidence of each value as a whole (place null) and of each of its paragraphs, however short.

    A whole value has the language of most of its words, weighed by their confidence,
    and their mean confidence; one of headers, lists and the like alone is scored as
    it is.  Where there is no letter the language is ``und``, with confidence 0.
    Null values give no row.
    """
    sent = df.sparkSession.sparkContext.broadcast(weights)  # DIM x 6
    src = df.select(F.col(record_id).cast("bigint").alias("__id"), *[F.col(f).cast("string").alias(f"__f{k}") for k, f in enumerate(fields)])

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        one_blas_thread()
        ids = batch.column(0).to_pylist()
        out: dict[str, list] = {n: [] for n in ("field", "record_id", "place", "n_words", "lang", "confidence")}
        texts: list[str] = []
        shown: list[tuple] = []  # field, record, paragraphs of the value
        for k, f in enumerate(fields):
            for i, v in zip(ids, batch.column(1 + k).to_pylist()):
                if v is None:
                    continue
                own = prose(v, 1)
                if not own and (n := len(_WORD.findall(v))):
                    own = [(None, v, n)]
                texts += [p for _, p, _ in own]
                shown.append((f, i, [(place, n) for place, _, n in own]))
        lang, conf = score(texts, sent.value)
        at = 0

        def put(*row) -> None:
            for c, x in zip(out.values(), row):
                c.append(x)

        for f, i, parts in shown:
            if parts:
                n, own = np.array([x for _, x in parts], np.float64), slice(at, at + len(parts))
                mass = np.bincount(lang[own], n * conf[own], len(LANGS))
                top = int(mass.argmax())
                put(f, i, None, int(n.sum()), LANGS[top], float(mass[top] / n[lang[own] == top].sum()))
            else:
                put(f, i, None, 0, "und", 0.0)
            for place, words in parts:
                if place is not None:
                    put(f, i, place, words, LANGS[lang[at]], float(conf[at]))
                at += 1
        return out

    return map_batches(src, run, "field string, record_id bigint, place int, n_words int, lang string, confidence double")


def _messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, np.ndarray]:
    m = load(spark, sf_dir, "messages")
    return m, train(m, "message_id", "text", "lang")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, weights = _messages(spark, sf_dir)
    own = languages(m.withColumnRenamed("lang", "declared"), "message_id", ["text"], weights, ["declared"])
    own = own.select("field", "record_id", "lang", base_language(F.col("declared")).alias("declared")).distinct()
    own = own.where("declared is null or declared <> lang").select("field", F.col("record_id").alias("message_id"), "lang")
    # The extract has no label of its own: the few columns of the result meet the message's.
    rest = languages(load(spark, sf_dir, "message_extracts"), "message_id", ["extracted_text"], weights).select("field", F.col("record_id").alias("message_id"), "lang").distinct()
    labels = m.select("message_id", base_language(F.col("lang")).alias("declared")).groupBy("message_id").agg(F.max("declared").alias("declared"))
    rest = rest.join(labels, "message_id", "left").where("declared is null or declared <> lang").select("field", "message_id", "lang")
    return own.unionByName(rest).distinct()


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text and extracted_text, whole (place null) and by paragraph (place: its first line): words, language and confidence."""
    m, weights = _messages(spark, sf_dir)
    out = segments(m, "message_id", ["text"], weights).unionByName(segments(load(spark, sf_dir, "message_extracts"), "message_id", ["extracted_text"], weights))
    return out.dropDuplicates(["field", "record_id", "place"])  # a repeated delivery's paragraphs are the same
