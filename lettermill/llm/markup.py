"""Markup residue in text documents (problem 1).

Templates are deduced from pages of one host.  A token is a tag with its role: its name,
class or id, and the path of tags that it stands in.  Its occurrence vector says how often it
stands on each page of the host.  Vectors are compared by fingerprint, a sum over pages of a
hash of page and count, so equal vectors need no vector in one place: it is a plain
aggregation that combines before it shuffles.  Tokens with the same vector form an
equivalence class, in the order of their places.  A class is valid if its tags open and
close on pages that mostly nest well, and if all its outermost tokens stand in one other
class or in none: that class is its parent, and the valid classes of a host are a tree, its
template.  As the path is part of the token, the parent's span holds the class on every page.

Pages are not parted into slots at the template's tags: rendering replaces that.  What counts
is what a reader sees, and there marks go on over tags within a line, which slots would part.
Of the classes only tags that HTML doesn't know are used, to take them off like its own.  The
rendered page is taken out as lines, with headings, lists, code and formulas kept, and what
still looks like markup in it is residue, of family html, markdown, wiki or latex.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _html
from ._batch import cut_lineage, load, map_batches

#: Pages of a host that a class must stand on; tag tokens of templates that go to all tasks, above that number they are joined.
LEAST_PAGES, MOST_SENT = 3, 200_000
ANY_HOST = "*"
_MASK = (1 << 62) - 1
_ATTR = re.compile(r"\b(?:class|id)\s*=\s*[\"']?([\w-]+)", re.I)


_VOID = frozenset(("br", "hr", "img", "meta", "link", "input", "col", "wbr"))


def inside(path: int, tag: str) -> int:
    """The path of what stands in a tag that stands at a path."""
    return xxhash.xxh3_64_intdigest(tag.encode(), path) >> 2


def roles(value: str) -> tuple[dict[tuple[str, int], list[int]], bool]:
    """Of each tag token (tag with sign, path): count and first place; and whether tags nest."""
    out: dict[tuple[str, int], list[int]] = {}
    stack: list[tuple[str, int]] = []  # name, path of what stands in it
    opened: dict[str, int] = {}
    good = True
    for n, m in enumerate(_html.TAG.finditer(_html.HIDDEN.sub("", value))):
        name = m[2].lower()
        mark = _ATTR.search(m[3]) if m[3] else None
        if m[1]:
            if opened.get(name):
                while (top := stack.pop()[0]) != name:
                    opened[top] -= 1
                opened[name] -= 1
            else:
                good = False
            key = ("/" + name, stack[-1][1] if stack else 0)
        else:
            key = (name + ("." + mark[1] if mark else ""), stack[-1][1] if stack else 0)
            if name not in _VOID and not m[0].endswith("/>"):
                stack.append((name, inside(key[1], key[0])))
                opened[name] = opened.get(name, 0) + 1
        out.setdefault(key, [0, n])[0] += 1
    return out, good


def token_statistics(df: DataFrame, page: str, host: str, value: str) -> DataFrame:
    """host, tag, path, vector (fingerprint), pages, nested, places (sum of first places) - of every tag token of every host, and of all hosts together."""
    src = df.select(F.xxhash64(F.col(page)).alias("p"), F.coalesce(F.lower(F.col(host).cast("string")), F.lit("")).alias("h"), F.col(value).cast("string").alias("v")).where("v is not null")

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        acc: dict[tuple, list[int]] = {}
        for p, h, v in zip(*(batch.column(k).to_pylist() for k in range(3))):
            counts, good = roles(v)
            for (tag, path), (n, first) in counts.items():
                mark = (p * 0x9E3779B97F4A7C15 + n * 0xC2B2AE3D27D4EB4F) & ((1 << 64) - 1)
                mark = ((mark ^ (mark >> 29)) * 0xBF58476D1CE4E5B9) & _MASK
                for where in (h, ANY_HOST):
                    a = acc.setdefault((where, tag, path), [0, 0, 0, 0])
                    a[0] = (a[0] + mark) & _MASK
                    a[1] += 1
                    a[2] += good
                    a[3] += first
        keys = list(acc)
        values = list(zip(*acc.values())) or [()] * 4
        return {"host": [k[0] for k in keys], "tag": [k[1] for k in keys], "path": [k[2] for k in keys]} | dict(zip(("vector", "pages", "nested", "places"), values))

    part = map_batches(src, run, "host string, tag string, path bigint, vector bigint, pages bigint, nested bigint, places bigint")
    # Sums of fingerprints wrap round; as decimals they don't, and are taken modulo 2**62 after.
    total = F.sum(F.col("vector").cast("decimal(38,0)"))
    return part.groupBy("host", "tag", "path").agg((total % F.lit(1 << 62).cast("decimal(38,0)")).cast("bigint").alias("vector"), *[F.sum(c).alias(c) for c in ("pages", "nested", "places")])


def templates(stats: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """host, class_id, parent_id (null: none), pages, tags (in the order of their places) of the valid equivalence classes.

    Valid: on ``least`` pages or more, two tokens or more, as many closing tags as there are
    opening ones of their names (void elements need none), and nested in one class or in none.
    """
    name = F.regexp_extract("tag", r"^/?([a-z0-9:-]+)", 1)
    closes = F.col("tag").startswith("/")
    token = F.struct((F.col("places") / F.col("pages")).alias("place"), "tag", "path")
    classes = stats.where(F.col("pages") >= least).groupBy("host", "vector", "pages").agg(
        F.array_sort(F.collect_set(token)).alias("tokens"),
        F.count("*").alias("n"),
        F.sum(F.when(closes, 1).otherwise(0)).alias("n_close"),
        F.sum(F.when(~closes & ~name.isin(*sorted(_VOID)), 1).otherwise(0)).alias("n_open"),
        F.min(F.col("nested") * 10 >= F.col("pages") * 8).alias("nests"),
    )
    sound = classes.where((F.col("n") >= 2) & (F.col("n_close") >= 1) & (F.col("n_open") >= 1) & F.col("nests"))

    def enter(batch: pa.RecordBatch) -> dict[str, list]:
        host, vector, tag, path = (batch.column(k).to_pylist() for k in range(4))
        return {"host": host, "class_id": vector, "path": path, "inner": [inside(p, t) for p, t in zip(path, tag)]}

    tokens = sound.select("host", "vector", F.explode("tokens").alias("t")).select("host", "vector", "t.tag", "t.path")
    spans = map_batches(tokens.where(~F.col("tag").startswith("/")), enter, "host string, class_id bigint, path bigint, inner bigint")
    holders = spans.select("host", F.col("inner").alias("path"), F.col("class_id").alias("holder"))
    # A class may hold tokens of its own within others of its own; another class that holds them is its parent.
    nest = spans.join(holders, ["host", "path"], "left").groupBy("host", "class_id").agg(F.collect_set(F.when(F.col("holder") != F.col("class_id"), F.col("holder"))).alias("parents"))
    valid = sound.withColumnRenamed("vector", "class_id").join(nest, ["host", "class_id"]).where(F.size("parents") <= 1)
    return valid.select("host", "class_id", F.get("parents", F.lit(0)).alias("parent_id"), "pages", F.col("tokens.tag").alias("tags"))


_UNKNOWN = re.compile(r"^/?([a-z][a-z0-9:-]*)")


def extra_pattern(tags: list[str]) -> re.Pattern | None:
    """A pattern for template tags that HTML doesn't know."""
    names = sorted({m[1] for t in tags if (m := _UNKNOWN.match(t)) and m[1] not in _html.ELEMENTS})
    return re.compile(r"</?(?:" + "|".join(map(re.escape, names)) + r")(?:\s[^<>]*)?/?>", re.I) if names else None


_LIST = re.compile(r"<li\b[^<>]*>", re.I)
_HEADING = re.compile(r"<h([1-6])\b[^<>]*>", re.I)
_PRE = re.compile(r"<pre\b[^<>]*>(.*?)</pre\s*>", re.I | re.S)
_CODE = re.compile(r"</?(?:code|tt|kbd|samp)\b[^<>]*>", re.I)
_MATH = re.compile(r"<math\b[^<>]*>(.*?)</math\s*>", re.I | re.S)


def slots(value: str, extra: re.Pattern | None = None) -> str:
    """The page's slots as text: tags taken off; headings, list items, code blocks and formulas marked in plain text."""
    if "<" in value:
        value = _PRE.sub(lambda m: "\n```\n" + m[1].strip("\n") + "\n```\n", value)
        value = _MATH.sub(lambda m: " $" + _html.TAG.sub(" ", m[1]).strip() + "$ ", value)
        value = _LIST.sub("\n- ", value)
        value = _HEADING.sub(lambda m: "\n" + "#" * int(m[1]) + " ", value)
        value = _CODE.sub("`", value)
    return _html.render(value, extra)


#: Residue. Marks of the four families.
_ELEMENT = r"(?:" + "|".join(sorted(_html.ELEMENTS, key=len, reverse=True)) + r")"
HTML_MARK = re.compile(rf"</?{_ELEMENT}(?:\s[^<>\n]*)?\s*/?>|<!--|-->|<!doctype|&(?:[a-z]{{2,8}}|#\d{{2,6}}|#x[0-9a-f]{{2,5}});", re.I)
MARKDOWN_MARK = re.compile(
    r"^[ \t]*```|^#{2,6} \S|^# (?!['=\[*])\S|^[ \t]*\|?(?:\s*:?-{3,}:?\s*\|)+\s*:?-*:?\s*$|!?\[[^\[\]\n|]{1,200}\]\([^()\s]{1,400}\)|^[ \t]*[-*+] \[[ xX]\] |(?<![\w*])\*\*(?=\S)[^*\n]{1,200}(?<=\S)\*\*(?![\w*])"
    r"|(?<![\w~])~~(?=\S)[^~\n]{1,200}(?<=\S)~~(?!\w)|(?<![\w_])__(?=[^\s_])[^_\n]{1,200}(?<=[^\s_])__(?![\w_])|(?<![\w`])`[^`\n]{1,120}`(?![\w`])|(?<![\w_*])_(?=[^\s_])[^_\n]{2,120}(?<=[^\s_])_(?![\w_])|^[ \t]*>{0,3}[ \t]*\|[^\n|]+\|[^\n|]+\|[ \t]*\n[ \t]*\|[ :|-]{5,}\|",
    re.M,
)
SETEXT = re.compile(r"^(?=\S)([^\n=|<>]{3,80})\n={3,}[ \t]*$|^(?=\S)([^\n-]{3,80}[^\s.:,;!?-])\n-{4,}[ \t]*$", re.M)
WIKI_MARK = re.compile(
    r"\[\[[^\[\]\n]{1,200}\]\]|\{\{[^{}\n]{1,300}\}\}|^\{\|(?:\s|$)|^\|\}\s*$|^\|-\s*$|(?<!')'{2,3}(?=[^'\s])[^'\n]{1,200}(?<=[^'\s])(?:'(?!')[^'\n]{1,100})*'{2,3}(?!')|\[https?://\S+ [^\[\]\n]{1,200}\]|\[[^\[\]\n|]{1,200}\|https?://[^\[\]\s]+\]"
    r"|\{(?:quote|code|color|noformat|panel|info|note)(?::[^{}\n]*)?\}|^h[1-6]\. \S|<(?:ref|nowiki|math)\b",
    re.M,
)
WIKI_HEADING = re.compile(r"^(={2,6}) ?(?=[^=\s])[^=\n]{1,120}(?<=[^=\s]) ?\1[ \t]*(?:\n([^\n]*))?", re.M)
LATEX_MARK = re.compile(
    r"\\(?:begin|end)\{[a-zA-Z*]+\}|\\(?:(?:sub)*section|chapter|paragraph|title|caption|label|ref|cite[pt]?|footnote|url|href|emph|textbf|textit|texttt|underline|mathrm|mathbf|frac|sqrt|sum|int)\*?(?:\[[^\]\n]*\])?\{"
    r"|\\item\b|\\\[[^\n]{1,300}\\\]|\\\([^\n]{1,300}\\\)|\$[^$\n]*(?:\\[a-zA-Z]+|[_^]\{)[^$\n]*\$|\\(?:alpha|beta|gamma|delta|sum|int|leq|geq|cdot|times|infty)\b|(?<=\w)~\\cite",
)
_BULLET_TAG = re.compile(r"`")


def residue(text: str) -> list[str]:
    """Families of markup that a reader sees in the text."""
    out = []
    if ("<" in text or "&" in text) and HTML_MARK.search(text):
        out.append("html")
    if MARKDOWN_MARK.search(text) or "\n===" in text and SETEXT.search(text):
        out.append("markdown")
    wiki = WIKI_MARK.search(text) is not None
    if not wiki and "==" in text:
        # A sheet's name over its rows is written alike: there the next line is a row.
        wiki = any(not (m[2] and "\t" in m[2]) and m[1] != "===" or m[1] == "===" and not (m[2] and "\t" in m[2]) and m[2] is not None for m in WIKI_HEADING.finditer(text))
    if wiki:
        out.append("wiki")
    if "\\" in text and LATEX_MARK.search(text):
        out.append("latex")
    return out


_CLEAN = (
    (re.compile(r"<!--.*?-->", re.S), ""),
    (re.compile(rf"</?(?:p|div|tr|table|ul|ol|blockquote|br|hr)(?:\s[^<>]*)?/?>", re.I), "\n"),
    (re.compile(r"!\[([^\[\]\n]*)\]\([^()\s]*\)|\[([^\[\]\n|]+)\]\([^()\s]*\)"), r"\1\2"),
    (re.compile(r"\[\[(?:[^\[\]\n|]*\|)?([^\[\]\n|]+)\]\]"), r"\1"),
    (re.compile(r"\[https?://\S+ ([^\[\]\n]+)\]|\[([^\[\]\n|]+)\|https?://[^\[\]\s]+\]"), r"\1\2"),
    (re.compile(r"\{\{[^{}\n]*\}\}|\{(?:quote|color|noformat|panel|info|note)(?::[^{}\n]*)?\}"), ""),
    (re.compile(r"\{code(?::[^{}\n]*)?\}"), "\n```\n"),
    (re.compile(r"'{2,3}([^'\n]+)'{2,3}"), r"\1"),
    (re.compile(r"^(={2,6}) ?([^=\n]+?) ?\1[ \t]*$", re.M), lambda m: "#" * min(6, len(m[1]) - 1) + " " + m[2]),
    (re.compile(r"^([^\n]{3,80})\n={3,}[ \t]*$", re.M), r"# \1"),
    (re.compile(r"\*\*([^*\n]+)\*\*|__([^_\n]+)__|~~([^~\n]+)~~"), r"\1\2\3"),
    (re.compile(r"^\{\|[^\n]*\n?|^\|[}-][^\n]*\n?", re.M), ""),
    (re.compile(r"\\(sub)*section\*?\{([^{}\n]*)\}"), r"# \2"),
    (re.compile(r"\\(?:textbf|textit|texttt|emph|underline)\{([^{}\n]*)\}"), r"\1"),
    (re.compile(r"\\footnote\{([^{}\n]*)\}"), r" (\1)"),
    (re.compile(r"~?\\(?:cite[pt]?|label|ref)\{[^{}\n]*\}"), ""),
    (re.compile(r"\\(?:begin|end)\{(?:equation|align|displaymath)\*?\}|\\\[|\\\]"), "$$"),
    (re.compile(r"\\(?:begin|end)\{[a-zA-Z*]+\}(?:\{[^{}\n]*\})?"), ""),
    (re.compile(r"\\item\b"), "-"),
    (re.compile(r"\\([&%$#_])"), r"\1"),
)


def clean(text: str) -> str:
    """The slots' text with residual markup reduced to plain headings, lists, code and formulas."""
    if residue(text):
        for pattern, to in _CLEAN:
            text = pattern.sub(to, text)
        text = _html.TAG.sub(lambda m: "" if m[2].lower() in _html.ELEMENTS else m[0], text)
        text = html_lib.unescape(text)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in text.split("\n"))).strip()


class Deduced:
    """The template's tags that HTML doesn't know, by host: few are sent to all tasks, many are joined.

    Built once a query, as it reads all pages.
    """

    def __init__(self, template: DataFrame, most: int = MOST_SENT) -> None:
        spark = template.sparkSession
        tags = template.select("host", F.explode("tags").alias("tag")).distinct()
        unknown = tags.where(~F.regexp_extract("tag", r"^/?([a-z0-9:-]+)", 1).isin(*sorted(_html.ELEMENTS)))
        few = unknown.limit(most + 1).collect()
        self.own = None
        if len(few) > most:
            few = unknown.where(F.col("host") == ANY_HOST).collect()
            self.own = unknown.groupBy(F.col("host").alias("__host")).agg(F.concat_ws(" ", F.array_sort(F.collect_set("tag"))).alias("__tags"))
        by_host: dict[str, list[str]] = {}
        for r in few:
            by_host.setdefault(r["host"], []).append(r["tag"])
        self.sent = spark.sparkContext.broadcast({h: sorted(t) for h, t in by_host.items()})


def clean_text(df: DataFrame, record_id: str, fields: dict[str, bool], deduced: Deduced, host: str | None = None, only_residue: bool = False) -> DataFrame:
    """field, record_id, text, families - one row for each value that isn't null.

    fields: column name to whether it is an HTML page, whose slots the template of
    its host (without one: of all hosts) parts; other values are one slot.  Empty
    values give an empty text; other columns are ignored.  With only_residue,
    values without residue give no row and text is null.
    """
    src = df.select(F.col(record_id).cast("bigint").alias("__id"), (F.lower(F.col(host).cast("string")) if host else F.lit(None).cast("string")).alias("__host"), *[F.col(f).cast("string").alias(f"__f{k}") for k, f in enumerate(fields)])
    if deduced.own is None or not (host and any(fields.values())):
        src = src.withColumn("__tags", F.lit(None).cast("string"))
    else:  # each host's tags meet its pages; a host without tags of its own takes those of all hosts, as below
        src = src.join(deduced.own, "__host", "left").select("__id", "__host", *[f"__f{k}" for k in range(len(fields))], "__tags")
    sent = deduced.sent

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        ids, hosts, listed = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2 + len(fields)).to_pylist()
        patterns: dict = {}
        out: dict[str, list] = {"field": [], "record_id": [], "text": [], "families": []}
        for k, (f, page) in enumerate(fields.items()):
            for i, h, own, v in zip(ids, hosts, listed, batch.column(2 + k).to_pylist()):
                if v is None:
                    continue
                extra = None
                if page:
                    key = own if own is not None else h
                    if key not in patterns:
                        patterns[key] = extra_pattern(own.split(" ") if own is not None else sent.value.get(h if h in sent.value else ANY_HOST, []))
                    extra = patterns[key]
                    seen = _html.render(v, extra)  # as a reader sees the page
                else:
                    seen = v
                families = residue(seen)
                if families or not only_residue:
                    out["field"].append(f)
                    out["record_id"].append(i)
                    out["text"].append(None if only_residue else clean(slots(v, extra) if page else v))
                    out["families"].append(families)
        return out

    return map_batches(src, run, "field string, record_id bigint, text string, families array<string>")


def _parts(spark: SparkSession, sf_dir: str, only_residue: bool) -> DataFrame:
    m = load(spark, sf_dir, "messages").withColumn("__sender_host", F.regexp_extract("sender_addr", r"@(.+)$", 1))
    deduced = Deduced(templates(cut_lineage(token_statistics(m, "message_id", "__sender_host", "html"))))
    out = clean_text(m, "message_id", {"html": True}, deduced, "__sender_host", only_residue)
    out = out.unionByName(clean_text(load(spark, sf_dir, "message_extracts"), "message_id", {"extracted_html": True}, deduced, None, only_residue))
    return out.unionByName(clean_text(load(spark, sf_dir, "attachment_results"), "attachment_id", {"extraction": False}, deduced, None, only_residue))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, True).select("field", "record_id", F.explode("families").alias("family")).distinct()


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, False).select("field", "record_id", "text").dropDuplicates(["field", "record_id"])


def p1_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template of each host: its classes, each with the one it stands in, its pages and its tags in order."""
    m = load(spark, sf_dir, "messages").withColumn("__sender_host", F.regexp_extract("sender_addr", r"@(.+)$", 1))
    return templates(cut_lineage(token_statistics(m, "message_id", "__sender_host", "html"))).select("host", "class_id", "parent_id", "pages", F.concat_ws(" ", "tags").alias("tags"))
