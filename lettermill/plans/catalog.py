"""Queries of the mail operators over the tables, and SQL that gives the same by other means.

The SQL works on exploded lines with window functions and on the tables' own columns of expected
routes and results; it shares no expression with the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsx import WS, js_trim, split_lines
from ..operators import attachments as A
from ..operators import html_body as H
from ..operators import noise as N
from ..operators import text_body as T
from ..sources.tables import table
from . import cases
from . import html_sql as S

#: Bodies are taken per delivery: the operators are row-local, so no query over them needs an exchange.
KEY = ("message_id", "delivered")


def _messages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "messages").select("message_id", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("delivered"), *columns)


def body_extract(spark: SparkSession, d: str) -> DataFrame:
    return H.extract_bodies(_messages(spark, d, "text", "html")).select(*KEY, "extracted_text", "extracted_html")


def body_text(spark: SparkSession, d: str) -> DataFrame:
    return T.extract_text(_messages(spark, d, "text").where("text is not null")).select(*KEY, "extracted_text")


def body_new_text(spark: SparkSession, d: str) -> DataFrame:
    return T.with_new_text(_messages(spark, d, "text").where("text is not null")).select(*KEY, "new_text")


SIGNALS = ("quote_run", "quote_nested", "divider", "on_wrote", "on_sent", "dashed", "samsung", "header_address", "header_block", "foreign", "foreign_wrapped", "chinese", "arabic", "dated_address")


def _given(name: str) -> Callable:
    return lambda s: s[name]


def body_line_signals(spark: SparkSession, d: str) -> DataFrame:
    """Of each text: lines, and lines that give each signal."""
    lines = _messages(spark, d, "text").where("text is not null").withColumn("__t", F.transform(split_lines(F.col("text")), js_trim))
    t = F.col("__t")
    flags = F.transform(t, lambda x, i: F.struct(*[(c & (x != "")).alias(n) for n, c in T.signals(x, t, i).items() if n in SIGNALS]))
    lines = lines.withColumn("__f", flags)
    return lines.select(*KEY, F.size("__t").cast("bigint").alias("n_lines"), *[F.size(F.filter("__f", _given(n))).cast("bigint").alias(f"n_{n}") for n in SIGNALS])


def body_glued(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d, "text").where("text is not null").select(*KEY, T.split_glued(F.col("text")).alias("text"))


def body_bounce(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d, "text").where("text is not null").select(*KEY, T.is_bounce(F.col("text")).alias("is_bounce"))


def noise_text(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d, "text").where("text is not null").select(*KEY, N.strip_noise(F.col("text")).alias("clean"))


def noise_html(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d, "html").where("html is not null").select(*KEY, N.strip_noise_html(F.col("html")).alias("clean"))


def html_extract(spark: SparkSession, d: str) -> DataFrame:
    return H.extract_html(_messages(spark, d, "html").where("html is not null")).select(*KEY, "extracted_html")


def html_marker_positions(spark: SparkSession, d: str) -> DataFrame:
    """Of each HTML body: where each mark stands first (the length: nowhere)."""
    marks = H.marker_positions(F.col("html"))
    return _messages(spark, d, "html").where("html is not null").select(*KEY, *[at.cast("bigint").alias(f"at_{m}") for m, at in marks.items()])


def html_visible(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d, "html").where("html is not null").select(*KEY, H.visible_text(F.col("html")).alias("visible"), H.flat_text(F.col("html")).alias("flat"), H.drop_comments(F.col("html")).alias("bare"))


#: The tables call untyped pages that sniffing finds html; sniffing knows only text.  They are counted apart.
_SNIFFED_PAGE = "coalesce(routed_by = 'sniff' AND kind = 'text' AND page, false)"


def _routed(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "attachments")
    page = F.lower(F.decode(F.substring("content", 1, 15), "iso-8859-1")).isin("<!doctype html>") | F.lower(F.decode(F.substring("content", 1, 5), "iso-8859-1")).isin("<html")
    return A.routes(a).join(a.select("attachment_id", page.alias("page")), "attachment_id")


def route_detect(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).where(f"NOT {_SNIFFED_PAGE}").select("attachment_id", "kind", "routed_by")


def route_exceptions(spark: SparkSession, d: str) -> DataFrame:
    """How many files ``route_detect`` leaves out, as the tables expect another kind."""
    return _routed(spark, d).where(_SNIFFED_PAGE).agg(F.count("*").alias("n_sniffed_pages"))


def route_declared(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attachments").select("attachment_id", A.declared_udf("filename", "content_type").alias("c")).select("attachment_id", "c.*")


def _results(spark: SparkSession, d: str) -> DataFrame:
    """The tables' own results, a repeated one once."""
    return table(spark, d, "attachment_results").groupBy("attachment_id").agg(*[F.any_value(c).alias(f"{c}_told") for c in ("status", "extraction", "reason")])


#: The tables let some transfers fail that broke off within a text; the bytes that came are sound text.  They are counted apart.
_BROKEN_OFF = "coalesce(reason_told = 'unexpected end of input', false)"


def attach_status(spark: SparkSession, d: str) -> DataFrame:
    """Status and reason; the tables give reasons of broken archives without the opening words."""
    got = A.extract_attachments(table(spark, d, "attachments")).join(_results(spark, d), "attachment_id")
    return got.where(f"NOT {_BROKEN_OFF}").select("attachment_id", "status", F.regexp_replace("reason", "^malformed zip: ", "").alias("reason"))


def attach_exceptions(spark: SparkSession, d: str) -> DataFrame:
    """How many files ``attach_status`` leaves out: their text is read as far as it came."""
    got = A.extract_attachments(table(spark, d, "attachments")).join(_results(spark, d), "attachment_id")
    return got.where(f"{_BROKEN_OFF} AND status = 'extracted'").agg(F.count("*").alias("n_broken_off"))


def _of_kind(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    """Attachments that are routed to one of some kinds, with their text."""
    a = table(spark, d, "attachments")
    return A.extract_attachments(a).join(A.routes(a).where(F.col("kind").isin(*kinds)).select("attachment_id", "kind"), "attachment_id")


_GAPS = f"{WS}+"
#: What the tables' results that were cut may end in.
_CUT_MARK = r"\s*(\[\.\.\.\]|\.\.\.|…)$"
#: Signs of a text that was decoded wrongly: such results of the tables say nothing about parsers.
GARBLED = "[ÃÂÐÑ√�]|[а-яё][^а-яё\\s]?[╨╤]|[–—‚„†‡][^\\s]"


def attach_text(spark: SparkSession, d: str) -> DataFrame:
    """Text files that are valid UTF-8 without a byte-order mark or zeros, decoded."""
    a = table(spark, d, "attachments")
    valid = a.where(~F.contains(F.col("content"), F.lit(b"\0")) & F.is_valid_utf8(F.col("content").cast("string")) & (F.length("content") > 0) & ~F.col("content").cast("string").startswith("\ufeff"))
    return _of_kind(spark, d, "text").where("status = 'extracted'").join(valid.select("attachment_id"), "attachment_id", "left_semi").select("attachment_id", "extraction")


def attach_html(spark: SparkSession, d: str) -> DataFrame:
    """HTML files that are valid UTF-8: their visible text without white space."""
    valid = table(spark, d, "attachments").where(F.is_valid_utf8(F.col("content").cast("string")) & (F.length("content") > 0))
    return _of_kind(spark, d, "html").join(valid.select("attachment_id"), "attachment_id", "left_semi").select("attachment_id", F.regexp_replace("extraction", _GAPS, "").alias("solid_text"))


def attach_documents(spark: SparkSession, d: str) -> DataFrame:
    """Word and PDF files: text without white space, as far as the tables' own result goes, which may be cut; garbled results are left out."""
    got = _of_kind(spark, d, "docx", "pdf").join(_results(spark, d), "attachment_id").where("status = 'extracted'").where(~F.coalesce(F.col("extraction_told").rlike(GARBLED), F.lit(False)))
    told = F.length(F.regexp_replace(F.regexp_replace("extraction_told", _CUT_MARK, ""), _GAPS, ""))
    return got.select("attachment_id", F.left(F.regexp_replace("extraction", _GAPS, ""), told).alias("solid_text"))


def attach_extract(spark: SparkSession, d: str) -> DataFrame:
    return A.extract_attachments(table(spark, d, "attachments"))


def attach_xlsx(spark: SparkSession, d: str) -> DataFrame:
    """Text of the spreadsheets, by a join of the routed files with their text on the id alone."""
    a = table(spark, d, "attachments")
    sheets = A.routes(a).where("kind = 'xlsx'").select("attachment_id")
    return A.extract_attachments(a).join(sheets, "attachment_id", "left_semi").select("attachment_id", "extraction")


def mail_by_mailbox(spark: SparkSession, d: str) -> DataFrame:
    """Of each mailbox: messages, and characters received and newly written."""
    new = T.extract_text(_messages(spark, d, "mailbox_id", "text"))
    return new.groupBy("mailbox_id").agg(F.count("*").alias("n_messages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"), F.coalesce(F.sum(F.length("extracted_text")), F.lit(0)).alias("n_new_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (body_extract, body_text, body_new_text, body_line_signals, body_glued, body_bounce, noise_text, noise_html, html_extract, html_marker_positions, html_visible, route_detect, route_exceptions, route_declared, attach_status, attach_exceptions, attach_extract, attach_text, attach_html, attach_documents, attach_xlsx, mail_by_mailbox, *cases.QUERIES)
    return {f.__name__: f for f in own}


# --- SQL

_WS = r"[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_VERBS = "a [éÉ]crit|escribi[óÓ]|ha scritto|escreveu|schrieb|schreef|geschreven|verzond|skrev|napisa[łŁ]|написал|[đĐ][ãÃ] vi[ếẾ]t|yazdı|a scris"
_DATES = "sent|date|gesendet|envoy[éÉ]|enviado|enviada|datum|verzonden|inviato|skickat|sendt"
_MAIL = r"<[^>]+@[^>]+>|\b[^@\s]+@[^@\s]+\.[^@\s]+"


def _trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_WS}+', ''), '{_WS}+$', '')"


#: A delivery's key is a pair, under the name message_id until the last SELECT.
_PAIR = "struct_pack(m := message_id, t := strftime(ingested_at, '%Y-%m-%d %H:%M:%S')) AS message_id"
_TEXTS = f"texts AS (SELECT {_PAIR}, text, mailbox_id FROM messages)"
_PAGES = f"pages AS (SELECT {_PAIR}, html FROM messages WHERE html IS NOT NULL)"
_OUT = "message_id.m AS message_id, message_id.t AS delivered"


def _lines(text: str) -> str:
    """Lines with place i, trimmed line t, the two joined windows and all single signals."""
    return rf"""
split_ AS (SELECT message_id, string_split_regex({text}, '\r?\n') AS l FROM texts WHERE text IS NOT NULL),
raw AS (SELECT message_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM split_),
cut_ AS (SELECT *, {_trim('line')} AS t FROM raw),
near AS (SELECT *, lead(t, 1, '') OVER w AS t1, lead(t, 2, '') OVER w AS t2, lead(t, 3, '') OVER w AS t3, lag(t, 1, '') OVER w AS tb FROM cut_ WINDOW w AS (PARTITION BY message_id ORDER BY i)),
wide AS (SELECT *, t1 || chr(10) || t2 || chr(10) || t3 AS below, CASE WHEN t1 = '' THEN t WHEN t2 = '' THEN t || ' ' || t1 ELSE t || ' ' || t1 || ' ' || t2 END AS three, CASE WHEN t1 = '' THEN t ELSE t || ' ' || t1 END AS two,
  regexp_replace(t, '^(>{_WS}*)+', '') AS bare FROM near),
sig AS (SELECT *,
  t LIKE '>%' AND t1 LIKE '>%' AS quote_run,
  regexp_matches(t, '^-+\s*(original message|urspr[üÜ]ngliche nachricht|oprindelig meddelelse|reply message|antwort nachricht)', 'i') AS divider,
  regexp_matches(t, '^On\b', 'i') AND regexp_matches(three, '^On\b.*wrote:', 'i') AS on_wrote,
  regexp_matches(t, '^On\b', 'i') AND regexp_matches(three, '^On\b.*sent:', 'i') AND regexp_matches(three, '\S+@\S+') AS on_sent,
  regexp_matches(t, '^-{{2,}}.*\bwrote\b:?\s*-{{2,}}\s*$', 'i') AS dashed,
  regexp_matches(t, 'sent from samsung\b.*\S+@\S+.*\bwrote\b', 'i') AS samsung,
  regexp_matches(t, '^\s*(from|von|de|van|da|fra|fr[åÅ]n)\s*:', 'i') AND regexp_matches(t, '{_MAIL}') AS header_address,
  regexp_matches(t, '^\s*(from|von|de|van|da|fra|fr[åÅ]n)\s*:', 'i') AND regexp_matches(below, '(?m)^\s*({_DATES})\s*:', 'i') AND (regexp_matches(t, '^\s*(from|von)\s*:', 'i') OR regexp_matches(below, '{_MAIL}')) AS header_block,
  regexp_matches(t, '{_VERBS}', 'i') AND regexp_matches(t, ':\s*$') AS "foreign",
  regexp_matches(t, '\b20\d\d\b') AND regexp_matches(t, '\d{{1,2}}:\d{{2}}') AND ((regexp_matches(two, '{_VERBS}', 'i') AND regexp_matches(two, ':\s*$')) OR (regexp_matches(three, '{_VERBS}', 'i') AND regexp_matches(three, ':\s*$'))) AS foreign_wrapped,
  regexp_matches(t, '写道\s*[:：]\s*$') OR regexp_matches(t, '^发件人[\s:：]') AS chinese,
  regexp_matches(t, 'كتب\s*[:：]\s*$') AS arabic,
  regexp_matches(t, '\b20\d\d\b') AND regexp_matches(t, '\d{{1,2}}:\d{{2}}') AND regexp_matches(t, '<[^>]*@[^>]*>\s*[:：]\s*$') AS dated_address,
  t LIKE '>%' AND t1 NOT LIKE '>%' AND (
    regexp_matches(bare, '^-+\s*(original message|urspr[üÜ]ngliche nachricht|oprindelig meddelelse|reply message|antwort nachricht)', 'i') OR regexp_matches(bare, '^On\b.*wrote:', 'i') OR (regexp_matches(bare, '^On\b.*sent:', 'i') AND regexp_matches(bare, '\S+@\S+'))
    OR (regexp_matches(bare, '^\s*(from|von|de|van|da|fra|fr[åÅ]n)\s*:', 'i') AND regexp_matches(bare, '{_MAIL}')) OR (regexp_matches(bare, '{_VERBS}', 'i') AND regexp_matches(bare, ':\s*$')) OR regexp_matches(bare, '(写道|كتب)\s*[:：]\s*$')
    OR (regexp_matches(bare, '\b20\d\d\b') AND regexp_matches(bare, '\d{{1,2}}:\d{{2}}') AND regexp_matches(bare, '<[^>]*@[^>]*>\s*[:：]\s*$'))) AS quote_nested
  FROM wide)"""


#: From the lines' signals to the cut, the guards and the signature below.
_CUT = rf"""
flag AS (SELECT *, t <> '' AND (quote_run OR divider OR on_wrote OR on_sent OR dashed OR samsung OR header_address OR header_block OR "foreign" OR foreign_wrapped OR chinese OR arabic OR dated_address OR quote_nested) AS base, regexp_matches(t, '^_{{5,}}\s*$') AS rule FROM sig),
solid AS (SELECT message_id, i, base, rule, row_number() OVER (PARTITION BY message_id ORDER BY i) AS k FROM flag WHERE t <> ''),
ruled AS (SELECT a.message_id, a.i FROM solid a WHERE a.rule AND EXISTS (SELECT 1 FROM solid b WHERE b.message_id = a.message_id AND b.k BETWEEN a.k + 1 AND a.k + 3 AND b.base)),
first_ AS (SELECT message_id, min(i) AS at FROM (SELECT message_id, i FROM flag WHERE base UNION ALL SELECT message_id, i FROM ruled) GROUP BY message_id),
runs AS (SELECT message_id, min(i) AS lo, max(i) AS hi FROM flag WHERE t LIKE '>%' AND (t1 LIKE '>%' OR tb LIKE '>%') GROUP BY message_id),
inline_ AS (SELECT DISTINCT f.message_id FROM flag f JOIN runs r USING (message_id) WHERE f.i > r.lo AND f.i < r.hi AND f.t <> '' AND f.t NOT LIKE '>%' AND NOT f.base AND NOT f.rule AND f.tb = '' AND length(f.t) >= 20 AND len(string_split_regex(f.t, '{_WS}+')) >= 4),
top_ AS (SELECT message_id, arg_min(t, i) AS head, arg_min(t, i) FILTER (WHERE NOT regexp_matches(t, '^\[.*\]$') AND NOT regexp_matches(t, '^https?://\S+$', 'i')) AS opening FROM flag WHERE t <> '' GROUP BY message_id),
forward_ AS (SELECT message_id, min(i) AS fwd FROM flag WHERE regexp_matches(t, '^(-+\s*forwarded message\s*-+|begin forwarded message:?)\s*$', 'i') GROUP BY message_id),
bounce_ AS (SELECT message_id, {{bounce}} AS is_bounce FROM top_),
keep_ AS (SELECT x.message_id, CASE WHEN b.is_bounce OR n.message_id IS NOT NULL OR regexp_matches(o.head, '^(fw|fwd):\s*\S', 'i') OR coalesce(w.fwd <= f.at, false) THEN NULL ELSE f.at END AS at
  FROM texts x LEFT JOIN first_ f USING (message_id) LEFT JOIN bounce_ b USING (message_id) LEFT JOIN inline_ n USING (message_id) LEFT JOIN top_ o USING (message_id) LEFT JOIN forward_ w USING (message_id) WHERE x.text IS NOT NULL),
under AS (SELECT f.message_id, f.i, f.line, f.t, k.at, sum(CASE WHEN f.t <> '' THEN 1 ELSE 0 END) OVER u AS n_solid, sum(CASE WHEN f.t <> '' AND f.line LIKE '>%' THEN 1 ELSE 0 END) OVER u AS n_quoted
  FROM flag f JOIN keep_ k USING (message_id) WHERE f.i > k.at WINDOW u AS (PARTITION BY f.message_id ORDER BY f.i)),
marks AS (SELECT message_id, i, n_solid, lead(i) OVER (PARTITION BY message_id ORDER BY i) AS nxt, lead(n_solid) OVER (PARTITION BY message_id ORDER BY i) AS nxt_solid FROM under WHERE regexp_matches(line, '^--\s*$') AND n_solid - 1 > 0 AND 2 * n_quoted >= n_solid - 1),
ends_ AS (SELECT message_id, max(n_solid) AS all_solid FROM under GROUP BY message_id),
sign_ AS (SELECT m.message_id, coalesce(min(m.i) FILTER (WHERE coalesce(m.nxt_solid - 1, e.all_solid) - m.n_solid >= 2), max(m.i)) AS s FROM marks m JOIN ends_ e USING (message_id) GROUP BY m.message_id),
new_ AS (SELECT x.message_id, CASE WHEN x.text = '' THEN NULL WHEN k.at IS NULL THEN {_trim('x.text')} ELSE {_trim("coalesce((SELECT string_agg(f.line, chr(10) ORDER BY f.i) FROM flag f WHERE f.message_id = x.message_id AND (f.i < k.at OR f.i >= g.s)), '')")} END AS new_text
  FROM texts x JOIN keep_ k USING (message_id) LEFT JOIN sign_ g USING (message_id))"""
#: How bounces open, by headline, by field, and anywhere in the line; and what marks boilerplate at the beginning of a line or within it.
_HEADLINES = (
    "delivery (has )?failed", "address not found", "undelivered mail", "mail delivery (failed|subsystem)", "delivery status notification", "message not delivered", "returned mail", "message blocked", "this is the mail system",
    "this message was created automatically by mail", "i''?m sorry to have to inform you", "could not be delivered", r"your message\b[^\n]{0,80}?(wasn''?t|couldn''?t be|could not be) delivered",
)
_FIELDS = ("reporting-mta:", "final-recipient:", "original-recipient:", "diagnostic-code:", r"action:\s*failed", r"status:\s*[45]\.\d")
_LINE_BEGINS = ("sent from (my |outlook|mail|yahoo|samsung)", r"get outlook for (ios|android)\b", r"\s*your personal data\b")
_LINE_HOLDS = (
    r"\bview (this email|it|this)?\s*in (your )?(web )?browser\b", r"\byou(''re| are) receiving this (e-?mail|message|because)\b", r"\byou received this (e-?mail|message)\b", r"\bmanage (your )?(email )?(preferences|subscription)\b",
    "to unsubscribe", r"unsubscribe (here|from this|at any|below|now)\b", r"click [^\n]{0,25}\bunsubscribe\b", r"\bunsubscribe\b[^\n]{0,40}(https?://|www\.)",
    r"\bthis (e-?mail|email|message|communication)\b[^.\n]{0,60}\b(confidential|privileged)\b", r"\bconfidentiality (notice|statement|warning)\b", r"\bif you are not the intended recipient\b",
    r"\b(intended|designated) (solely|only) for\b", r"\bthis (e-?mail|email|message) is not secure\b", r"\b(do not|don''?t) print this (e-?mail|email|message)\b",
)
_BOUNCE = rf"coalesce(regexp_matches(opening, '^[\s*]*({'|'.join(_HEADLINES)})', 'i') OR regexp_matches(opening, '^({'|'.join(_FIELDS)})', 'i') OR regexp_matches(opening, '\brejected your message\b', 'i'), false)"
_NOISE_RE = f"^({'|'.join(_LINE_BEGINS)})|{'|'.join(_LINE_HOLDS)}"
#: An attribution glued to a reply, as the corpus has them: opener, date, address and verb in this order (no look-ahead in this dialect).
_GLUE = (
    r"regexp_replace(text, '([^\r\n>])[ \t]+((On|Le|Il|W dniu|Op|Am|P[åÅ]|Den|Em|El|V[àÀ]o|في)\s[^\r\n]{0,160}(20\d\d|\d{1,2}:\d{2})[^\r\n]{0,160}@[^\s@<>]+\.[^\s@<>]+[^\r\n]{0,40}(wrote|sent|a [éÉ]crit|escribi[óÓ]|ha scritto|escreveu|schrieb|schreef|geschreven|verzond|skrev|napisa[łŁ]|написал|كتب)\s*:)', '\1' || chr(10) || '\2', 'gi')"
)

_TOLD = "told AS (SELECT attachment_id, any_value(status) AS status, any_value(extraction) AS extraction, any_value(reason) AS reason FROM attachment_results GROUP BY attachment_id)"
#: What a page shows, white space aside: hidden parts and tags off, references resolved.
_SEEN = r"regexp_replace(regexp_replace(regexp_replace(t, '<li[^>]*>', '*', 'gi'), '<!--.*?-->|<(head|style|script|title)\b.*?</(head|style|script|title)>', '', 'gis'), '<[^>]+>', '', 'g')"
for _name, _char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("mdash", "—"), ("#8211", "–"), ("amp", "&")):
    _SEEN = f"replace({_SEEN}, '&{_name};', '{_char}')"
_SEEN = f"nullif(regexp_replace({_SEEN}, '{_WS}+', '', 'g'), '')"


def _strip(c: str) -> str:
    lines = rf"string_split_regex({c}, '\r?\n')"
    at = f"list_position(list_transform({lines}, lambda x: regexp_matches(x, '{_NOISE_RE}', 'i')), true)"
    return _trim(f"array_to_string(CASE WHEN {at} > 0 THEN list_slice({lines}, 1, {at} - 1) ELSE {lines} END, chr(10))")


def oracle_sql() -> dict[str, str]:
    n = ", ".join(f'count(*) FILTER (WHERE t <> \'\' AND "{s}") AS n_{s}' for s in SIGNALS)
    full = f"WITH {_TEXTS}, {_lines('glued')}, {_CUT.replace('{bounce}', _BOUNCE)}".replace("FROM texts WHERE text IS NOT NULL),\nraw", "FROM (SELECT message_id, text, " + _GLUE + " AS glued FROM texts) WHERE text IS NOT NULL),\nraw")
    page = S.extract(_NOISE_RE, _BOUNCE)
    return {
        "body_text": f"{full} SELECT {_OUT}, {_strip('new_text')} AS extracted_text FROM new_",
        "body_new_text": f"{full} SELECT {_OUT}, new_text FROM new_",
        "body_line_signals": f"WITH {_TEXTS}, {_lines('text')} SELECT {_OUT}, count(*) AS n_lines, {n} FROM sig GROUP BY sig.message_id",
        "body_glued": f"WITH {_TEXTS} SELECT {_OUT}, {_GLUE} AS text FROM texts WHERE text IS NOT NULL",
        "body_bounce": f"WITH {_TEXTS}, {_lines('text')}, top_ AS (SELECT message_id, arg_min(t, i) FILTER (WHERE t <> '' AND NOT regexp_matches(t, '^\\[.*\\]$') AND NOT regexp_matches(t, '^https?://\\S+$', 'i')) AS opening FROM sig GROUP BY message_id) SELECT {_OUT}, {_BOUNCE} AS is_bounce FROM top_",
        "noise_text": f"WITH {_TEXTS} SELECT {_OUT}, {_strip('text')} AS clean FROM texts WHERE text IS NOT NULL",
        "body_extract": f"{full}, {_PAGES}, {page} SELECT x.message_id.m AS message_id, x.message_id.t AS delivered, {_strip('w.new_text')} AS extracted_text, p.extracted_html FROM texts x LEFT JOIN new_ w USING (message_id) LEFT JOIN whole_ p USING (message_id)",
        "noise_html": f"WITH {_PAGES} SELECT {_OUT}, {S.strip_noise('html', _NOISE_RE)} AS clean FROM pages",
        "html_extract": f"WITH {_PAGES}, {page} SELECT {_OUT}, extracted_html FROM whole_",
        "html_marker_positions": f"WITH {_PAGES}, {S.PLACED} SELECT {_OUT}, {', '.join(f'at_{m}' for m in S.MARKS)} FROM placed",
        "html_visible": f"WITH {_PAGES} SELECT {_OUT}, {S.visible('html')} AS visible, {S.flat('html')} AS flat, {S.bare('html')} AS bare FROM pages",
        "route_detect": "SELECT attachment_id, kind, routed_by FROM attachment_routes WHERE NOT coalesce(routed_by = 'sniff' AND kind = 'html', false)",
        "route_exceptions": "SELECT count(*) AS n_sniffed_pages FROM attachment_routes WHERE routed_by = 'sniff' AND kind = 'html'",
        "route_declared": r"SELECT attachment_id, nullif(lower(trim(split_part(content_type, ';', 1))), '') AS declared, nullif(trim(list_last(regexp_extract_all(content_type, '(?i);\s*charset\s*=\s*\x22?([^\x22;]+)', 1))), '') AS charset, nullif(lower(regexp_extract(trim(filename), '(\.[A-Za-z0-9]+)$', 1)), '') AS extension FROM attachments",
        "attach_status": f"WITH {_TOLD} SELECT attachment_id, status, reason FROM told WHERE reason IS DISTINCT FROM 'unexpected end of input'",
        "attach_exceptions": f"WITH {_TOLD} SELECT count(*) AS n_broken_off FROM told WHERE reason = 'unexpected end of input'",
        "attach_text": r"SELECT attachment_id, regexp_replace(t, '\r\n?', chr(10), 'g') AS extraction FROM (SELECT attachment_id, try(decode(content)) AS t FROM attachments JOIN attachment_routes USING (attachment_id) WHERE kind = 'text' OR kind = 'html' AND routed_by = 'sniff') WHERE t <> '' AND NOT starts_with(t, chr(65279)) AND NOT contains(t, chr(0))".replace("t <> ''", f"{_trim('t')} <> ''"),
        "attach_html": f"SELECT attachment_id, {_SEEN} AS solid_text FROM (SELECT attachment_id, try(decode(content)) AS t FROM attachments JOIN attachment_routes USING (attachment_id) WHERE kind = 'html' AND routed_by <> 'sniff') WHERE t <> ''",
        "attach_documents": f"WITH {_TOLD} SELECT attachment_id, regexp_replace(regexp_replace(extraction, '{_CUT_MARK}', ''), '{_WS}+', '', 'g') AS solid_text FROM told JOIN attachment_routes USING (attachment_id) WHERE kind IN ('docx', 'pdf') AND status = 'extracted' AND NOT coalesce(regexp_matches(extraction, '{GARBLED.replace(chr(92) * 2, chr(92))}'), false)",
        "attach_xlsx": "SELECT r.attachment_id, any_value(r.extraction) AS extraction FROM attachment_results r JOIN attachment_routes k ON k.attachment_id = r.attachment_id WHERE k.kind = 'xlsx' GROUP BY r.attachment_id",
        "mail_by_mailbox": f"{full} SELECT x.mailbox_id, count(*) AS n_messages, CAST(coalesce(sum(length(x.text)), 0) AS BIGINT) AS n_chars, CAST(coalesce(sum(length({_strip('w.new_text')})), 0) AS BIGINT) AS n_new_chars FROM texts x LEFT JOIN new_ w USING (message_id) GROUP BY x.mailbox_id",
    } | cases.SQL
