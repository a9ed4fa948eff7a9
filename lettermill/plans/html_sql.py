"""SQL for the HTML queries, in stages of its own: closing tags become one mark, so that look-ahead is a character class."""

from __future__ import annotations

WS = r"[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_SOLID = r"[^\t-\r @\x{00A0}\x{FEFF}]"
#: The mark that stands for the first character of a closing tag, so that places stay what they are.
_SHUT = r"\x01"
_BLOCK_END = "</(div|p|tr|td|li|table|blockquote)>"


def trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


def decode(c: str, names: tuple[str, ...]) -> str:
    for n in names:
        c = f"regexp_replace({c}, '&{n};', '{dict(nbsp=' ', lt='<', gt='>', amp='&')[n]}', 'gi')"
    return c


def visible(c: str) -> str:
    c = rf"regexp_replace(regexp_replace(regexp_replace({c}, '</(div|p|blockquote|tr|td|li|table)>', chr(10), 'gi'), '<(br|hr)\s*/?>', chr(10), 'gi'), '<[^>]+>', ' ', 'g')"
    return trim(f"regexp_replace({decode(c, ('nbsp', 'lt', 'gt', 'amp'))}, '[ \\t]+', ' ', 'g')")


def flat(c: str) -> str:
    return decode(rf"regexp_replace(regexp_replace({c}, '<(br|/p|/div|/tr|/td|/li|hr)[^>]*>', chr(10), 'gi'), '<[^>]+>', '', 'g')", ("lt", "gt", "amp", "nbsp"))


def bare(c: str) -> str:
    return trim(rf"regexp_replace(regexp_replace({c}, '<!--[\s\S]*?-->', '', 'g'), '/\*[\s\S]*?\*/', '', 'g')")


def block_text(c: str) -> str:
    return trim(rf"regexp_replace(regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '&[a-z]+;', ' ', 'gi'), '{WS}+', ' ', 'g')")


def blocks(c: str) -> str:
    return rf"string_split(regexp_replace({c}, '({_BLOCK_END})', '\1' || chr(1), 'gi'), chr(1))"


def strip_noise(c: str, noise: str) -> str:
    at = f"list_position(list_transform({blocks(c)}, lambda x: regexp_matches({block_text('x')}, '{noise}', 'i')), true)"
    return trim(f"array_to_string(CASE WHEN {at} > 0 THEN list_slice({blocks(c)}, 1, {at} - 1) ELSE {blocks(c)} END, '')")


def place(c: str, p: str) -> str:
    return f"length(coalesce(string_split_regex({c}, '{p}')[1], ''))"


def place_behind(c: str, before: str, p: str) -> str:
    """The place of p where it stands at the beginning or behind a character of ``before``."""
    both = f"(?is)^(.*?)(^|{before}){p}"
    return f"CASE WHEN regexp_matches({c}, '{both}') THEN length(regexp_extract({c}, '{both}', 1)) + length(regexp_extract({c}, '{both}', 2)) ELSE length({c}) END"


#: From `pages` (message_id, html) to `placed`: every mark's place.
_VERBS = "a [éÉe]crit|escribi[óÓo]|ha scritto|escreveu|schrieb|schreef|geschreven|verzond|skrev|napisa[łŁ]|написал|[đĐ][ãÃ] vi[ếẾ]t|yazd[ıi]|a scris"
MARKS = {
    "gmail_quote": ("html", "(?i)<div[^>]*gmail_quote"),
    "blockquote": ("html", "(?i)<blockquote"),
    "append_on_send": ("html", "(?i)<div[^>]*id=[\"'']?appendonsend"),
    "outlook_rule": ("html", r"(?i)<hr[^>]*width:\s*98%"),
    "reply_forward": ("html", "(?i)<div[^>]*id=[\"'']?(x_)?divRplyFwdMsg"),
    "on_wrote": ("shut10", rf"(?i)\bOn\b[^{_SHUT}]{{0,200}}?wrote:"),
    "from_address": ("shut7", None),
    "foreign_wrote": ("shut7", f"(?i)({_VERBS})[^{_SHUT}]{{0,80}}?[:：]"),
    "chinese_wrote": ("html", r"写道\s*[:：]"),
    "chinese_from": ("html", r"发件人\s*[:：]"),
    "arabic_wrote": ("html", r"كتب\s*[:：]"),
    "original_message": ("html", r"(?i)-+\s*(original message|urspr[üÜ]ngliche nachricht|oprindelig meddelelse|reply message|antwort nachricht)\s*-*"),
}
_FROM = place_behind("shut7", "[^A-Za-z]", rf"(From|Von|De|Van|Da|Fra|Fr[åÅ]n):[^{_SHUT}]{{0,250}}?{_SOLID}+@{_SOLID}+\.{_SOLID}+")
PLACED = rf"""
shut AS (SELECT *, regexp_replace(html, '<(/(div|p|td|tr|table|blockquote|body|ul|ol|li))', chr(1) || '\1', 'gi') AS shut10, regexp_replace(html, '<(/(div|p|td|tr|table|blockquote|body))', chr(1) || '\1', 'gi') AS shut7 FROM pages),
placed AS (SELECT message_id, html, {', '.join(f"{place(c, p) if p else _FROM} AS at_{m}" for m, (c, p) in MARKS.items())} FROM shut)"""


def extract(noise: str, bounce: str) -> str:
    """From `pages` to `whole_` (message_id, extracted_html); bounce: a test of the column `opening`."""
    solid = f"list_filter(list_transform(string_split_regex({flat('html')}, '\\r?\\n'), lambda x: {trim('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '^\\[.*\\]$') AND NOT regexp_matches(x, '^https?://\\S+$', 'i'))[1]"
    signs = rf"regexp_matches(tail, 'class=[\"''][^\"'']*gmail_signature', 'i') OR regexp_matches(shown, '(?m)^\s*--\s*$') OR regexp_matches(shown, '{_SOLID}+@{_SOLID}+\.{_SOLID}|\+?\d[\d\-\s\x{{00A0}}().]{{7,}}|https?://|linkedin\.com|\b(regards|thanks|sincerely|cheers|best)\b', 'i')"
    more = r"regexp_matches(shown, '\bOn\b[\s\S]{0,200}?wrote:|-+\s*forwarded message|begin forwarded message:', 'i') OR regexp_matches(shown, '(?im)^\s*From:\s.{0,80}@')"
    lead = r"regexp_extract(tail, '(?i)^(\s*</(div|p|span|blockquote|td|tr|table|li)>|\s*<(div|p)[^>]*>\s*(<br[^>]*>\s*)*</(div|p)>|\s*<br[^>]*>)*', 0)"
    noisy = f"regexp_matches(v, '{noise}', 'i')"
    return rf"""{PLACED},
first_mark AS (SELECT message_id, html, least({', '.join(f'at_{m}' for m in MARKS)}) AS mark, {place('html', r'(?i)-+\s*forwarded message\s*-+|begin forwarded message:')} AS forward, {solid} AS opening FROM placed),
snapped AS (SELECT message_id, html, CASE WHEN mark >= length(html) OR forward < mark OR {bounce} THEN NULL WHEN strpos(left(html, mark + 1), '<') > 0 THEN length(regexp_extract(left(html, mark + 1), '(?s)^(.*)<', 1)) ELSE mark END AS cut FROM first_mark),
tails AS (SELECT message_id, html, cut, CASE WHEN regexp_matches(html, '</blockquote>', 'i') AND length(regexp_extract(html, '(?is)^(.*)</blockquote>', 1)) >= cut THEN regexp_extract(html, '(?is)^.*</blockquote>(.*)$', 1) END AS tail FROM snapped),
shown_ AS (SELECT *, {visible('tail')} AS shown FROM tails),
signed AS (SELECT message_id, html, cut, CASE WHEN ({signs}) AND NOT ({more}) THEN substr(tail, length({lead}) + 1) END AS sig FROM shown_),
parts_ AS (SELECT message_id, unnest({blocks('sig')}) AS part, generate_subscripts({blocks('sig')}, 1) AS i FROM signed WHERE sig IS NOT NULL),
seen_ AS (SELECT *, {block_text('part')} AS v FROM parts_),
last_ AS (SELECT message_id, coalesce(max(i) FILTER (WHERE v <> '' AND NOT {noisy}), 0) AS solid FROM seen_ GROUP BY message_id),
stop_ AS (SELECT s.message_id, min(i) FILTER (WHERE i > solid AND v <> '') AS stop FROM seen_ s JOIN last_ USING (message_id) GROUP BY s.message_id),
kept_ AS (SELECT s.message_id, coalesce(string_agg(part, '' ORDER BY i) FILTER (WHERE stop IS NULL OR i < stop), '') AS sig FROM seen_ s JOIN stop_ USING (message_id) GROUP BY s.message_id),
new_html AS (SELECT g.message_id, {bare("CASE WHEN g.cut IS NULL THEN g.html WHEN length(" + visible('k.sig') + ") BETWEEN 1 AND 400 THEN left(g.html, g.cut) || k.sig ELSE left(g.html, g.cut) END")} AS new_html, g.html FROM signed g LEFT JOIN kept_ k USING (message_id)),
whole_ AS (SELECT message_id, CASE WHEN html <> '' THEN {strip_noise('new_html', noise)} END AS extracted_html FROM new_html)"""
