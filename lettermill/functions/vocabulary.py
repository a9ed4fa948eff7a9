"""Vocabularies and patterns of mail clients that results depend on.

Patterns are in the notation of ``jsx.pattern``.  Letters outside ASCII are listed in both cases,
because case is folded for ASCII alone.
"""

from __future__ import annotations

DIVIDER_WORDS = ("original message", "urspr[üÜ]ngliche nachricht", "oprindelig meddelelse", "reply message", "antwort nachricht")
WROTE_WORDS = ("a [éÉ]crit", "escribi[óÓ]", "ha scritto", "escreveu", "schrieb", "schreef", "geschreven", "verzond", "skrev", "napisa[łŁ]", "[нН][аА][пП][иИ][сС][аА][лЛ]", "[đĐ][ãÃ] vi[ếẾ]t", "yazdı", "a scris")
FROM_LABELS = ("from", "von", "de", "van", "da", "fra", "fr[åÅ]n")
LONG_LABELS = ("from", "von")
DATE_LABELS = ("sent", "date", "gesendet", "envoy[éÉ]", "enviado", "enviada", "datum", "verzonden", "inviato", "skickat", "sendt")
GLUE_OPENERS = ("On", "Le", "Il", "W dniu", "Op", "Am", "P[åÅ]", "Den", "Em", "El", "V[àÀ]o", "في")
GLUE_VERBS = ("wrote", "sent", *WROTE_WORDS[:12], "كتب")
GLUE_DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun", "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec")
DSN_FIELDS = ("reporting-mta:", "final-recipient:", "original-recipient:", "diagnostic-code:", "action:<s>*failed", r"status:<s>*[45]\.\d")
DSN_HEADLINES = (
    "delivery (?:has )?failed", "address not found", "undelivered mail", "mail delivery (?:failed|subsystem)", "delivery status notification", "message not delivered",
    r"your message<e>[^\n]{0,80}?(?:wasn'?t|couldn'?t be|could not be) delivered", "returned mail", "message blocked", "this is the mail system", "this message was created automatically by mail",
    "i'?m sorry to have to inform you", "could not be delivered",
)
DSN_PHRASE = "rejected your message"
#: In lower case, what any of the above has.
DSN_HINTS = ("delivery failed", "delivery has failed", "mail delivery", "delivery status", "delivered", "address not found", "undelivered", "returned mail", "message blocked", "this is the mail system", "created automatically by mail", "sorry to have to inform you", "-mta:", "-recipient:", "diagnostic-code", "action:", "status:", "rejected your message")
FORWARD_LINE = "(?i)^(?:-+<s>*forwarded message<s>*-+|begin forwarded message:?)<s>*<$>"
FORWARD_HTML = "(?i)-+<s>*forwarded message<s>*-+|begin forwarded message:"
PASTED_FORWARD = "(?i)^(?:fw|fwd):<s>*<S>"

NOISE = (
    "(?i)^sent from (?:my |outlook|mail|yahoo|samsung)",
    "(?i)^get outlook for (?:ios|android)<e>",
    "(?i)<b>view (?:this email|it|this)?<s>*in (?:your )?(?:web )?browser<e>",
    "(?i)<b>you(?:'re| are) receiving this (?:e-?mail|message|because)<e>",
    "(?i)<b>you received this (?:e-?mail|message)<e>",
    "(?i)<b>manage (?:your )?(?:email )?(?:preferences|subscription)<e>",
    r"(?i)to unsubscribe|unsubscribe (?:here|from this|at any|below|now)<e>|click [^\n]{0,25}<b>unsubscribe<e>|<b>unsubscribe<e>[^\n]{0,40}(?:https?://|www\.)",
    r"(?i)<b>this (?:e-?mail|email|message|communication)<e>[^.\n]{0,60}<b>(?:confidential|privileged)<e>",
    "(?i)<b>confidentiality (?:notice|statement|warning)<e>",
    "(?i)<b>if you are not the intended recipient<e>",
    "(?i)<b>(?:intended|designated) (?:solely|only) for<e>",
    "(?i)<b>this (?:e-?mail|email|message) is not secure<e>",
    "(?i)<b>(?:please )?(?:do not|don'?t) print this (?:e-?mail|email|message)<e>",
    "(?i)^<s>*your personal data<e>",
)

#: In lower case, what a line of boilerplate has in any case.
NOISE_HINTS = ("sent from ", "get outlook for ", "browser", "receiving this ", "received this ", "preferences", "subscription", "unsubscribe", "confidential", "privileged", "intended ", "designated ", "not secure", "print this ", "your personal data")

#: Client wrappers and text marks that open quoted history in HTML; (name, pattern).
HTML_MARKERS = (
    ("gmail_quote", "(?i)<div[^>]*gmail_quote"),
    ("blockquote", "(?i)<blockquote"),
    ("append_on_send", "(?i)<div[^>]*id=[\"']?appendonsend"),
    ("outlook_rule", "(?i)<hr[^>]*width:<s>*98%"),
    ("reply_forward", "(?i)<div[^>]*id=[\"']?(?:x_)?divRplyFwdMsg"),
    ("on_wrote", r"(?i)<b>On<e>(?:(?!</(?:div|p|td|tr|table|blockquote|body|ul|ol|li))[\s\S]){0,200}?wrote:"),
    ("from_address", r"(?i)(?<![A-Za-z])(?:From|Von|De|Van|Da|Fra|Fr[åÅ]n):(?:(?!</(?:div|p|td|tr|table|blockquote|body))[\s\S]){0,250}?[^\s@\u00A0\uFEFF]+@[^\s@\u00A0\uFEFF]+\.[^\s@\u00A0\uFEFF]+"),
    ("foreign_wrote", r"(?i)(?:a [éÉe]crit|escribi[óÓo]|ha scritto|escreveu|schrieb|schreef|geschreven|verzond|skrev|napisa[łŁ]|[нН][аА][пП][иИ][сС][аА][лЛ]|[đĐ][ãÃ] vi[ếẾ]t|yazd[ıi]|a scris)(?:(?!</(?:div|p|td|tr|table|blockquote|body))[\s\S]){0,80}?[:：]"),
    ("chinese_wrote", "写道<s>*[:：]"),
    ("chinese_from", "发件人<s>*[:：]"),
    ("arabic_wrote", "كتب<s>*[:：]"),
    ("original_message", "(?i)-+<s>*(?:" + "|".join(DIVIDER_WORDS) + ")<s>*-*"),
)
#: In lower case, what each mark has in any case: all the words of one group.
HTML_HINTS = {
    "gmail_quote": (("gmail_quote",),),
    "blockquote": (("<blockquote",),),
    "append_on_send": (("appendonsend",),),
    "outlook_rule": (("<hr", "98%"),),
    "reply_forward": (("divrplyfwdmsg",),),
    "on_wrote": (("wrote:",),),
    "from_address": tuple((f"{x}:", "@") for x in ("from", "von", "de", "van", "da", "fra", "från")),
    "foreign_wrote": tuple((x,) for x in ("a écrit", "a ecrit", "escribi", "ha scritto", "escreveu", "schrieb", "schreef", "geschreven", "verzond", "skrev", "napisa", "написал", "đã vi", "yazd", "a scris")),
    "chinese_wrote": (("写道",),),
    "chinese_from": (("发件人",),),
    "arabic_wrote": (("كتب",),),
    "original_message": (("original message",), ("sprüngliche nachricht",), ("oprindelig meddelelse",), ("reply message",), ("antwort nachricht",)),
}
BLOCK_END = "(?i)(?<=</(?:div|p|tr|td|li|table|blockquote)>)"
SIGNATURE_SPAN = 400
