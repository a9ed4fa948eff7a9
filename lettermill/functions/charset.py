"""From bytes to text.

``candidates`` names charsets in order of trust: byte-order mark, valid UTF-8, the declared name,
the detector's guess, Latin-1, which fits anything.  The detector decodes the head by every charset
it knows and takes the one whose text has most of the characters that its languages use most.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

from . import registry as R

_BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
#: Charsets with the letters that their languages use most, and the share of high characters these have in running text.
PROFILES = (
    (("shift_jis", "euc_jp"), "ぁ-んァ-ヶー、。", 0.5),
    (("gb2312", "gb18030"), "的一是不了在人有我他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可，。", 0.3),
    (("big5",), "的一是不了在人有我他這中大來上國個到說們為子和你地出道也時年得就那要下以生會自著去之過家學對可，。", 0.3),
    (("euc_kr",), "이다는에가을의고하지로한도를기사은리나시어서인그아자대해정라", 0.35),
    (("cp1251", "koi8_r", "iso8859_5", "cp866", "mac_cyrillic"), "оеаинтсрвлкмдпуяыгзбчй", 0.85),
    (("cp1253", "iso8859_7"), "αοιετσνηυρπκμλςάίόέήωτ", 0.85),
    (("cp1255", "iso8859_8"), "יוהלאמרתבשנםכדעפקחג", 0.9),
    (("cp1256", "iso8859_6"), "الينموترةبعدسفهكقحأج", 0.85),
    (("cp874",), "านรอกเงมยลวดทสตะปบคหแจพช่้าี", 0.85),
    (("cp1250", "iso8859_2"), "ąęłóśżźćńáéíěščřžýůúőűöüäăâîșțßđ", 0.8),
    (("cp1254",), "ıİşŞğĞüöçÜÖÇ", 0.8),
    (("cp1252", "latin_1"), "éèàùâêîôûçëïüäößñáíóúãõøåæÄÖÜÉ¿¡", 0.75),
)
_ESCAPED = ((b"\x1b$", "iso2022_jp"), (b"\x1b(J", "iso2022_jp"), (b"~{", "hz"))


def bom(b: bytes) -> str | None:
    return next((name for mark, name in _BOMS if b.startswith(mark)), None)


def is_utf8(b: bytes) -> bool:
    try:
        b.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def known(name: str | None) -> str | None:
    """The codec of a charset's name; None for other names, also such as Python has for codecs that are no charsets."""
    try:
        codec = codecs.lookup(name.strip()) if name else None
    except (LookupError, UnicodeError, ValueError):
        return None
    return codec.name if codec and codec._is_text_encoding and codec.name not in ("idna", "punycode", "undefined", "unicode_escape", "raw_unicode_escape") else None


@lru_cache(1)
def _counters() -> list[tuple[str, re.Pattern, float]]:
    return [(n, re.compile(f"[{letters}]"), share) for names, letters, share in PROFILES for n in names]


#: Signs of typesetting tell charsets of one family apart, not languages.
_HIGH, _SIGN = re.compile(r"[^\x00-\x7f]"), re.compile("[“”„‘’‚–—…•€«»\u00a0]")
#: What only a wrong table gives: signs and digits between letters, controls, two alphabets in a word, capitals within a word, accents in a row.
_BROKEN = re.compile(
    r"(?<=[^\W\d_])[^\w\s\x00-\x7f“”„‘’‚–—…•€«»·](?=[^\W\d_])|[\x80-\x9f]|(?<=[^\W\d_])[ºª²³¹¼½¾](?=[^\W\d_])|(?<=[a-zа-яα-ω])[À-ÞА-ЯΑ-Ω](?=[a-zа-яα-ω])"
    r"|(?<=[A-Za-z])[\u0370-\u0e7f]|[\u0370-\u0e7f](?=[A-Za-z])|[À-ÿ](?=[À-ÿ]{2})"
)


def _fit(text: str, letters: re.Pattern, usual: float, plain: bool) -> float:
    """How well a decoded head reads: 1 or more as its languages do, 0 or less not at all."""
    high = len(_HIGH.findall(text)) - len(_SIGN.findall(text))
    if high <= 0:
        return 0.5 if plain else 0.0
    return (len(letters.findall(text)) - 2 * len(_BROKEN.findall(text))) / (usual * high)


def detect(b: bytes) -> tuple[str | None, float]:
    """A guess and its confidence, from the head; (None, 0) where nothing fits."""
    head = b[: R.DETECT_SAMPLE_BYTES]
    if head.isascii():
        return next((name for mark, name in _ESCAPED if mark in head), "ascii"), 1.0
    best, sure = None, 0.0
    for name, letters, usual in _counters():
        try:  # a character that the head cuts is no fault
            text = codecs.getincrementaldecoder(name)().decode(head, final=len(b) <= len(head))
        except UnicodeDecodeError:
            continue
        # Of charsets that fit alike the one listed first is taken, as the commoner of its family.
        if (fit := _fit(text, letters, usual, name == "cp1252")) > sure + 0.02:
            best, sure = name, fit
    return best, min(sure, 1.0)


def _utf16_order(b: bytes) -> str:
    """The byte order of UTF-16 without a mark: the one with more ASCII."""
    head = b[: R.SNIFF_BYTES]
    return "utf-16-be" if head[0::2].count(0) > head[1::2].count(0) else "utf-16-le"


def candidates(b: bytes, hint: str | None = None) -> Iterator[str]:
    """Charsets of the bytes, the most trusted first."""
    if mark := bom(b):
        yield mark
    # Zeros are valid UTF-8, but UTF-16 without a mark is full of them and text has none.
    if 0 not in b[: R.SNIFF_BYTES] and is_utf8(b):
        yield "utf-8"
    if name := known(hint):
        yield _utf16_order(b) if name == "utf-16" else name
    guess, _ = detect(b)
    if guess:
        yield guess
    yield "latin-1"


def resolve(b: bytes, hint: str | None = None) -> str:
    return next(candidates(b, hint))


def decode(b: bytes, hint: str | None = None) -> str:
    """Text without a byte-order mark and with LF line ends.

    Where a charset that was only declared or guessed loses characters, Latin-1 keeps every byte.
    """
    text = b.decode(resolve(b, hint), "replace")
    if "\ufffd" in text and not bom(b) and not is_utf8(b):
        text = b.decode("latin-1")
    return text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
