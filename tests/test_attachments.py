"""Routing, charsets, archive preflight, parsers and the result contract."""

import base64
import hashlib
import io
import random
import struct
import time
import zipfile
import zlib

import pytest

from lettermill.functions import archive
from lettermill.functions import registry as R
from lettermill.functions.charset import decode
from lettermill.functions.parsers import _PAD, _rc4, glyph, html_text, pdf_text
from lettermill.functions.routing import detect_route, readable_utf16
from lettermill.operators.attachments import HandlerTimeout, cap, detect_route_udf, extract_attachments, extract_one, routes, time_limit

DOCX = R.CONTENT_TYPES["docx"][0]
XLSX = R.CONTENT_TYPES["xlsx"][0]


def zipped(files, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    return zipped({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'})


def xlsx():
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return zipped(
        {
            "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="One" r:id="a"/><sheet name="Blank" r:id="b"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/s2.xml"/></Relationships>',
            "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>Area</t></si><si><r><t>We</t></r><r><t>st</t></r></si></sst>',
            "xl/styles.xml": f'<styleSheet xmlns="{s}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
            "xl/worksheets/s1.xml": f'<worksheet xmlns="{s}"><sheetData><row><c t="s"><v>0</v></c><c/><c><v>7300</v></c></row><row><c t="s"><v>1</v></c><c s="1"><v>45000</v></c><c t="b"><v>1</v></c><c><f>A1</f><v>2.5</v></c></row></sheetData></worksheet>',
            "xl/worksheets/s2.xml": f'<worksheet xmlns="{s}"><sheetData/></worksheet>',
        }
    )


def pdf(*lines):
    text = "BT /F1 12 Tf 72 700 Td " + " ".join(f"({x}) Tj 0 -14 Td" for x in lines) + " ET"
    stream = zlib.compress(text.encode("cp1252"))
    return b"%%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1>>endobj\n3 0 obj<</Type/Page/Parent 2 0 R/Contents 4 0 R>>endobj\n4 0 obj<</Filter/FlateDecode/Length %d>>stream\n%s\nendstream endobj\n%%%%EOF" % (len(stream), stream)


def word97(text):
    """A compound file with a WordDocument of one 16-bit piece and its table, both over the mini-stream limit."""
    body = text.encode("utf-16-le")
    word = bytearray(8192)
    struct.pack_into("<H", word, 0, 0xA5EC)
    struct.pack_into("<H", word, 10, 0x0200)
    struct.pack_into("<I", word, 0x4C, len(text))
    clx = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 0x800, 0)
    struct.pack_into("<II", word, 0x1A2, 0, len(clx))
    word[0x800 : 0x800 + len(body)] = body
    table = clx.ljust(4096, b"\0")
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, 18), 0xFFFFFFFE, *range(19, 26), 0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))

    def entry(name, kind, start, size):
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<III", start, size, 0)

    root = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("WordDocument", 2, 2, 8192) + entry("1Table", 2, 18, 4096) + b"\0" * 128
    head = R.OLE + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<8I", 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", *([0] + [0xFFFFFFFF] * 108)) + struct.pack("<128I", *fat) + root + bytes(word) + table


@pytest.mark.parametrize(
    ("content", "name", "declared", "route"),
    [
        (b"a,b", "data.csv", "text/csv", ("text", "content-type")),
        (b"a,b", "data.csv", "application/octet-stream", ("text", "extension")),
        (b"plain", None, None, ("text", "sniff")),
        (b"plain", None, "Application/Unknown; x=1", ("text", "sniff")),
        (b"plain", "x.txt", "image/png", ("text", "extension")),
        (b"plain", "x.png", "image/png", (None, "none")),
        (b"From: a", None, "message/rfc822", (None, "none")),
        (b"{\\rtf1", "memo.rtf", "text/rtf", (None, "none")),
        (b"{\\rtf1", "memo.txt", "text/plain", (None, "none")),
        (b"<x>", None, "text/x-amp-html", ("html", "content-type")),
        (b"%PDF-1.4", "x.txt", "text/plain", ("pdf", "sniff")),
        (docx("a"), "x.xlsx", XLSX, ("docx", "sniff")),
        (docx("a"), "x", DOCX, ("docx", "content-type")),
        (R.OLE + b"x", "x.doc", "text/plain", ("doc", "sniff")),
        (R.OLE + b"x", "x.xls", "application/msword", (None, "none")),
        (R.OLE + b"x", None, "application/msword", ("doc", "content-type")),
        (b"", "x.pdf", "application/pdf", (None, "none")),
        (b"", "x.txt", "text/plain", ("text", "content-type")),
        (b"\x00\x01\x02", "x.txt", "text/plain", (None, "none")),
        ("hé".encode("utf-16-le"), "x.txt", "text/plain; charset=utf-16le", ("text", "content-type")),
        (b"\x89PNG\r\n\x1a\n" + random.Random(1).randbytes(9000), "x.txt", "text/plain; charset=utf-16", (None, "none")),
        (b"a", "x.txt", "text/plain; charset=utf-16", ("text", "sniff")),
        (b"PK\x03\x04 word/document.xml xl/workbook.xml", None, None, ("docx", "sniff")),
    ],
)
def test_route(content, name, declared, route):
    got = detect_route(content, name, declared)
    if content == b"" and route[0] is None:  # an empty file keeps its claim
        route = ("pdf", "content-type")
    assert got == route


def test_utf16_structure():
    ok = "a😀".encode("utf-16-le")
    assert readable_utf16(ok, "utf-16-le") and not readable_utf16(b"\x00\xd8a\x00", "utf-16-le") and not readable_utf16(b"\x00\xdc", "utf-16-le")
    assert not readable_utf16(b"\xfe\xff", "utf-16-le") and not readable_utf16(b"a", "utf-16-le")
    edge = b"a\x00" * 4095 + b"\x3d\xd8"
    assert readable_utf16(edge + b"\x00\xde", "utf-16-le") and not readable_utf16(edge, "utf-16-le")


@pytest.mark.parametrize(
    ("raw", "hint", "text"),
    [
        ("é".encode(), "latin-1", "é"),
        (b"\xef\xbb\xbfa", "utf-16", "a"),
        ("é".encode("utf-16"), None, "é"),
        ("h\né".encode("utf-16-be"), "utf-16be", "h\né"),
        ("h".encode("utf-16-le"), "utf-16", "h"),
        (b"caf\xe9", "windows-1252", "café"),
        (b"caf\xe9", "no-such-set", "café"),
        (b"caf\xe9", None, "café"),
        (b"a\r\nb\rc", None, "a\nb\nc"),
        (b"\x93a\x94", None, "“a”"),
    ],
)
def test_decode(raw, hint, text):
    assert decode(raw, hint) == text


def test_preflight_reasons():
    good = docx("a")
    end = good.rfind(archive.END_MARK)
    start = struct.unpack_from("<I", good, end + 16)[0]

    def patched(at, value, size="<I"):
        b = bytearray(good)
        struct.pack_into(size, b, at, value)
        return bytes(b)


    def why(b, most=1 << 20):
        with pytest.raises(archive.Refused) as e:
            archive.measured(b, most)
        return e.value.status, str(e.value)

    assert archive.measured(good, 1 << 20)
    assert "no end-of-central" in why(b"PK")[1] and why(b"PK")[0] == "failed"
    assert why(patched(end + 10, 0xFFFF, "<H"))[0] == "skipped"
    assert "does not end" in why(patched(end + 16, start + 1))[1]
    assert "misaligned" in why(patched(start, 0))[1]
    assert why(patched(start + 20, 0xFFFFFFFF)) == ("skipped", "zip declares a ZIP64 / out-of-range size")
    assert "bad local header" in why(patched(start + 42, 5))[1]
    assert "runs past" in why(patched(start + 20, 1 << 20))[1]
    assert "unreadable compressed" in why(bytes(bytearray(good[:60]) + b"\xff" * 20 + good[80:]))[1]
    assert why(patched(start + 10, 12, "<H")) == ("skipped", "zip uses unsupported compression method 12")
    assert why(zipped({"word/document.xml": b"a" * 5000}), 4999) == ("skipped", "decompresses to over 4999 bytes")
    assert why(zipped({"word/document.xml": b"a" * 5000}, zipfile.ZIP_STORED), 4999)[0] == "skipped"
    two = zipped({"word/document.xml": "a", "b": "b"})
    b = bytearray(two)
    struct.pack_into("<H", b, two.rfind(archive.END_MARK) + 10, 1)
    assert "more records" in why(bytes(b))[1]


def test_parsers():
    assert extract_one(docx("First", "Second"), None, DOCX) == ("extracted", "First\n\nSecond\n\n", None)
    assert extract_one(docx(), None, DOCX) == ("extracted", None, None)
    assert extract_one(xlsx(), "a.xlsx", None) == ("extracted", "=== One ===\nArea\t7300\nWest\t2023-03-15\tTRUE\t2.5", None)
    assert extract_one(pdf("Hello from a page", "and a second line"), None, "application/pdf")[1] == "Hello from a page\nand a second line"
    assert extract_one(pdf(), None, "application/pdf") == ("extracted", None, None)
    assert extract_one(word97("Body about revenue\rand costs"), "a.doc", None) == ("extracted", "Body about revenue\nand costs", None)
    assert html_text("<h1>T</h1><p>a <b>b</b></p><img alt=x><script>z</script><table><tr><td>1</td><td>2</td></tr></table><a href=u>l</a>") == "T\n\na b\n\n 1 2\n\nl"


def large_word97(text, at=7_300_000):
    """Text so far on in the file that its allocation table has more sectors than the header lists."""
    word = bytearray(-(-(at + len(text)) // 512) * 512)
    struct.pack_into("<H", word, 0, 0xA5EC)
    struct.pack_into("<H", word, 10, 0x0200)
    struct.pack_into("<I", word, 0x4C, len(text))
    clx = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 0x40000000 | at * 2, 0)
    struct.pack_into("<II", word, 0x1A2, 0, len(clx))
    word[at : at + len(text)] = text.encode("cp1252")
    table = clx.ljust(4096, b"\0")
    n_word, n_fat = len(word) // 512, 125
    first = n_fat + 2  # after the list, the allocation table and the directory
    ends = first + n_word
    fat = [0xFFFFFFFC] + [0xFFFFFFFD] * n_fat + [0xFFFFFFFE, *range(first + 1, ends), 0xFFFFFFFE, *range(ends + 1, ends + 8), 0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (n_fat * 128 - len(fat))

    def entry(name, kind, start, size):
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<III", start, size, 0)

    root = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("WordDocument", 2, first, len(word)) + entry("1Table", 2, ends, len(table)) + bytes(128)
    head = R.OLE + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<8I", n_fat, n_fat + 1, 0, 4096, 0xFFFFFFFE, 0, 0, 1)
    listed = struct.pack("<128I", *range(110, n_fat + 1), *[0xFFFFFFFF] * (127 - (n_fat - 109)), 0xFFFFFFFE)
    return head + struct.pack("<109I", *range(1, 110)) + listed + struct.pack(f"<{len(fat)}I", *fat) + root + bytes(word) + table


def test_large_doc():
    good = large_word97("Body about revenue\rand costs")
    assert 7_200_000 < len(good) < R.MAX_INPUT_BYTES
    assert extract_one(good, "a.doc", None) == ("extracted", "Body about revenue\nand costs", None)
    # The list of the allocation table is missing, or the stream ends before its declared length.
    assert extract_one(good[:72] + bytes(4) + good[76:], "a.doc", None)[0] == "failed"
    assert extract_one(good[:7_000_000], "a.doc", None)[0] == "failed"



def test_contract():
    assert extract_one(b"", "x.pdf", "application/pdf") == ("extracted", None, None)
    assert extract_one(b"a" * (R.MAX_INPUT_BYTES + 1), "a.txt", None) == ("skipped", None, f"{R.MAX_INPUT_BYTES + 1} bytes exceeds {R.MAX_INPUT_BYTES}")
    assert extract_one(b"\x89PNG", "a.png", "image/PNG; x=1") == ("skipped", None, "unsupported type image/png")
    assert extract_one(b"\x00\x01", None, None) == ("skipped", None, "unrecognized attachment")
    assert extract_one(b"%PDF-1.4 nothing", None, "application/pdf")[0] == "failed"
    assert extract_one(b" \n ", "a.txt", None) == ("extracted", None, None)
    assert len(extract_one(b"A" * 500_000, "a.txt", None)[1]) == R.MAX_OUTPUT_CHARS
    assert cap("a" + "😀" * 3, 4) == "a😀"
    for seed in range(200):
        r = random.Random(seed)
        b = r.choice([b"", b"%PDF-", b"PK\x03\x04", R.OLE]) + r.randbytes(r.randint(0, 600))
        assert extract_one(b, r.choice([None, "a.doc", "a.docx", "a.txt"]), r.choice([None, DOCX, "application/msword", "text/plain"]))[0] in ("extracted", "skipped", "failed")


def test_time_limit_interrupts():
    with pytest.raises(HandlerTimeout, match="handler exceeded 50ms"), time_limit(50):
        while True:
            time.sleep(0.01)


def test_frames(spark):
    rows = [(1, bytearray(b"a,b"), "d.csv", "text/csv", "x"), (1, bytearray(b"a,b"), "d.csv", "text/csv", "x"), (2, None, None, None, "x"), (3, bytearray(b"x" * (R.MAX_INPUT_BYTES + 1)), "b.txt", None, "x"), (None, bytearray(pdf("Hi")), None, None, "x")]
    df = spark.createDataFrame(rows, "attachment_id bigint, content binary, filename string, content_type string, status string")
    got = sorted(map(tuple, extract_attachments(df).collect()), key=str)
    assert got == sorted([(1, "extracted", "a,b", None)] * 2 + [(2, "extracted", None, None), (3, "skipped", None, f"{R.MAX_INPUT_BYTES + 1} bytes exceeds {R.MAX_INPUT_BYTES}"), (None, "extracted", "Hi", None)], key=str)
    assert {tuple(r) for r in routes(df.where("attachment_id < 3")).collect()} == {(1, "text", "content-type"), (2, None, "none")}
    assert extract_attachments(df.limit(0)).collect() == []
    r = df.where("attachment_id = 1").select(detect_route_udf("content", "filename", "content_type").alias("r")).first().r
    assert (r.kind, r.routed_by) == ("text", "content-type")


SENTENCES = {
    "shift_jis": "東京の天気は晴れです。明日の会議は午後三時からになりますので、よろしくお願いします。",
    "euc_jp": "東京の天気は晴れです。明日の会議は午後三時からになりますので、よろしくお願いします。",
    "gb2312": "我们的会议在明天下午三点开始，请大家准时到，不要来得太晚。这个地方有人在学中文。",
    "big5": "我們的會議在明天下午三點開始，請大家準時到，不要來得太晚。這個地方有人在學中文。",
    "euc_kr": "내일 오후 세 시에 회의가 있습니다. 이 문서는 한국어로 쓰여 있으며 다시 읽어 주시기 바랍니다.",
    "cp1251": "Добрый день, встреча состоится завтра в три часа дня в главном здании.",
    "koi8_r": "Добрый день, встреча состоится завтра в три часа дня в главном здании.",
    "cp1253": "Η συνάντηση θα γίνει αύριο το απόγευμα στις τρεις η ώρα στο κεντρικό κτίριο.",
    "cp1255": "הפגישה תתקיים מחר אחר הצהריים בשעה שלוש בבניין הראשי של החברה.",
    "cp1256": "سيعقد الاجتماع غدا بعد الظهر في الساعة الثالثة في المبنى الرئيسي للشركة.",
    "cp874": "การประชุมจะจัดขึ้นในวันพรุ่งนี้เวลาสามโมงเย็นที่อาคารหลักของบริษัท",
    "cp1250": "Spotkanie odbędzie się jutro po południu o trzeciej w głównym budynku, proszę się nie spóźnić, ważna sprawa.",
    "cp1252": "Die Besprechung beginnt morgen früh um zehn Uhr im großen Gebäude über der Straße, schöne Grüße.",
}


def test_western_and_central_sets_apart():
    for charset, text in (
        ("cp1252", "Merci de ne pas transmettre la livraison après les vacances, parce que la façade ne correspond pas. Le contrat était déjà prêt, à côté, où ça."),
        ("cp1252", "La revisión del año que viene está en el almacén, ¿podrías comprobarlo mañana?"),
        ("cp1250", "Příští týden bude schůzka v hlavní budově, prosím přijďte včas, děkuji všem."),
        ("iso8859_2", "Proszę nie wysyłać katalogu próbek nikomu w ciągu dziesięciu dni, ponieważ budżet się nie zgadza."),
    ):
        assert decode(text.encode(charset)) == text


@pytest.mark.parametrize("charset", SENTENCES)
def test_detected_charsets(charset):
    text = SENTENCES[charset] * 3
    assert decode(text.encode(charset)) == text


@pytest.mark.parametrize("name", ["rot13", "base64", "idna", "no-such-set", "", None])
def test_names_that_are_no_charsets(name):
    assert decode("für".encode("cp1252"), name) == "für"


def _lzw_of(data):
    """Codes of nine bits, the table cleared before they grow."""
    codes = [256]
    for k, x in enumerate(data):
        if k and k % 200 == 0:
            codes.append(256)
        codes.append(x)
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def _run_lengths(data):
    out = b""
    for k in range(0, len(data), 100):
        part = data[k : k + 100]
        out += bytes([len(part) - 1]) + part
    return out + b"\x80"


SHOWN = b"BT /F1 12 Tf 72 700 Td (First line) Tj 0 -14 Td (Second line) Tj ET"
FILTERED = {
    b"/ASCIIHexDecode": SHOWN.hex().encode() + b">",
    b"/ASCII85Decode": base64.a85encode(SHOWN) + b"~>",
    b"/RunLengthDecode": _run_lengths(SHOWN),
    b"/LZWDecode": _lzw_of(SHOWN),
    b"[/ASCII85Decode /FlateDecode]": base64.a85encode(zlib.compress(SHOWN)) + b"~>",
    b"/FlateDecode/DecodeParms<</Predictor 12/Columns 8>>": zlib.compress(b"".join(b"\x00" + SHOWN.ljust(72)[k : k + 8] for k in range(0, 72, 8))),
}


def _pdf_of(head, stream, more=b"", font=b""):
    return b"%%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1>>endobj\n3 0 obj<</Type/Page/Parent 2 0 R/Contents 4 0 R%s>>endobj\n4 0 obj<<%s/Length %d>>stream\n%s\nendstream endobj\n%s%%%%EOF" % (font, head, len(stream), stream, more)


@pytest.mark.parametrize("name", FILTERED)
def test_pdf_filters(name):
    assert pdf_text(_pdf_of(b"/Filter" + name, FILTERED[name])).split() == ["First", "line", "Second", "line"]


@pytest.mark.parametrize("revision", [2, 3])
def test_pdf_that_an_empty_password_opens(revision):
    owner, file_id, p, size = bytes(range(40, 72)), b"0123456789abcdef", -44, 5 if revision == 2 else 16
    key = hashlib.md5(_PAD + owner + (p & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()[:size]
    if revision == 2:
        user = _rc4(key, _PAD)
    else:
        for _ in range(50):
            key = hashlib.md5(key).digest()[:size]
        user = _rc4(key, hashlib.md5(_PAD + file_id).digest())
        for k in range(1, 20):
            user = _rc4(bytes(x ^ k for x in key), user)
        user += bytes(16)
    own = hashlib.md5(key + b"\4\0\0" + b"\0\0").digest()[: min(size + 5, 16)]
    entry = b"5 0 obj<</Filter/Standard/V %d/R %d/Length %d/P %d/O<%s>/U<%s>>>endobj\ntrailer<</Encrypt 5 0 R/ID[<%s><%s>]>>\n" % (revision - 1, revision, size * 8, p, owner.hex().encode(), user.hex().encode(), file_id.hex().encode(), file_id.hex().encode())
    assert pdf_text(_pdf_of(b"", _rc4(own, SHOWN), entry)).split("\n") == ["First line", "Second line"]
    locked = entry.replace(user.hex().encode(), bytes(len(user)).hex().encode())
    assert extract_one(_pdf_of(b"", _rc4(own, SHOWN), locked), None, "application/pdf") == ("failed", None, "encrypted pdf")


def test_pdf_fonts_that_name_glyphs():
    font = b"/Resources<</Font<</F1 6 0 R>>>>"
    more = b"6 0 obj<</Type/Font/Encoding<</Differences[1/H/eacute/l/uni00F6 65/fi/quoteright]>>>>endobj\n"
    assert pdf_text(_pdf_of(b"", b"BT /F1 12 Tf (\\001\\002\\003\\004AB) Tj ET", more, font)) == "Hélöfi’"
    assert [glyph(x) for x in ("Zcaron", "Aring", "g123", "u1F600", "a.sc")] == ["Ž", "Å", "", "😀", "a"]
