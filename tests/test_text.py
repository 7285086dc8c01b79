"""Scalar functions against expectations worked out by hand."""

import base64

import pytest
from pyspark.sql import functions as F

from lantern.functions import markup
from lantern.functions import text as t


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_messages_are_normalised(spark):
    got = column(spark, t.normalize_message, ["a  b\t c \r\n\n  d​‏e  ", None, " \n ", "x y"])
    assert got == ["a b c\nde", "", "", "x\ny"]
    assert [markup.message_text(x) for x in ("a  b\t c \r\n\n  d​‏e  ", None, " \n ", "x y")] == got


def test_words(spark):
    assert column(spark, t.word_count, ["a b  c", "a b c", "", None, " - "]) == [3, 3, 0, 0, 1]
    assert column(spark, t.is_substantive, ["a b c", "a b c d"]) == [False, True]


def test_blank(spark):
    assert column(spark, t.not_blank, ["x", "  ", "\t", None, ""]) == [True, False, True, False, False]


def test_urls(spark):
    long = "https://a.example/" + "p" * 40
    urls = ["https://Zoom.us/j/1/", "http://a.example/short?q=1//", long, "no link", "https://b.example/event?x=1", "https://c.example?x=/join"]
    compact = ["Zoom.us/j/1", "a.example/short?q=1", "a.example", "no link", "b.example/event?x=1", "c.example?x=/join"]
    useful = [True, False, False, False, True, True]
    assert column(spark, t.compact_url, urls) == [markup.shorten_url(u) for u in urls] == compact
    assert column(spark, t.is_useful_url, urls) == [markup.useful_url(u) for u in urls] == useful
    assert column(spark, t.rewrite_urls, [f"see {urls[0]} and {long}) end", "plain", "https://zoom.us/j/2"]) == ["see Zoom.us/j/1 and ) end", "plain", "zoom.us/j/2"]


def test_cuts(spark):
    assert column(spark, t.cut_signature, ["hi\n-- \nme", "hi SENT FROM MY IPHONE x", "a email ref# 1 all rights reserved", "plain "]) == ["hi", "hi", "a", "plain"]
    assert column(spark, t.cut_quote, ["yes\nOn Monday X\nwrote: old", "on x wrote: y", "One thing it wrote: z"]) == ["yes\n", "on x wrote: y", ""]


def test_html_is_recognised(spark):
    assert column(spark, t.looks_like_html, ["<P>x", "</ div >", "a < b", None, "<pre>", "<table"]) == [True, True, False, False, False, True]


def test_base64url(spark):
    values = ["a", "ab", "abc?>~ü", ""]
    coded = column(spark, t.encode_base64url, values)
    assert coded == [base64.urlsafe_b64encode(v.encode()).decode() for v in values]
    assert column(spark, t.decode_base64url, [c.rstrip("=") for c in coded]) == values


def test_contacts(spark):
    handles = ["+1 (555) 123-4567", "12345", " Me@X.example ", "none", None, ""]
    assert column(spark, t.contact_keys, handles) == [["phone:15551234567", "phone:5551234567"], ["phone:12345"], ["email:me@x.example"], [], [], []]
    df = spark.createDataFrame([("", "A", None, "O"), (None, None, "", "O"), ("F", "A", "B", None), (None, None, None, None)], "a string, b string, c string, d string")
    assert [r[0] for r in df.select(t.contact_name(*map(F.col, "abcd"))).collect()] == ["A", "O", "F", None]


def test_labels_and_headers(spark):
    df = spark.createDataFrame([("", ["a", "b"], "id", 1), (None, [], "id", 2), (None, [], None, 3), ("n", [], "id", 4)], "d string, p array<string>, i string, c int")
    assert [r[0] for r in df.select(t.chat_label(*map(F.col, "dpic"))).collect()] == ["a, b", "id", "Chat 3", "n"]
    df = spark.createDataFrame([([("A", "1"), ("B", "2"), ("A", "3")],), ([],)], "h array<struct<name:string,value:string>>")
    assert [r[0] for r in df.select(t.header_map(F.col("h"))).collect()] == [{"B": "2", "A": "3"}, {}]
    assert column(spark, t.shorten, ["x" * 60, "é"]) == ["x" * 50 + "...", "é..."]


def test_times(spark):
    ns = [0, 813_465_000_000_000_000]
    shown = column(spark, lambda c: t.message_date(t.apple_timestamp(c)), ns, "long")
    assert shown[0] == "2000-12-31 07:00 PM"
    assert str(column(spark, t.parse_message_date, ["2026-11-01 01:30 AM"])[0]) == "2026-11-01 01:30:00"
    df = spark.createDataFrame(
        [("2024-05-01", None), (None, "2024-01-10T15:30:00Z"), (None, "2024-07-10T15:30:00+02:00"), (None, "2024-07-10T15:30:00"), (None, None)], "d string, t string"
    )
    assert [r[0] for r in df.select(t.event_time(F.col("d"), F.col("t"))).collect()] == [
        "All day on 2024-05-01",
        "Wednesday, January 10, 2024 at 10:30 AM ET",
        "Wednesday, July 10, 2024 at 09:30 AM ET",
        "Wednesday, July 10, 2024 at 03:30 PM ET",
        "Unknown time",
    ]


def test_mail_text():
    assert markup.mail_text("ﬁne &amp; dandy​\n(R)\nnow  (R)x https://zoom.us/j/1 https://no.example/a") == "fine & dandy (R) now (R) x zoom.us/j/1"
    assert markup.mail_text("a\nb\nb\n\nb\nc") == "a\nb\nb b\nc" and markup.mail_text("a\nb\nb\nc") == "a\nb\nc"
    assert markup.mail_text(None) == ""


def test_html_text():
    page = "<p>Hi <b>you</b><script>x()</script><style>.a{}</style><a href='https://zoom.us/j/9'>Join us</a> <a href='https://zoom.us/j/9'>here</a><a href='https://no.example'>plain</a>"
    assert markup.html_text(page) == "Hi\nyou\nJoin us (zoom.us/j/9)\nzoom.us/j/9\nplain"
    assert markup.html_file_text("<p>a&amp;b<script>x</script>") == "a&b\nx"
    assert markup.calendar_text("&lt;p&gt;one&lt;/p&gt;<br>two") == "one\ntwo"


def test_body_parts():
    html, plain = {"mimeType": "text/html", "body": {"data": "aA"}}, {"mimeType": "text/plain", "body": {"data": "bB"}}
    nest = {"mimeType": "multipart/alternative", "parts": [html, plain]}
    assert markup.body_part([nest]) == ("bB", "plain") and markup.body_part([html]) == ("aA", "html") and markup.body_part([]) == (None, "html")
    assert markup.body_part([{"mimeType": "text/plain", "body": {}}, html]) == (None, "plain")


def test_trees():
    run = lambda s: {"textRun": {"content": s}}
    para = lambda s: {"paragraph": {"elements": [run(s)]}}
    doc = {"tabs": [{"tabProperties": {"tabId": "t1", "title": "One"}, "documentTab": {"body": {"content": [para("a\n"), {"table": {"tableRows": [{"tableCells": [{"content": [para("c")]}]}]}}]}},
                     "childTabs": [{"tabProperties": {"tabId": "t2"}, "documentTab": {"body": {"content": [{"tableOfContents": {"content": [para("toc")]}}]}}}]}, {}]}
    assert markup.document_sections(doc) == [("t1", "One", "Document tab", "a\nc"), ("t2", "Untitled tab", "Document tab", "toc")]
    shape = lambda s, y, kind="": {"transform": {"translateY": y}, "shape": {"placeholder": {"type": kind}, "text": {"textElements": [run(s)]}}}
    table = {"table": {"tableRows": [{"tableCells": [{"text": {"textElements": [run("x")]}}, {"text": {}}, {"text": {"textElements": [run("y")]}}]}]}, "transform": {"translateY": 1}}
    slides = {"slides": [{"objectId": "s1", "pageElements": [shape("low", 9), shape("T", 5, "TITLE"), {"elementGroup": {"children": [shape("in", 3)]}}, table]}, {"pageElements": []}]}
    assert markup.presentation_sections(slides) == [("s1", "T", "Slide title", "Slide 1\nTitle: T\nx | y\nin\nlow")]


def test_sheets_and_limits():
    assert markup.sheet_lines([["", ""], ["h", ""], ["1", "2"], ["", "3", "4"]]) == "h: 1\nColumn 2: 2, 3\nColumn 3: 4"
    assert markup.sheet_lines([["a", "", "b"]]) == "a | b" and markup.sheet_lines([[""]]) == ""
    with pytest.raises(markup.Unsupported):
        markup.extract_file("text/plain", b"x", markup.MOST_BYTES + 1)
    assert markup.extract_file("text/plain", b" x ", markup.MOST_BYTES) == "x"
    with pytest.raises(markup.Unsupported):
        markup.extract_file("image/png", b"x", 1)
    assert markup.extract_file("application/vnd.google-apps.document", b"a  b", 1) == "a b"
    with pytest.raises(markup.Unsupported):
        markup.sections_of("document", None, "", markup.MOST_BYTES + 1)


def test_office_files():
    import io
    import zipfile

    def packed(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in files.items():
                z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
        return out.getvalue()

    w = f'xmlns:w="{markup.WORD}"'
    p = lambda s: f"<w:p><w:r><w:t>{s}</w:t></w:r></w:p>"
    docx = packed(word__document_dot_xml=f"<w:document {w}><w:body>{p('one')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('two')}</w:body></w:document>")
    assert markup.docx_text(docx) == "one\ntwo\na | b"
    s = f'xmlns="{markup.SHEET}"'
    book = f'<workbook {s} xmlns:r="{markup.RELATION}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
    cells = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>k</t></is></c></row><row><c r="A2"><v>5</v></c><c r="B2"><v>6</v></c></row>'
    xlsx = packed(
        xl__workbook_dot_xml=book, xl___rels__workbook_dot_xml_dot_rels=rels, xl__sharedStrings_dot_xml=f"<sst {s}><si><t>head</t></si></sst>",
        xl__worksheets__sheet1_dot_xml=f"<worksheet {s}><sheetData>{cells}</sheetData></worksheet>",
    )
    assert markup.xlsx_text(xlsx) == "Sheet: S\nhead: 5\nColumn 2: 6"
    assert markup.extract_file("application/vnd.google-apps.spreadsheet", xlsx, len(xlsx)) == "Sheet: S\nhead: 5\nColumn 2: 6"
