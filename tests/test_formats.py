"""Parsers of file formats on files made here."""

import io
import tarfile
import zipfile
from email.message import EmailMessage

from memlake.functions.text import matches, window_spans
from memlake.sources.feeds import parse_time
from memlake.sources.formats import archive_members, calendar_events, decoded, jsonl, mail_text, office_text, xml_text
from pyspark.sql import functions as F


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def one(spark, f, *contents):
    rows = spark.createDataFrame(list(enumerate(map(bytearray, contents))), "id long, content binary")
    return [x.t for x in rows.select("id", f(F.col("content")).alias("t")).orderBy("id").collect()]


def test_office_xml_and_mail(spark):
    word = zipped({"word/document.xml": '<w:d xmlns:w="u"><w:p><w:t>One </w:t><w:t>two</w:t></w:p><w:p/><w:p><w:t>three</w:t></w:p></w:d>'})
    sheet = zipped({"xl/sharedStrings.xml": "<sst><si><t>cell</t></si></sst>"})
    assert one(spark, office_text, word, sheet, b"no archive") == ["One two\nthree", "cell", None]
    assert one(spark, xml_text, b"<a>x<b> y </b></a>", b"<a>") == ["x y", None]
    m = EmailMessage()
    m["From"], m["Subject"] = "a@b.de", "Hi"
    m.set_content("the body")
    m.add_attachment(b"1", maintype="application", subtype="pdf", filename="f.pdf")
    assert one(spark, mail_text, m.as_bytes()) == ["From: a@b.de\nSubject: Hi\n\nthe body\nattachment: f.pdf"]
    assert one(spark, decoded, "é".encode(), b"\xe9") == ["é", "é"]


def test_archives(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        info = tarfile.TarInfo("b.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    rows = [(1, bytearray(zipped({"a.txt": "x", **{f"m{i}": "" for i in range(200)}}))), (2, bytearray(tar.getvalue())), (3, bytearray(b"junk")), (4, None)]
    got = archive_members(spark.createDataFrame(rows, "data_id long, content binary")).collect()
    assert sum(x.data_id == 1 for x in got) == 201 and sum(x.skipped for x in got) == 1
    assert [(x.member, bytes(x.content)) for x in got if x.data_id == 2] == [("b.txt", b"hi")] and {x.data_id for x in got} == {1, 2}


def test_lines_and_events(spark):
    text = "BEGIN:VEVENT\r\nSUMMARY:A long\r\n  day\r\nDTSTART;TZID=x:20240102\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nEND:VEVENT"
    got = calendar_events(spark.createDataFrame([(1, text), (2, None), (3, "")], "data_id long, text string")).orderBy("ordinal").collect()
    assert [(x.data_id, x.summary, x.starts) for x in got] == [(1, "A long day", "20240102"), (1, "", "")]
    lines = jsonl(spark.createDataFrame([(1, '{"b": 1}\n\n{"a"'), (2, None)], "data_id long, text string")).orderBy("line").collect()
    assert [(x.line, x.record, x.bad) for x in lines] == [(0, '{"b":1}', False), (2, None, True)]


def test_text_functions(spark):
    rows = spark.createDataFrame([(1, "Free licences granted to the reader"), (2, "no licence"), (3, None), (4, "")], "id long, t string")
    hit = lambda **k: {x.id for x in rows.where(matches(F.col("t"), **k)).collect()}
    assert hit(all_of=("licence",)) == {1, 2} and hit(phrases=("granted to",)) == {1} and hit(any_of=("no", "readers")) == {1, 2} and hit(all_of=("licence",), none_of=("reader",)) == {2}
    spans = spark.createDataFrame([("a" * 95 + ". " + "b" * 50,), ("",)], "t string").select(window_spans(F.col("t"), 100).alias("s")).collect()
    assert [[tuple(s) for s in x.s] for x in spans] == [[(0, 97), (97, 147)], []]
    times = spark.createDataFrame([("1700000000",), ("1700000000123",), ("2023-11-14T22:13:20Z",), ("soon",), (None,)], "t string").select(parse_time(F.col("t")).alias("s")).collect()
    assert [x.s for x in times] == [1700000000, 1700000000, 1700000000, None, None]
