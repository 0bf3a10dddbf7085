"""Text of further file formats. Each parser reads one file inside a task; Spark spreads the files."""

from __future__ import annotations

import email
import io
import tarfile
import zipfile
from email import policy
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Language by extension of code files, and families that need a model to be read.
CODE = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "c": "c", "cpp": "cpp", "cs": "csharp", "sh": "shell", "sql": "sql"}
MODEL_FAMILIES = ("image", "audio", "video")
#: Formats that can carry macros are refused.
MACROS = ("docm", "xlsm", "pptm")

#: Members of an archive, and bytes of each, that are read.
MEMBERS, MEMBER_BYTES = 200, 20 << 20


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def file_kind(name: Column, mime: Column) -> Column:
    """blocked, needs_model, code:<language>, the extension, or text. A file's extension says more than its MIME type."""
    languages = F.create_map(*[F.lit(x) for kv in CODE.items() for x in kv])
    ext = extension(name)
    return (
        F.when(ext.isin(*MACROS), "blocked")
        .when(languages[ext].isNotNull(), F.concat(F.lit("code:"), languages[ext]))
        .when(F.split(mime, "/")[0].isin(*MODEL_FAMILIES), "needs_model")
        .when(ext != "", ext)
        .otherwise("text")
    )


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def jsonl(files: DataFrame) -> DataFrame:
    """data_id, text -> data_id, line, record, bad: one row per non-blank line; record is null where the line is not JSON."""
    lines = files.select("data_id", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw")).where(F.trim("raw") != "")
    record = F.to_json(F.try_parse_json("raw"))
    return lines.select("data_id", "line", record.alias("record"), record.isNull().alias("bad"))


def _texts(parse):
    """A column function from bytes to text; null for files that the parser can't read."""

    @F.pandas_udf("string")
    def run(files: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else parse(bytes(x))
            except (ValueError, KeyError, SyntaxError, zipfile.BadZipFile):
                return None

        return files.map(one)

    return run


def _xml(data: bytes) -> str:
    return " ".join(t.strip() for t in ElementTree.fromstring(data).itertext() if t.strip())


def _office(data: bytes) -> str:
    """Paragraphs of a word-processing, presentation or open document, cells of a spreadsheet, a line each."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        wanted = [n for n in z.namelist() if n in ("word/document.xml", "content.xml", "xl/sharedStrings.xml") or n.startswith("ppt/slides/slide")]
        for name in sorted(wanted, key=lambda n: (len(n), n)):
            for node in ElementTree.fromstring(z.read(name)).iter():
                if node.tag.rsplit("}", 1)[-1] in ("p", "si"):
                    line = "".join(node.itertext()).strip()
                    out += [line] if line else []
    return "\n".join(out)


def _mail(data: bytes) -> str:
    """Headers, the body (plain if there is one) and the names of attachments."""
    m = email.message_from_bytes(data, policy=policy.default)
    body = m.get_body(("plain", "html"))
    heads = [f"{h}: {m[h]}" for h in ("From", "To", "Subject", "Date") if m[h]]
    files = [a.get_filename() or "" for a in m.iter_attachments()]
    return "\n".join([*heads, "", body.get_content().strip() if body else "", *(f"attachment: {f}" for f in files)]).strip()


def xml_text(content: Column) -> Column:
    return _texts(_xml)(content)


def office_text(content: Column) -> Column:
    return _texts(_office)(content)


def mail_text(content: Column) -> Column:
    return _texts(_mail)(content)


def calendar_events(files: DataFrame) -> DataFrame:
    """data_id, text of a calendar -> data_id, ordinal, summary, starts: one row per event; folded lines are joined first."""
    unfolded = F.regexp_replace("text", r"\r?\n[ \t]", "")
    each = files.select("data_id", F.posexplode(F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1))).alias("ordinal", "event"))
    field = lambda name: F.trim(F.regexp_extract("event", rf"(?m)^{name}[^:\r\n]*:([^\r\n]*)", 1))
    return each.select("data_id", "ordinal", field("SUMMARY").alias("summary"), field("DTSTART").alias("starts"))


def archive_members(files: DataFrame) -> DataFrame:
    """data_id, content -> data_id, member, content, for members of zip and tar files up to the bounds; ``skipped`` marks the rest."""

    def expand(batches):
        for pdf in batches:
            for data_id, content in zip(pdf.data_id, pdf.content, strict=True):
                raw, rows = io.BytesIO(bytes(content or b"")), []
                if zipfile.is_zipfile(raw):
                    with zipfile.ZipFile(raw) as z:
                        for n, info in enumerate(i for i in z.infolist() if not i.is_dir()):
                            over = n >= MEMBERS or info.file_size > MEMBER_BYTES
                            rows.append((data_id, info.filename, None if over else z.read(info), over))
                else:
                    raw.seek(0)
                    try:
                        with tarfile.open(fileobj=raw) as t:
                            for n, info in enumerate(i for i in t if i.isfile()):
                                over = n >= MEMBERS or info.size > MEMBER_BYTES
                                rows.append((data_id, info.name, None if over else t.extractfile(info).read(), over))
                    except tarfile.TarError:
                        pass
                for row in rows:
                    yield pd.DataFrame([row], columns=["data_id", "member", "content", "skipped"])

    return files.select("data_id", "content").mapInPandas(expand, "data_id long, member string, content binary, skipped boolean")


def dependencies(manifests: DataFrame) -> DataFrame:
    """data_id, name, text of requirement lists, package files and module files -> data_id, package."""
    plain = F.regexp_extract_all("text", F.lit(r"(?m)^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:[=<>~!\[;].*)?$"), F.lit(1))
    module = F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+v"), F.lit(1))
    package = F.map_keys(F.from_json(F.get_json_object("text", "$.dependencies"), "map<string,string>"))
    found = F.when(F.col("name").endswith(".txt"), plain).when(F.col("name").endswith("go.mod"), module).when(F.col("name").endswith(".json"), package)
    return manifests.select("data_id", F.explode(F.array_distinct(found)).alias("package"))

