"""Parsers of formats and the classification cascade."""

from __future__ import annotations

import csv
import io
import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class _Page(HTMLParser):
    SKIP = {"script", "style", "noscript"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.where, self.lines, self.title, self.heads = 0, [], [], "", []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        if tag in ("title", "h1", "h2", "h3"):
            self.where.append(tag)

    def handle_endtag(self, tag):
        self.skip -= tag in self.SKIP and self.skip > 0
        if self.where and self.where[-1] == tag:
            self.where.pop()

    def handle_data(self, data):
        text = " ".join(data.split())
        if not text or self.skip:
            return
        if self.where and self.where[-1] == "title":
            self.title += text
            return
        if self.where and len(self.heads) < 50:
            self.heads.append(text)
        self.lines.append(text)


def html_text(page: Column) -> Column:
    """struct(text, title, headings): text without scripts and styles, a line for each run; at most 50 h1 to h3."""

    @F.pandas_udf("struct<text string, title string, headings array<string>>")
    def parse(pages: pd.Series) -> pd.DataFrame:
        out = []
        for p in pages:
            h = _Page()
            h.feed(p or "")
            h.close()
            out.append(("\n".join(h.lines), h.title, h.heads))
        return pd.DataFrame(out, columns=["text", "title", "headings"])

    return parse(page)


def json_text(doc: Column) -> Column:
    """Pretty, key-sorted JSON; null if it does not parse."""

    @F.pandas_udf("string")
    def pretty(docs: pd.Series) -> pd.Series:
        def one(x):
            try:
                return json.dumps(json.loads(x), indent=2, sort_keys=True, ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return docs.map(one)

    return pretty(doc)


def csv_lines(doc: Column, cap: int = 20_000) -> Column:
    """Rows as ``header: value; ...``, empty cells skipped, at most ``cap`` rows."""

    @F.pandas_udf("array<string>")
    def lines(docs: pd.Series) -> pd.Series:
        def one(x):
            rows = list(csv.reader(io.StringIO(x or "")))
            return ["; ".join(f"{h}: {v}" for h, v in zip(rows[0], r, strict=False) if v.strip()) for r in rows[1 : cap + 1]] if rows else []

        return docs.map(one)

    return lines(doc)


def capped(text: Column, cap: int = 2_000_000) -> tuple[Column, Column]:
    """Text without NUL, cut at ``cap`` characters, and whether it was cut."""
    clean = F.replace(text, F.lit("\x00"), F.lit(""))
    return F.substring(clean, 1, cap), F.length(clean) > cap


def turns(lines: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> consecutive lines of one speaker merged: conv_id, first_turn, role, n, text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.when(F.lag("role").over(w).eqNullSafe(F.col("role")), 0).otherwise(1)
    runs = lines.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return runs.groupBy("conv_id", "run", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"), F.array_join(said, " ").alias("text")).drop("run")


#: Kinds by MIME type, used when nothing nearer says otherwise.
KIND_BY_MIME = {"text/html": "page", "application/json": "record", "text/csv": "table", "text/plain": "note"}


def looks_html(text: Column) -> Column:
    """The text opens as a page; behind an XML declaration or a comment the page may open within the first 1,024 characters."""
    head = F.lower(F.substring(F.regexp_replace(text, "^[\\x{FEFF} \\t\\r\\n]+", ""), 1, 1024))
    return head.startswith("<!doc") | head.startswith("<html") | ((head.startswith("<?xml") | head.startswith("<!--")) & head.contains("<html"))


def looks_binary(text: Column) -> Column:
    """A NUL, or more than three tenths control characters, among the first 4,096 characters."""
    head = F.substring(text, 1, 4096)
    controls = F.length(head) - F.length(F.regexp_replace(head, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    return F.contains(head, F.lit("\x00")) | ((F.length(head) > 0) & (controls > 0.3 * F.length(head)))


def sniffed(text: Column) -> Column:
    """MIME type of a text: JSON if it opens and ends with brackets (an empty text counts), a page by its opening, else plain."""
    first, last = F.substring(F.regexp_replace(text, r"(?U)^\s+", ""), 1, 1), F.substring(F.regexp_replace(text, r"(?U)^\s+", ""), -1, 1)
    return F.when(first.isin("{", "[", "") & last.isin("}", "]", ""), "application/json").when(looks_html(text), "text/html").otherwise("text/plain")


def sniffed_bytes(content: Column) -> Column:
    """MIME type of a payload without a magic number: what is not UTF-8, or decodes to control characters, is binary."""
    text = F.when(F.is_valid_utf8(content), F.decode(content, "utf-8"))
    return F.when(text.isNull() | looks_binary(text), "application/octet-stream").when(looks_html(text), "text/html").otherwise("text/plain")


def classify(declared: Column, memory_default: Column, claimed: Column, content: Column) -> Column:
    """struct(kind, layer): declared by the writer (1), by the container (3), by the claimed type unless the content contradicts it
    (4), by the content (5), else unknown (0)."""
    kinds = F.create_map(*[F.lit(x) for kv in KIND_BY_MIME.items() for x in kv])
    real = sniffed(content)
    believed = F.when((real == "text/plain") | (claimed == real), kinds[claimed])
    kind = F.coalesce(declared, memory_default, believed, kinds[real], F.lit("unknown"))
    layer = F.when(declared.isNotNull(), 1).when(memory_default.isNotNull(), 3).when(believed.isNotNull(), 4).when(kinds[real].isNotNull(), 5).otherwise(0)
    return F.struct(kind.alias("kind"), layer.alias("layer"))
