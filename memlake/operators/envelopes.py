"""Long texts read in windows, and what the windows told put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Separators from the best on, most windows of a record, most keywords and longest summary of an envelope.
SEPARATORS, WINDOWS, KEYWORDS, SUMMARY = ("\n\n", "\n", ". "), 24, 40, 12_000


@F.udtf(returnType="ordinal int, span_start int, span_end int")
class TextWindows:
    """A row for each window of a text, one after another, so that no array of a whole text is built. A window ends after the last best separator
    in its final tenth, or at its size; blank windows are left out."""

    def eval(self, text: str, size: int):
        at, ordinal = 0, 0
        while text and at < len(text):
            end = len(text) if size <= 0 else min(at + size, len(text))
            if end < len(text):
                floor = at + int(size * 0.9)
                found = next((c + len(s) for s in SEPARATORS for c in [text.rfind(s, floor, end)] if c > at), None)
                end = found or end
            if text[at:end].strip():
                yield ordinal, at, end
                ordinal += 1
            at = end


def text_windows(texts: DataFrame, size: int) -> DataFrame:
    """texts: data_id, text -> data_id, ordinal, span_start, span_end."""
    return texts.select("data_id", "text").lateralJoin(TextWindows(F.col("text").outer(), F.lit(size))).drop("text")


def merged_envelopes(parts: DataFrame) -> DataFrame:
    """parts: data_id, ordinal, title, summary, keywords (array), entities (array of name, type), relations (array of subject, predicate, object, confidence), a
    row for each window read -> one envelope for each record: title, summary, keywords, entities, relations, windows_read.

    The title is the first window's; the graph is cumulative: an entity counts once by type and name (case aside), as first met, a relation
    once by its ends and predicate at the best confidence that any window gave; keywords once, the first ``KEYWORDS``; summaries one after
    another, cut at ``SUMMARY`` characters with a sign that they were. Nameless entities and relations with an open end go. Windows beyond the
    first ``WINDOWS`` were not to be read and are not."""
    read = parts.where(F.col("ordinal") < WINDOWS)
    once = lambda rows, *key: rows.withColumn("_n", F.row_number().over(Window.partitionBy("data_id", *key).orderBy("ordinal", "pos"))).where("_n = 1")
    gathered = lambda rows, name, *fields: rows.groupBy("data_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "pos", F.struct(*fields).alias("x")))), lambda r: r["x"]).alias(name))
    fold = lambda c: F.lower(F.trim(c))

    e = read.select("data_id", "ordinal", F.posexplode("entities").alias("pos", "e")).select("data_id", "ordinal", "pos", F.trim("e.name").alias("name"), F.coalesce("e.type", F.lit("other")).alias("type")).where("name <> ''")
    e = gathered(once(e.withColumn("_k", fold(F.col("name"))), "type", "_k"), "entities", "name", "type")
    r = read.select("data_id", "ordinal", F.posexplode("relations").alias("pos", "r")).select("data_id", "ordinal", "pos", "r.*")
    r = r.select("*", fold(F.col("subject")).alias("_s"), F.trim("predicate").alias("_p"), fold(F.col("object")).alias("_o")).where("_s <> '' and _p <> '' and _o <> ''")
    best = r.groupBy("data_id", "_s", "_p", "_o").agg(F.max("confidence").alias("best"))
    r = gathered(once(r, "_s", "_p", "_o").join(best, ["data_id", "_s", "_p", "_o"]), "relations", "subject", "predicate", "object", F.col("best").alias("confidence"))
    k = read.select("data_id", "ordinal", F.posexplode("keywords").alias("pos", "word")).where("word <> ''")
    k = gathered(once(k.withColumn("_k", fold(F.col("word"))), "_k"), "keywords", "word")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.trim("summary") != "", F.struct("ordinal", F.trim("summary").alias("s"))))), lambda x: x["s"]), "\n\n")
    own = read.groupBy("data_id").agg(F.min_by("title", "ordinal").alias("title"), said.alias("s"), F.count("*").alias("windows_read"))
    summary = F.when(F.length("s") > SUMMARY, F.concat(F.rtrim(F.substring("s", 1, SUMMARY)), F.lit("…"))).otherwise(F.col("s"))
    out = own.select("data_id", "title", summary.alias("summary"), "windows_read").join(k, "data_id", "left").join(e, "data_id", "left").join(r, "data_id", "left")
    return out.select("data_id", "title", "summary", F.slice(F.transform(F.coalesce("keywords", F.array().cast("array<struct<word:string>>")), lambda x: x["word"]), 1, KEYWORDS).alias("keywords"), "entities", "relations", "windows_read")
