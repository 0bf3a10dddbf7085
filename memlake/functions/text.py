"""Text conditions and heuristics as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.operators.written import dealt


def stem(word: Column) -> Column:
    """Plural and verb endings dropped: a short approximation of an English dictionary."""
    w = F.regexp_replace(word, "(?<=[a-z]{3})(?:ies)$", "y")
    w = F.regexp_replace(w, "(?<=[a-z]{3})(?:ing|ed)$", "")
    return F.regexp_replace(w, "(?<=[a-z]{2}[a-rt-z])s$", "")


def stemmed_words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), stem)


def matches(text: Column, all_of: tuple[str, ...] = (), any_of: tuple[str, ...] = (), none_of: tuple[str, ...] = (), phrases: tuple[str, ...] = ()) -> Column:
    """A search condition on stemmed words: all of these, one of those, none of these, and phrases whose words stand together."""
    words = stemmed_words(text)
    said = lambda many: F.array(*[stem(F.lit(w.lower())) for w in many])
    test = F.lit(True)
    if all_of:
        test &= F.size(F.array_except(said(all_of), words)) == 0
    if any_of:
        test &= F.arrays_overlap(words, said(any_of))
    if none_of:
        test &= ~F.arrays_overlap(words, said(none_of))
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    for p in phrases:
        test &= F.contains(joined, F.concat(F.lit(" "), F.array_join(said(tuple(p.split())), " "), F.lit(" ")))
    return F.coalesce(test, F.lit(False))


def cited(answer: Column, n_passages: Column) -> Column:
    """The distinct markers [n] of an answer that name one of its passages, in ascending order."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,6})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.between(1, n_passages))))


def keywords(records: DataFrame, stop: tuple[str, ...], top: int = 8) -> DataFrame:
    """data_id, text -> data_id, rank, word, n: a record's most frequent words of more than 3 letters; of equal counts the one met first. Whole texts
    are shuffled, compressed, and never their words."""
    at = dealt(records.select("data_id", "text"), ["data_id"], 2048).select("data_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("at", "word"))
    counted = at.where((F.length("word") > 3) & ~F.col("word").isin(*stop)).groupBy("data_id", "word").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "first", "word")))
    best = counted.groupBy("data_id").agg(F.slice(ordered, 1, top).alias("best"))
    return best.select("data_id", F.posexplode("best").alias("rank", "b")).select("data_id", (F.col("rank") + 1).alias("rank"), F.col("b.word").alias("word"), (-F.col("b.less")).alias("n"))


_SOFT = re.compile(r"\n\n|\n|\. ")


def window_spans(text: Column, size: int) -> Column:
    """Spans of at most ``size`` characters that cover a text; each ends at the last break in its final tenth, if there is one."""

    @F.pandas_udf("array<struct<start int, end int>>")
    def split(texts: pd.Series) -> pd.Series:
        def one(t):
            out, at = [], 0
            while t and at < len(t):
                end = min(at + size, len(t))
                if end < len(t):
                    ends = [m.end() for m in _SOFT.finditer(t, end - size // 10, end)]
                    end = ends[-1] if ends else end
                out.append({"start": at, "end": end})
                at = end
            return out

        return texts.map(one)

    return split(text)
