"""Subtitles (WebVTT, SRT) as turns of speech, by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _speech(line: Column) -> Column:
    """(speaker, text) of a line: ``<v Name>text``, or ``Name: text`` where the name has one to three words, 48 characters at most and no mark at its end, as a longer
    one is half a sentence more often than a name; else unattributed. Tags go."""
    plain = lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))
    voice, rest = F.regexp_extract(line, "^<v ([^>]*)>", 1), F.regexp_replace(line, "^<v [^>]*>", "")
    head = F.regexp_extract(line, "^([^:]*):", 1)
    label = line.contains(":") & F.trim(head).rlike(r"^\S+(?:\s+\S+){0,2}$") & (F.length(head) <= 48) & ~head.rlike(r"[.?!,]$")
    by_voice = line.rlike("^<v [^>]*>")
    speaker = F.when(by_voice, F.trim(voice)).when(label, F.trim(head))
    said = F.when(by_voice, plain(rest)).when(label, plain(F.regexp_replace(line, "^[^:]*:", ""))).otherwise(plain(line))
    return F.struct(F.nullif(speaker, F.lit("")).alias("speaker"), said.alias("text"))


def speech_lines(files: DataFrame) -> DataFrame:
    """files: file_id, text -> file_id, at, cue, start, speaker, text: the spoken lines of each file in order, with the number and the start of
    their cue. Timing lines, cue numbers, headers, notes, styles and regions are structure; lines without words go; a null text has none."""
    lines = files.select("file_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")).alias("at", "raw")).select("file_id", "at", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")).alias("line"))
    timing = F.col("line").contains("-->")
    so_far = Window.partitionBy("file_id").orderBy("at")
    timed = lines.withColumn("cue", F.count_if(timing).over(so_far)).withColumn("start", F.last(F.when(timing, F.trim(F.split("line", "-->")[0])), ignorenulls=True).over(so_far))
    structure = timing | (F.col("line") == "") | (F.col("line") == "WEBVTT") | F.col("line").rlike(r"^(?:NOTE |STYLE|REGION)") | F.col("line").rlike(r"^\d+$")
    spoken = timed.where(~structure).withColumn("s", _speech(F.col("line")))
    return spoken.select("file_id", "at", "cue", "start", "s.speaker", "s.text").where("text <> ''")


def spoken_turns(files: DataFrame) -> DataFrame:
    """file_id, turn, speaker, start, lines, text: consecutive lines of one speaker, cues or not, are one thing said."""
    run = Window.partitionBy("file_id").orderBy("at")
    first = F.row_number().over(run) == 1
    new = first | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(run))
    numbered = speech_lines(files).withColumn("new", new).withColumn("turn", F.count_if("new").over(run))
    parts = F.array_sort(F.collect_list(F.struct("at", "text", "start")))
    g = numbered.groupBy("file_id", "turn", "speaker").agg(parts.alias("p"))
    return g.select("file_id", "turn", "speaker", F.col("p")[0]["start"].alias("start"), F.size("p").alias("lines"), F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def transcripts(files: DataFrame) -> DataFrame:
    """One row a file: file_id, text (turns with their speaker, parted by a blank line), turns, speakers in order of appearance, warning where none is named."""
    turns = spoken_turns(files)
    parts = F.array_sort(F.collect_list(F.struct("turn", "speaker", "text")))
    g = turns.groupBy("file_id").agg(parts.alias("p"))
    said = F.transform("p", lambda x: F.concat(F.when(x["speaker"].isNull(), "").otherwise(F.concat(x["speaker"], F.lit(": "))), x["text"]))
    speakers = F.array_distinct(F.filter(F.transform("p", lambda x: x["speaker"]), lambda s: s.isNotNull()))
    return g.select("file_id", F.array_join(said, "\n\n").alias("text"), F.size("p").alias("turns"), speakers.alias("speakers"), F.when(F.size(speakers) == 0, "no speaker attribution found").alias("warning"))
