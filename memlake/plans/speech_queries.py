"""Subtitles parsed into turns, texts cut into windows by a table function, envelopes of windows merged."""

from pyspark.sql import functions as F

from memlake.operators.envelopes import WINDOWS, merged_envelopes, text_windows
from memlake.plans.registry import query, table
from memlake.sources.subtitles import spoken_turns


def _subtitles(spark, sf_dir):
    """Conversations as subtitle files: a cue for each turn, in WebVTT with voices or, for odd ones, with names before a colon."""
    c = table(spark, sf_dir, "conversations")
    flat = F.regexp_replace(F.regexp_replace("text", "[<>]", ""), r"\s+", " ")
    line = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("<v "), "role", F.lit(">"), flat)).otherwise(F.concat("role", F.lit(": "), flat))
    cue = F.concat(F.col("turn").cast("string"), F.lit("\n00:00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(".000 --> 00:00:59.000\r\n"), line)
    files = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("c"))
    return files.select(F.col("conv_id").alias("file_id"), F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("c", lambda x: x["cue"]), "\n\n")).alias("text"))


@query("""WITH l AS (SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(text, '[<>]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM conversations),
n AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS new FROM l WHERE t <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM n)
SELECT conv_id AS file_id, run::BIGINT AS turn, role AS speaker, '00:00:' || lpad((min(turn) % 60)::VARCHAR, 2, '0') || '.000' AS start, count(*)::INT AS lines, string_agg(t, ' ' ORDER BY turn) AS text FROM r GROUP BY conv_id, run, role""")
def subtitle_turns(spark, sf_dir):
    return spoken_turns(_subtitles(spark, sf_dir))


@query("""WITH RECURSIVE w AS (SELECT doc_id AS data_id, text, 0 AS ordinal, 0 AS a, CASE WHEN length(text) <= 2000 THEN length(text) ELSE NULL END AS b FROM documents WHERE length(text) > 0),
ends AS (SELECT data_id, text, ordinal, a, coalesce(b, (SELECT CASE WHEN s.p > 0 THEN s.p ELSE 2000 END FROM (SELECT CASE
    WHEN strpos(reverse(substring(text, 1801, 200)), chr(10) || chr(10)) > 0 THEN 2000 - strpos(reverse(substring(text, 1801, 200)), chr(10) || chr(10)) + 1
    WHEN strpos(reverse(substring(text, 1801, 200)), chr(10)) > 0 THEN 2000 - strpos(reverse(substring(text, 1801, 200)), chr(10)) + 1
    WHEN strpos(reverse(substring(text, 1801, 200)), ' .') > 0 THEN 2000 - strpos(reverse(substring(text, 1801, 200)), ' .') + 1 ELSE 0 END AS p) s)) AS b FROM w)
SELECT data_id, ordinal, a AS span_start, b::INT AS span_end FROM ends WHERE trim(substring(text, 1, b), ' ' || chr(10) || chr(9) || chr(13)) <> ''""")
def first_windows(spark, sf_dir):
    """The first window of every text, as the table function cuts it."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("data_id"), "text")
    return text_windows(d, 2000).where("span_start = 0")


@query(f"""WITH p AS (SELECT conv_id AS data_id, turn AS ordinal, role, text, regexp_extract_all(text, '[A-Za-z]+') AS w FROM conversations WHERE turn < {WINDOWS}),
k AS (SELECT data_id, ordinal, unnest(w[1:3]) AS word, generate_subscripts(w[1:3], 1) AS pos FROM p),
k1 AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY data_id, lower(word) ORDER BY ordinal, pos) = 1),
kk AS (SELECT data_id, array_to_string(list(word ORDER BY ordinal, pos)[1:40], ',') AS keywords FROM k1 GROUP BY 1),
e AS (SELECT data_id, ordinal, w[1] AS name, role AS type FROM p WHERE len(w) > 0 QUALIFY row_number() OVER (PARTITION BY data_id, role, lower(w[1]) ORDER BY ordinal) = 1),
ee AS (SELECT data_id, string_agg(type || ':' || name, ',' ORDER BY ordinal) AS entities FROM e GROUP BY 1),
r AS (SELECT data_id, ordinal, w[1] AS s, w[2] AS o, lower(w[1]) AS ls, lower(w[2]) AS lo, ordinal % 7 AS c FROM p WHERE len(w) > 1),
r1 AS (SELECT *, max(c) OVER (PARTITION BY data_id, ls, lo) AS best FROM r QUALIFY row_number() OVER (PARTITION BY data_id, ls, lo ORDER BY ordinal) = 1),
rr AS (SELECT data_id, string_agg(s || '>' || o || '=' || best, ',' ORDER BY ordinal) AS relations FROM r1 GROUP BY 1)
SELECT p.data_id, min_by(role || ordinal, ordinal) AS title, kk.keywords, ee.entities, rr.relations, count(*) AS windows_read FROM p LEFT JOIN kk USING (data_id) LEFT JOIN ee USING (data_id) LEFT JOIN rr USING (data_id) GROUP BY ALL""")
def envelopes_merged(spark, sf_dir):
    """Conversations as records whose turns are windows: first words as keywords, entities and relations."""
    c = table(spark, sf_dir, "conversations").withColumn("w", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    word = lambda i: F.get("w", F.lit(i))
    none = F.array().cast("array<struct<subject string, predicate string, object string, confidence double>>")
    relation = F.when(F.size("w") > 1, F.array(F.struct(word(0).alias("subject"), F.lit("next").alias("predicate"), word(1).alias("object"), (F.col("turn") % 7).cast("double").alias("confidence")))).otherwise(none)
    entity = F.when(F.size("w") > 0, F.array(F.struct(word(0).alias("name"), F.col("role").alias("type"))))
    parts = c.select(F.col("conv_id").alias("data_id"), F.col("turn").alias("ordinal"), F.concat("role", "turn").alias("title"), F.lit("").alias("summary"), F.slice("w", 1, 3).alias("keywords"), entity.alias("entities"), relation.alias("relations"))
    joined = lambda c, f: F.when(F.col(c).isNotNull() & (F.size(c) > 0), F.array_join(F.transform(c, f), ","))
    return merged_envelopes(parts).select(
        "data_id", "title", joined("keywords", lambda x: x).alias("keywords"), joined("entities", lambda e: F.concat(e["type"], F.lit(":"), e["name"])).alias("entities"),
        joined("relations", lambda r: F.concat(r["subject"], F.lit(">"), r["object"], F.lit("="), r["confidence"].cast("int").cast("string"))).alias("relations"), "windows_read")
