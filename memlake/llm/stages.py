"""The stages of the corpus pipeline: drop toxic documents, keep one of each near-duplicate group, redact personal data, mix
sources to target weights, pack into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents; extra columns pass through whatever their names, as the stages
carry the documents in one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.best_fit import best_fit
from memlake.llm.chosen_path import chosen_path_join
from memlake.llm.common import cut, delete, packed, scratch, scratch_path, unpacked
from memlake.llm.mixing import mixed
from memlake.llm.pii_labelers import candidates, fit, redact, with_spans
from memlake.llm.toxicity_fm import learn, scorer

#: Target weights by language; sources of a language weigh the same.
WEIGHTS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}
EPOCHS = 2
#: Documents are near duplicates from this percentage of common 5-word shingles on.
SIMILAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not predict toxic. The machine is learnt from the labels of ``sf_dir``. Null and
    empty texts have no features and stay unless most labels are toxic; of repeated rows all stay or all go."""
    own = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    score = scorer(learn(own, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rows = packed(docs, score=score(F.col("text").cast("string")))
    return unpacked(rows.where("score < 0.5"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the least id, one with a null id only where no other row has an id. Every
    row takes part by a key of its own, so rows that share an id but not their text are told apart. Rows without words (null
    texts too) have no near duplicates; of those, repeated rows with an id stay once."""
    rows = cut(packed(docs, row=F.monotonically_increasing_id()))
    own = rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))
    found = chosen_path_join(own, id_col="row", percent=SIMILAR).select(F.col("doc_id").alias("row"), "component_id", (F.col("n_shingles") == 0).alias("blank"))
    keys = cut(own.select("row", "doc_id", F.xxhash64("text").alias("text")).join(found, "row"))
    repeated = F.col("blank") & F.col("doc_id").isNotNull()
    group = [F.when(~repeated, F.col("component_id")).alias("g"), F.when(repeated, F.col("doc_id")).alias("i"), F.when(repeated, F.col("text")).alias("t")]
    kept = keys.groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row")).select("row")
    dropped = cut(keys.select("row").join(kept, "row", "left_anti"))
    return unpacked(rows.join(dropped, "row", "left_anti"), docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each span of personal data replaced by its kind in brackets and n_chars counted anew where it changed.
    Null and empty texts stay as they are, repeated rows each stay."""
    rows = cut(packed(docs, candidates=candidates(F.col("text"))))
    rows = with_spans(rows, fit(rows)).select("doc", "spans", F.col("doc.text").cast("string").alias("text"))
    hit = F.size("spans") > 0
    text = F.when(hit, redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    changed = rows.select("doc", hit.alias("hit"), text.alias("text"))
    return unpacked(changed, docs.columns, text=F.col("text"), n_chars=F.when(F.col("hit"), F.length("text").cast("long")).otherwise(F.col("doc.n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target proportions of languages and sources, as many tokens as there are; a document is repeated for
    each epoch that it is selected in, and the one at which a source's budget ends is kept whole. Rows that share an id, and
    nameless rows of one language, source and text, go together; null levels are a level; texts without tokens are never selected."""
    return mixed(docs, ["lang", "source"], WEIGHTS, 1.0, EPOCHS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of permitted lengths. Texts without tokens have none, repeated rows each have one."""
    return best_fit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another. Once a stage's rows are written, its inner tables and the stage before it are deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
