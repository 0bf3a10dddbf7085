"""Shared pieces of the corpus operators: scratch tables, text folding, graph components."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir. Where that is unset, a local folder in local mode (tests), else
    an error, as executors could not see one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="memlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a scratch table; one that cannot be removed is only reported."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Py4JError as e:
        warnings.warn(f"{path} is left behind: {e}", stacklevel=2)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut`` writes inside are deleted at the end; nothing that reads them may be used after it."""
    token = _WRITTEN.set([])
    try:
        yield
    finally:
        for path in _WRITTEN.get():
            delete(spark, path)
        _WRITTEN.reset(token)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def packed(docs: DataFrame, **added: Column) -> DataFrame:
    """``docs`` as one struct column ``doc`` beside the ``added`` columns, so that no name can clash; ``unpacked`` undoes it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[v.alias(k) for k, v in added.items()])


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    return rows.select(*[changed.get(c, F.col("doc").getField(c)).alias(c) for c in columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sampled(key: list[str], sample: int, rows: int, seed: int = 9) -> Column:
    """Condition that about ``sample`` of ``rows`` rows meet, chosen by 63 bits of a hash of ``key``: the same rows however they are partitioned."""
    most = (1 << 63) - 1
    cutoff = most if rows <= sample else max(1, most * sample // rows)
    return F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 1) <= F.lit(cutoff)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def fold_bucket(col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; rows with bucket 0 are held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % 5


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): one row (id, label) per vertex, label the least id reachable.

    Every round takes the least label among neighbours and then follows that label once (pointer jumping), so the number of
    rounds is logarithmic in the length of chains. Each round is one job over the edges, cut in the shared folder. Hot vertices
    are met by map-side minima and by plain joins that adaptive execution can split. No edges: no rows.
    """
    sym = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(sym.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    while True:
        near = sym.join(labels.select(F.col("id").alias("b"), F.col("label").alias("nl")), "b").groupBy("a").agg(F.min("nl").alias("nl"))
        least = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("label").alias("old"), F.least("label", "nl").alias("label"))
        hop = labels.select(F.col("id").alias("label"), F.col("label").alias("jump"))
        new = cut(least.join(hop, "label", "left").select("id", "old", F.least("label", "jump").alias("label")))
        changed = not new.where("label <> old").isEmpty()
        labels = new.select("id", "label")
        if not changed:
            return labels
