"""Connected components of an undirected graph, and the circles of a directed one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators.written import written


def components(links: DataFrame) -> DataFrame:
    """links: a, b of one type -> id, label for each end, the label being the least id that can be reached.

    A round lets every vertex take the least label around it, then the label of that label, so a chain shortens by half and rounds grow with
    the logarithm of its length. Hot vertices are met by minima before the shuffle; each round is written."""
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a is not null and b is not null").distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("id"), F.least("a", "near").alias("label"))
    while True:
        labels = written(labels)
        around = both.join(labels.toDF("b", "seen"), "b").groupBy("a").agg(F.min("seen").alias("seen")).withColumnRenamed("a", "id")
        lower = labels.join(around, "id").select("id", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jumped = written(lower.join(labels.toDF("label", "further"), "label", "left").select("id", "old", F.least("label", "further").alias("label")))
        labels = jumped.select("id", "label")
        if jumped.where("old <> label").isEmpty():
            return labels


def _least(links: DataFrame, a: str, b: str) -> DataFrame:
    """id, label: for each end of a link the least vertex that leads to it from ``a`` to ``b``, itself included. A round takes the least around and then what
    leads to that one, so rounds are at most the links of the longest way, and far fewer where labels fall along it."""
    labels = written(links.select(F.col(a).alias("id")).union(links.select(b)).distinct().select("id", F.col("id").alias("label")))
    while True:
        around = links.join(labels.toDF(a, "seen"), a).groupBy(b).agg(F.min("seen").alias("seen")).withColumnRenamed(b, "id")
        lower = labels.join(around, "id", "left").select("id", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jumped = written(lower.join(labels.toDF("label", "further"), "label").select("id", "old", F.least("label", "further").alias("label")))
        labels = jumped.select("id", "label")
        if jumped.where("old <> label").isEmpty():
            return labels


def on_circles(links: DataFrame) -> DataFrame:
    """links: a, b of one type -> the links between different vertices that lie on a circle, each once, however long the circle is.

    A link that nothing leads to or that leads nowhere lies on none; such links go first, as long as that halves what is left. Then every vertex
    takes the least one that leads to it, and links between unlike ones go, forwards and backwards in turn until neither drops a link: the
    least vertex of what hangs together then leads to all of it, and all of it leads there. Nothing grows with pairs of vertices."""
    kept = written(links.select("a", "b").where("a <> b").distinct())
    count, halved = kept.count(), True
    while halved and count:
        led, leads = kept.select(F.col("b").alias("a")).distinct(), kept.select(F.col("a").alias("b")).distinct()
        kept = written(kept.join(led, "a", "left_semi").join(leads, "b", "left_semi").select("a", "b"))
        before, count = count, kept.count()
        halved = 2 * count <= before
    way, same = ("a", "b"), 0
    while same < 2 and count:
        labels = _least(kept, *way)
        met = kept.join(labels.toDF("a", "of_a"), "a").join(labels.toDF("b", "of_b"), "b")
        kept = written(met.where("of_a = of_b").select("a", "b"))
        before, count = count, kept.count()
        way, same = way[::-1], same + 1 if count == before else 0
    return kept
