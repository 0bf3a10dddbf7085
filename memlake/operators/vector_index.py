"""A vector index by coarse cells, and a probe that tells how much of the exact answer it finds.

Centroids are fitted on a bounded sample; every vector is written to the folder of its nearest centroid. A search reads the cells nearest to
the question and no others, applies access inside them before the cut, and can be told to read all, which is the exact form.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.operators.retrieval import cosine, ranked

#: Rows that centroids are fitted on at most, and the most cells.
SAMPLE, CELLS, ROUNDS = 20_000, 512, 12


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(sample: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Spherical k-means; a cell that empties keeps its place. Distances go in slices, so that memory stays small."""
    points = _unit(sample.astype(np.float64))
    centres = points[np.random.default_rng(seed).choice(len(points), min(cells, len(points)), replace=False)]
    for _ in range(ROUNDS):
        near = np.concatenate([np.argmax(points[a : a + 2048] @ centres.T, axis=1) for a in range(0, len(points), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        full = np.linalg.norm(sums, axis=1) > 0
        centres[full] = _unit(sums[full])
    return centres


@dataclass
class VectorIndex:
    """An index that was written to ``path``. ``centres`` is small: at most ``CELLS`` vectors."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    schema: str

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        every = self.spark.read.schema(f"{self.schema}, cell int").parquet(self.path)
        return every if cells is None else every.where(F.col("cell").isin(*cells))

    def nearest(self, probe: list[float], share: float) -> list[int]:
        """The cells nearest to a vector, so many that they are ``share`` of all."""
        scores = self.centres @ _unit(np.asarray([probe], dtype=np.float64))[0]
        return [int(i) for i in np.argsort(-scores)[: max(1, int(np.ceil(share * len(self.centres))))]]

    def search(self, probe: list[float], k: int, share: float = 0.25, allowed: DataFrame | None = None) -> DataFrame:
        """data_id, score, rank of the k nearest rows of the cells read; ``share`` 1 is exact. allowed: data_id, applied before the cut."""
        own = self.rows(None if share >= 1 else self.nearest(probe, share))
        if allowed is not None:
            own = own.join(allowed.select("data_id"), "data_id", "left_semi")
        scored = own.select("data_id", F.round(cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in probe])), 6).alias("score")).where("score is not null")
        return ranked(scored, k, F.desc("score"), F.asc("data_id"))

    def recall(self, probes: DataFrame, k: int = 10, share: float = 0.25) -> DataFrame:
        """probes: probe_id, vector -> probe_id, found, recall: of the k nearest rows of all cells, how many are in the cells that a search would read.

        One pass over the index: each task scores its rows against the probes, a stated and small set, and keeps k for each and cell kind;
        the k of all tasks are ranked for each probe."""
        asked = [(r.probe_id, list(r.vector)) for r in probes.collect()]
        if not asked:
            return self.spark.createDataFrame([], "probe_id long, found long, recall double")
        ids, matrix = np.array([p for p, _ in asked]), _unit(np.array([v for _, v in asked], dtype=np.float64))
        reads = np.zeros((len(asked), len(self.centres)), bool)
        for i, (_, v) in enumerate(asked):
            reads[i, self.nearest(v, share)] = True

        def best(batches):
            for pdf in batches:
                vectors = np.stack(pdf["vector"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, matrix.shape[1]))
                scores = _unit(vectors) @ matrix.T
                for i, p in enumerate(ids):
                    top = np.argsort(-scores[:, i], kind="stable")[:k]
                    yield pd.DataFrame({"probe_id": p, "data_id": pdf["data_id"].to_numpy()[top], "score": np.round(scores[top, i], 6), "read": reads[i, pdf["cell"].to_numpy()[top]]})

        few = self.rows().select("data_id", "vector", "cell").mapInPandas(best, "probe_id long, data_id long, score double, read boolean")
        place = F.row_number().over(Window.partitionBy("probe_id").orderBy(F.desc("score"), "data_id"))
        top = few.withColumn("place", place).where(F.col("place") <= k)
        return top.groupBy("probe_id").agg(F.count_if("read").alias("found"), F.round(F.count_if("read") / F.count("*"), 6).alias("recall"))


def write_index(vectors: DataFrame, path: str) -> VectorIndex:
    """vectors: data_id, vector (one model; null and zero vectors are nobody's neighbours and go) -> the index at ``path``. The number of cells is
    the root of the number of vectors, ``CELLS`` at most."""
    spark = vectors.sparkSession
    own = vectors.select("data_id", "vector").where(F.col("vector").isNotNull() & (F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x).cast("double")) > 0))
    n = own.count()
    picked = own.where(F.shiftrightunsigned(F.xxhash64("data_id", F.lit(5)), 1) <= F.lit(((1 << 63) - 1) * min(n, SAMPLE) // max(n, 1))).select("vector").limit(2 * SAMPLE).toPandas()
    centres = fit(np.stack(picked["vector"].to_numpy()), min(CELLS, max(1, int(n**0.5)))) if len(picked) else np.zeros((1, 1))

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(np.argmax(_unit(np.stack(v.to_numpy()).astype(np.float64)) @ centres.T, axis=1) if len(v) else [], dtype="int32")

    kinds = dict(own.dtypes)
    own.withColumn("cell", cell("vector")).repartition("cell", F.pmod(F.xxhash64("data_id"), F.lit(4))).write.partitionBy("cell").parquet(path)
    return VectorIndex(spark, path, centres, f"data_id {kinds['data_id']}, vector {kinds['vector']}")
