"""The index by cells: exact when it reads all, pruned when it does not, honest about what it misses."""

import numpy as np
from pyspark.sql import functions as F

from memlake.operators.vector_index import write_index
from memlake.operators.written import new_path


def clustered(spark, n=3000, dim=16, groups=40, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    x = centres[r.integers(0, groups, n)] + 0.25 * r.normal(size=(n, dim))
    return x, spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(n, None), (n + 1, [0.0] * dim)], "data_id long, vector array<float>")


def exact(x, probe, k):
    s = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64) @ (probe / np.linalg.norm(probe)), 6)
    return [int(i) for i in np.lexsort([np.arange(len(x)), -s])[:k]]


def test_index(spark):
    x, vectors = clustered(spark)
    x = x.astype(np.float32)
    index = write_index(vectors, new_path(spark, "test-vectors"))
    assert index.rows().count() == 3000 and len(index.centres) == 54
    whole = [r.data_id for r in index.search(x[7].tolist(), 10, 1.0).orderBy("rank").collect()]
    assert whole == exact(x, x[7], 10)
    part = index.search(x[7].tolist(), 10, 0.1)
    assert len({r.data_id for r in part.collect()} & set(whole)) >= 9
    assert "PartitionFilters: [" in part._jdf.queryExecution().executedPlan().toString()
    cells = index.nearest(x[7].tolist(), 0.1)
    assert len(cells) == 6 and index.rows(cells).count() < 1000
    allowed = spark.range(0, 3000, 2).select(F.col("id").alias("data_id"))
    even = [r.data_id for r in index.search(x[7].tolist(), 5, 1.0, allowed).orderBy("rank").collect()]
    assert even == [i for i in exact(x, x[7], 3000) if i % 2 == 0][:5]
    probes = vectors.where("data_id < 60").select(F.col("data_id").alias("probe_id"), "vector")
    told = {r.probe_id: r.recall for r in index.recall(probes, 10, 0.1).collect()}
    assert len(told) == 60 and np.mean(list(told.values())) >= 0.9
    true = np.mean([len({r for r in exact(x, x[i], 10)} & {r.data_id for r in index.search(x[i].tolist(), 10, 0.1).collect()}) / 10 for i in (3, 11)])
    assert abs(true - np.mean([told[3], told[11]])) < 1e-9
    assert {r.recall for r in index.recall(probes, 10, 1.0).collect()} == {1.0}


def test_small_and_empty_indexes(spark):
    empty = write_index(spark.createDataFrame([(1, None)], "data_id long, vector array<float>"), new_path(spark, "test-vectors"))
    assert empty.rows().count() == 0
    one = write_index(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "data_id long, vector array<float>"), new_path(spark, "test-vectors"))
    assert [r.data_id for r in one.search([2.0, 0.0], 5).orderBy("rank").collect()] == [1, 2]
