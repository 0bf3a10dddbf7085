"""Exact top-k inner product search over an impact-ordered index, score at a time.

Components become integers floor(1024 x). Vectors are dealt into blocks of about CELLS components; a block's index, built and written
once, holds per dimension posting segments by quantised value with each segment's extreme values. For a query the impact of a
segment is the greatest product it can give, above the least of its dimension, quantised upwards to eight bits. Many
queries go through a block together, each with its own descending order of impacts: a round processes all segments down to a
level of impact, adding their impacts to small integer accumulators, and what is still to come is bounded, per dimension, by the next
impact. Rows whose accumulator plus that bound is below the query's k-th score so far are proven out. Rounds that could prove
out little are joined with the next one; once few rows are left, or at the end of the postings, those are rescored exactly. A
query's k-th score starts from an exact pass over SEED rows of its task and rises from block to block; only k rows per query and
task leave it.

Queries are the rows whose id is divisible by ``every``. Defined results: null ids, null or empty vectors and vectors with null
or non-finite components take no part; vectors of different length are not compared; rows that repeat the query's id are its
own, and of several vectors under a query's id the least one asks; repeated candidates each take a rank; ties go to the smaller id.
Results are exact while scores stay below 2^53.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import cut
from memlake.llm.vectors import usable

#: Components of a block, blocks of a task, queries of a task.
CELLS, BLOCKS, QUERIES = 262_144, 4, 1024
LEVELS = 32
SEED = 256
#: Levels of impact (of 255) at which rows may be proven out, and the share of rows that must be expected to go.
STOPS, WORTH = (160, 96, 48), 0.5
FEW = 1 / 16
PAIRS = 32_768
#: Steps that rounding may lose in a dimension.
SLACK = 1e-3


def integers(rows, width: int) -> np.ndarray:
    x = np.floor(1024.0 * np.array([np.asarray(r, dtype=np.float64) for r in rows]).reshape(len(rows), width))
    return np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def build(pdf: pd.DataFrame) -> pd.DataFrame:
    """The index of one block: rows as they are, their segment in each dimension, the segments' least and greatest values."""
    pdf = pdf.sort_values("vec_id", kind="stable")
    dim = int(pdf.dim.iloc[0])
    x = integers(pdf.vec, dim)
    low = x.min(axis=0).astype(np.float64)
    width = np.maximum(x.max(axis=0) - low, 1.0)
    seg = np.minimum((x - low) / width * LEVELS, LEVELS - 1).astype(np.uint8)
    lo, hi = np.full((dim, LEVELS), np.iinfo(np.int64).max), np.full((dim, LEVELS), np.iinfo(np.int64).min)
    at = (np.broadcast_to(np.arange(dim), x.shape), seg)
    np.minimum.at(lo, at, x)
    np.maximum.at(hi, at, x)
    small = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max)
    return pd.DataFrame({"dim": [dim], "vb": [pdf.vb.iloc[0]], "kind": [np.dtype(small).str], "ids": [pdf.vec_id.to_numpy()], "mult": [pdf.mult.to_numpy()], "x": [x.astype(small).tobytes()], "seg": [seg.tobytes()], "lo": [lo.tobytes()], "hi": [hi.tobytes()]})


INDEX = "dim int, vb long, kind string, ids array<long>, mult array<long>, x binary, seg binary, lo binary, hi binary"


class Best:
    """The k best of each query so far: flat arrays of query number, score, id."""

    def __init__(self, n: int, k: int):
        self.k, self.q, self.score, self.id = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.kth = np.full(n, -np.inf)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = np.concatenate((self.q, q)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        by = np.lexsort((ids, -score, q))
        q, score, ids = q[by], score[by], ids[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.q, self.score, self.id = q[keep], score[keep], ids[keep]
        last = place == self.k - 1
        self.kth[q[last]] = np.maximum(self.kth[q[last]], score[last])


def impacts(lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised impacts of all segments for each query (dim x level x query, 0 to 255), and per query the score that an accumulator of 0
    stands for and the size of a step: the score is at most base + step * (accumulated impacts + SLACK for each dimension).
    Segments without rows have impact 0."""
    none = lo > hi
    least, most = np.where(none, np.inf, hi).min(axis=1), np.where(none, -np.inf, lo).max(axis=1)
    up, down = np.where(none, 0.0, hi - least[:, None]), np.where(none, 0.0, most[:, None] - lo)
    qf = q.T.astype(np.float64)
    base = np.where(qf > 0, qf * least[:, None], qf * most[:, None]).sum(axis=0)
    pos, neg = np.maximum(qf, 0), np.maximum(-qf, 0)
    step = np.maximum(pos * up.max(axis=1)[:, None], neg * down.max(axis=1)[:, None]).max(axis=0) / 254
    step[step == 0] = 1.0
    impact = up.astype(np.float32)[:, :, None] * (pos / step).astype(np.float32)[:, None, :]
    impact += down.astype(np.float32)[:, :, None] * (neg / step).astype(np.float32)[:, None, :]
    level = impact.astype(np.uint8)
    level += impact > 0
    return level, base, step


def _bounds(level: np.ndarray, stop: int) -> np.ndarray:
    """What a row can have from each segment, once all impacts from ``stop`` on are processed."""
    following = np.where(level < stop, level, 0).max(axis=1)
    return np.where(level >= stop, level, following[:, None, :]).astype(np.float32)


def search(x: np.ndarray, ids: np.ndarray, mult: np.ndarray, seg: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: np.ndarray, own: np.ndarray, best: Best) -> None:
    """One block for a chunk of queries."""
    rows, dim = seg.shape
    held = np.bincount((seg + np.arange(dim) * LEVELS).ravel(), minlength=dim * LEVELS).reshape(dim, LEVELS) / rows
    columns = np.ascontiguousarray(seg.T)
    chunk = max(1, min(512, (1 << 22) // (dim * LEVELS)))
    for a in range(0, len(q), chunk):
        level, base, step = impacts(lo, hi, q[a : a + chunk])
        kth = best.kth[a : a + chunk]
        need = (kth - base) / step
        need = np.where(np.isfinite(need), np.floor(need - dim * SLACK - 1e-9 * (np.abs(kth) + np.abs(base)) / step), -1)
        possible = level.max(axis=1).sum(axis=0, dtype=np.int64) >= need
        if not possible.any():
            continue
        pairs = None
        for stop in (*STOPS, 0):
            bound = level
            if stop:
                some = _bounds(level[:, :, ::16], stop)
                mean = np.einsum("dl,dlq->dq", held, some)
                spread = np.sqrt(np.maximum(np.einsum("dl,dlq->dq", held, some**2) - mean**2, 0).sum(axis=0))
                if np.mean(need[::16] <= mean.sum(axis=0)) > WORTH or np.mean(need[::16] <= mean.sum(axis=0) + spread) > WORTH:
                    continue
                bound = _bounds(level, stop).astype(np.uint8)
            acc = np.zeros((rows, bound.shape[2]), np.uint16 if dim <= 257 else np.uint32)
            for d in range(dim):
                acc += bound[d].take(columns[d], axis=0)
            alive = acc >= np.clip(need, 0, np.iinfo(acc.dtype).max).astype(acc.dtype)
            alive &= (need <= np.iinfo(acc.dtype).max) & possible
            pairs = np.nonzero(alive)
            if len(pairs[0]) <= FEW * alive.size:
                break
        for b in range(0, len(pairs[0]), PAIRS):
            r, j = pairs[0][b : b + PAIRS], pairs[1][b : b + PAIRS] + a
            other = ids[r] != own[j]
            r, j = r[other], j[other]
            score = np.einsum("pd,pd->p", x[r].astype(np.int64), q[j])
            worth = score >= best.kth[j]
            r, j, score = r[worth], j[worth], score[worth]
            times = np.minimum(mult[r], best.k)
            best.add(np.repeat(j, times), np.repeat(score, times), np.repeat(ids[r], times))


def _search(k: int):
    def run(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        asked = asked.sort_values("vec_id")
        own, dim = asked.vec_id.to_numpy(), int(asked.dim.iloc[0])
        q, best = integers(asked.vec, dim), Best(len(asked), k)
        for n, b in enumerate(index.sort_values("vb").itertuples()):
            x, ids = np.frombuffer(b.x, b.kind).reshape(-1, dim), np.asarray(b.ids)
            if n == 0 and len(ids) > k:
                score = (x[:SEED].astype(np.int64) @ q.T).astype(np.float64)
                score[ids[:SEED, None] == own] = -np.inf
                if len(score) >= k:
                    best.kth = np.partition(score, len(score) - k, axis=0)[len(score) - k]
            seg, lo, hi = (np.frombuffer(v, t).reshape(-1, w) for v, t, w in ((b.seg, np.uint8, dim), (b.lo, np.int64, LEVELS), (b.hi, np.int64, LEVELS)))
            search(x, ids, np.asarray(b.mult), seg, lo, hi, q, own, best)
        return pd.DataFrame({"query_id": own[best.q], "vec_id": best.id, "score": best.score})

    return run


def impact_topk(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k highest integer inner products."""
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    base = base.where(usable("vec") & F.col("vec_id").isNotNull())
    n, nq = base.select(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    qbs = max(1, -(-nq // QUERIES))
    dealt = base.groupBy("vec_id", "vec").agg(F.count("*").alias("mult")).withColumn("dim", F.size("vec"))
    dealt = dealt.withColumn("vb", F.pmod(F.xxhash64("vec_id", "vec"), F.ceil(F.col("dim") * F.lit(n) / CELLS)))
    index = cut(dealt.groupBy("dim", "vb").applyInPandas(build, INDEX)).withColumn("vg", F.floor(F.col("vb") / BLOCKS))
    queries = base.where(F.col("vec_id") % every == 0).groupBy("vec_id", F.size("vec").alias("dim")).agg(F.min("vec").alias("vec"))
    asked = cut(queries.groupBy("vec_id").agg(F.min(F.struct("vec", "dim")).alias("q")).select("vec_id", "q.vec", "q.dim"))
    groups = index.select(F.col("dim").alias("dim"), F.col("vg").alias("vg")).distinct()
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(qbs))).join(groups, "dim")
    rows = index.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qbs - 1).cast("long"))))
    at = ["dim", "vg", "qb"]
    met = rows.groupBy(*at).cogroup(asked.groupBy(*at)).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
