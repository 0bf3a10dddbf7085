"""Near-duplicate embeddings by an inverted multi-index.

Two codebooks, fitted by k-means on a bounded sample (SAMPLE vectors, or PER_ENTRY for each entry), quantise the halves of each unit vector; their product is
a grid of cells per label, as fine as the largest label needs for cells of about CELL vectors (up to ENTRIES x ENTRIES cells,
enough for 17 billion vectors of a label). Every vector is filed in its own cell and visits cells in multi-sequence order (least sum of the two
half distances first). The number of visits is calibrated on the sample: vectors are perturbed to exactly the threshold and the
smallest count that reaches the target recall from either side is taken. Visitors and residents of a cell meet in blocks of
bounded size and are verified by cosine in double precision. A pair is evaluated once, where its lesser key visits; only link
counts and a spanning forest leave the block, never all pairs. Equal vectors are collapsed first and counted by multiplicity.

Defined results: vectors that are null, zero, empty or hold null or non-finite components, and rows with a null label, link
with nothing (n_links 0, their own component, kept). A null vec_id takes part, but never becomes a component id unless no
linked row has one (component_id null, kept). Vectors of different length never link. Repeated rows count each other as links.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import components, cut
from memlake.llm.vectors import usable

#: Vectors that the codebooks are fitted on at least, and for each of their entries; vectors of a cell; most entries of a codebook.
SAMPLE, PER_ENTRY = 4096, 8
CELL = 256
ENTRIES = 8192
RESIDENTS, VISITORS = 512, 2048


def _unit(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    out /= np.maximum(np.abs(out).max(axis=1, keepdims=True), 1e-300)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _codebook(x: np.ndarray, k: int, rng) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(8):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        for j in range(k):
            if (own := near == j).any():
                c[j] = x[own].mean(0)
    return c


def _half_distances(x: np.ndarray, books) -> list[np.ndarray]:
    h = x.shape[1] // 2
    return [((p * p).sum(1)[:, None] + (b * b).sum(1) - 2 * p @ b.T) for p, b in zip((x[:, :h], x[:, h:]), books, strict=True)]


def multi_sequence(d1: np.ndarray, d2: np.ndarray, visits: int) -> list[int]:
    """The ``visits`` cells (i * k + j) of least d1[i] + d2[j], nearest first."""
    o1, o2, k = d1.argsort(kind="stable"), d2.argsort(kind="stable"), len(d2)
    heap, seen, out = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append(int(o1[i]) * k + int(o2[j]))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < k and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (d1[o1[a]] + d2[o2[b]], a, b))
    return out


def calibrate(x: np.ndarray, books, threshold: float, recall: float, rng) -> int:
    """Visits needed so that a pair at the threshold is met from one side or the other with the target recall."""
    x = x[:512]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    y = threshold * x + np.sqrt(1 - threshold**2) * noise
    (x1, x2), (y1, y2) = _half_distances(x, books), _half_distances(y, books)

    def rank(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Cells nearer than the one that c and d are in."""
        least = np.take_along_axis(a, c.argmin(1)[:, None], 1) + np.take_along_axis(b, d.argmin(1)[:, None], 1)
        return np.array([np.searchsorted(np.sort(y), t - x).sum() for x, y, t in zip(a, b, least, strict=True)])

    met = np.minimum(rank(x1, x2, y1, y2), rank(y1, y2, x1, x2)) + 1
    return int(np.quantile(met, recall, method="higher"))


def _meet(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"key": [], "links": [], "other": []}
        res, vis = pdf[pdf.role == 0], pdf[pdf.role == 1]
        if len(res) and len(vis):
            width, cell = len(res.vec.iloc[0]), res.cell.iloc[0]
            r, v = _unit(res.vec.tolist(), width), _unit(vis.vec.tolist(), width)
            linked = v @ r.T >= threshold
            if linked.any():
                rk, vk = res.key.to_numpy(), vis.key.to_numpy()
                order = {k: i for i, k in enumerate(sorted({*rk, *vk}))}
                ro, vo = np.array([order[k] for k in rk]), np.array([order[k] for k in vk])
                own = vis.own.to_numpy()
                seen = np.stack(res.visits.to_list())
                visited = {c: (seen == c).any(axis=1) for c in set(own)}
                mutual = np.array([visited[c] for c in own])
                linked &= np.where((own == cell)[:, None], vo[:, None] < ro, ~(mutual & (vo[:, None] > ro)))
                rm, vm = res.mult.to_numpy(), vis.mult.to_numpy()
                for keys, sums in ((vk, linked @ rm), (rk, linked.T @ vm)):
                    for i in np.nonzero(sums)[0]:
                        out["key"].append(keys[i]), out["links"].append(int(sums[i])), out["other"].append(None)
                group = np.arange(len(rk))
                for i in np.nonzero(linked.any(axis=1))[0]:
                    met = np.nonzero(linked[i])[0]
                    groups, first = np.unique(group[met], return_index=True)
                    for j in met[first]:
                        out["key"].append(vk[i]), out["links"].append(0), out["other"].append(rk[j])
                    if len(groups) > 1:
                        group[np.isin(group, groups)] = groups[0]
        return pd.DataFrame(out)

    return run


def multi_index_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = 0.99) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    ok = usable("vec") & F.col("label").isNotNull() & F.exists("vec", lambda x: x != 0)
    keyed = cut(base.withColumn("key", F.when(ok, F.unhex(F.md5(F.to_json(F.struct("label", "vec")))))))
    classes = cut(keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("vec").alias("vec"), F.first("label").alias("label")))
    shape = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).agg(F.max("n").alias("n"), F.max("width").alias("width")).first()
    if not shape.n:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rng, width = np.random.default_rng(7), shape.width + shape.width % 2
    k = int(max(2, min(ENTRIES, round((shape.n / CELL) ** 0.5))))
    sample = _unit([x.vec for x in classes.orderBy(F.xxhash64("key")).select("vec").limit(max(SAMPLE, PER_ENTRY * k)).collect()], width)
    books = [_codebook(sample[:, : width // 2], k, rng), _codebook(sample[:, width // 2 :], k, rng)]
    visits = calibrate(sample, books, threshold, recall, rng)

    def file(batches):
        for pdf in batches:
            x = _unit(pdf.vec.tolist(), width)
            d1, d2 = _half_distances(x, books)
            pdf["visits"] = [multi_sequence(a, b, visits) for a, b in zip(d1, d2, strict=True)]
            yield pdf

    kind = dict(classes.dtypes)
    filed = classes.select("key", "mult", "label", "vec").mapInPandas(file, f"key binary, mult long, label {kind['label']}, vec {kind['vec']}, visits array<int>")
    filed = cut(filed.withColumn("dim", F.size("vec")).withColumn("own", F.element_at("visits", 1)))
    at = ["label", "dim", "cell"]
    rows = filed.select("key", "mult", "label", "dim", "own", "vec", "visits", F.explode("visits").alias("cell"))
    cells = cut(
        filed.select("label", "dim", "own", F.explode("visits").alias("cell"))
        .groupBy(*at)
        .agg(F.count_if(F.col("own") == F.col("cell")).alias("res"), F.count("*").alias("vis"))
        .where("res > 0")
        .select(*at, F.ceil(F.col("res") / RESIDENTS).cast("int").alias("rbs"), F.ceil(F.col("vis") / VISITORS).cast("int").alias("vbs"))
    )
    side = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = rows.join(cells, at)
    visiting = met.select(*at, every("rbs").alias("rb"), side("vbs").alias("vb"), F.lit(1).alias("role"), "key", "mult", "own", "vec", F.lit(None).cast("array<int>").alias("visits"))
    living = met.where("own = cell").select(*at, side("rbs").alias("rb"), every("vbs").alias("vb"), F.lit(0).alias("role"), "key", "mult", "own", "vec", "visits")
    found = cut(visiting.union(living).groupBy(*at, "rb", "vb").applyInPandas(_meet(threshold), "key binary, links long, other binary"))
    counts = found.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    labels = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = cut(classes.select("key", "rep", "mult").join(labels.withColumnRenamed("id", "key").withColumnRenamed("label", "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key")))
    least = cut(named.groupBy("comp").agg(F.min("rep").alias("component_id")))
    done = cut(named.join(least, "comp").join(counts, "key", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id"))
    component = F.coalesce("component_id", "vec_id")
    return (
        keyed.select("vec_id", "key")
        .join(done, "key", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
    )
