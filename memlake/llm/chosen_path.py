"""Near-duplicate documents by a chosen-path set similarity join.

Each document becomes the set of its 5-word shingles. Documents with equal sets form one class; the join runs over classes.
Independent trees branch the classes by selected minwise tokens: a first token per tree, then two more, then four more at each
level, chosen by a hash of the path so far. Nodes with few members are compared exhaustively, from the third level on nodes of up to
BLOCKED members in blocks; larger ones are branched until they are small (a node still larger after seven levels, whose members share 23
tokens, is compared in blocks too). Every member of a larger node is compared with a
few pivots; a node most of whose members are like a pivot is a group of copies, which branching would not divide, and is
kept for the second round; other large nodes are branched further. A 256-bit sketch drops pairs that are far below the threshold and
every remaining pair is confirmed on the full sets. Members already connected are not compared again: a second round
confirms only pairs whose ends are still in different components. For large nodes these are the pairs of members outside the main
component with every other member; they meet in blocks of bounded size, from which only a spanning forest of the links leaves, so
that no link is lost to the size of a node (only to the sketch, see recall) and no list of its pairs is made.

Recall: a pair at similarity s survives one tree's first three levels with probability about s * (1-(1-s^2)^3) * (1-(1-s^4)^4);
were the trees independent, eight would miss about 1 pair in 200,000 at 0.85 and 1 in 7,000 at 0.8. They share the DEEP tokens of the
lower levels, so the README gives the recall as measured. The sketch is the same for all trees and blocks: it drops at most 1
pair in 10 million at the threshold, fewer above it.

Defined results: null or blank text has an empty set, n_shingles 0, and is linked with nothing; a null doc_id takes part
through its text but never becomes a component id (it gets the component of its text, null if no other row has that text) and
is kept only if that is null; repeated rows share one component; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import components, cut

TREES = 8
DEEP = 56
COORDS = 64
SMALL_NODE = 32
#: Rows and shingles of a block, as large groups are compared.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: (tokens chosen, branches) of the levels below the first.
LEVELS = ((2, 3), (4, 4), (4, 6), (4, 6), (4, 6), (4, 6))
#: From this level on nodes up to this size are small enough for the exhaustive comparison in blocks.
BLOCKED_FROM, BLOCKED = 2, 1024
#: Chance that the sketch drops a pair at the threshold.
SKETCH_LOSS = 1e-7

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, COORDS, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all input bits reach all output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, width: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; a shorter text is one shingle; empty for no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _BASE + w[i : len(w) - k + 1 + i]
    return np.unique(_mix(h))


def _minima(s: np.ndarray) -> np.ndarray:
    out = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        out = np.minimum(out, (s[i : i + 4096, None] * _MUL + _ADD).min(axis=0))
    return _mix(out)


def _signatures(width: int, key: str, text: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _WordHashes()
        for pdf in batches:
            n, cid, tops, deep, sketch = [], [], [], [], []
            for t in pdf[text]:
                s = shingle_set(t, width, memo)
                n.append(len(s))
                if not len(s):
                    cid.append(None), tops.append(None), deep.append(None), sketch.append((None,) * 4)
                    continue
                m = _minima(s)
                cid.append(hashlib.md5(s.tobytes()).digest())
                tops.append(m[:TREES].view(np.int64))
                deep.append((m[TREES : TREES + DEEP] >> np.uint64(33)).astype(np.int32))
                nibbles = (m >> np.uint64(7)) & np.uint64(15)
                four = (nibbles.reshape(4, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)
                sketch.append(four.view(np.int64))
            sk = pd.DataFrame(sketch, columns=["s0", "s1", "s2", "s3"], dtype="Int64", index=range(len(pdf)))
            yield pd.DataFrame({"doc_id": pdf[key].to_numpy(), "n": n, "cid": cid, "tops": tops, "deep": deep} | {c: sk[c] for c in sk})

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _WordHashes()
        for pdf in batches:
            sets = [shingle_set(t, width, memo) for t in pdf["text"]]
            yield pd.DataFrame({"cid": [hashlib.md5(s.tobytes()).digest() for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    return run


def sketch_diff(percent: int) -> int:
    """How many of the 256 sketch bits may differ so that at most SKETCH_LOSS of the pairs at the threshold are dropped. A minwise token
    differs with chance 1 - s, then each of its four bits with chance half."""
    apart = 1 - percent / 100
    bits, one = np.ones(1), np.array([1 - apart, 0, 0, 0, 0]) + apart * np.array([1, 4, 6, 4, 1]) / 16
    for _ in range(COORDS):
        bits = np.convolve(bits, one)
    more = bits[::-1].cumsum()[::-1]
    return int((more > SKETCH_LOSS).sum()) - 1


def _near(a: str, b: str, percent: int):
    """The cheap tests of a pair: the sizes allow the similarity and the sketches are close."""
    diff = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(4)), F.lit(0))
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (diff <= sketch_diff(percent))


CARRIED = ("cid", "n", "s0", "s1", "s2", "s3")


def _block_links(percent: int):
    most = sketch_diff(percent)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links that join components, among the visitors and residents of two blocks."""
        out: list[tuple[bytes, bytes]] = []
        x, y = pdf[pdf.visitor].reset_index(drop=True), pdf[~pdf.visitor].reset_index(drop=True)
        if len(x) and len(y):
            known, flat = np.unique(np.concatenate(list(y.shingles)), return_inverse=True)
            mark = np.zeros(len(known), np.int32)
            ny = y.shingles.map(len).to_numpy()
            starts = ny.cumsum() - ny
            part = pd.factorize(pd.concat([x.label, y.label], ignore_index=True))[0]
            rank = np.unique(np.array([*x.cid, *y.cid], object), return_inverse=True)[1]
            part_y, rank_y, sketch_y, outside = part[len(x) :], rank[len(x) :], y[list(CARRIED[2:])].to_numpy(np.int64).view(np.uint64), y.outside.to_numpy(bool)
            node, met = pdf.node.iloc[0], {}
            for j, nodes in enumerate(y.nodes):
                for h in nodes:
                    met.setdefault(h, []).append(j)
            sketch_x = x[list(CARRIED[2:])].to_numpy(np.int64).view(np.uint64)
            for i, shingles in enumerate(x.shingles):
                n = len(shingles)
                able = (part_y != part[i]) & (np.minimum(ny, n) * 100 >= np.maximum(ny, n) * percent) & ~(outside & (rank_y <= rank[i]))
                able &= np.bitwise_count(sketch_y ^ sketch_x[i]).sum(axis=1) <= most
                for h in x.nodes[i]:
                    if h < node:
                        able[met.get(h, [])] = False
                able = np.flatnonzero(able)
                if not len(able):
                    continue
                at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
                at = at[known[at] == shingles]
                mark[at] = 1
                common = np.add.reduceat(mark[flat], starts)[able] if len(able) * 4 > len(y) else np.array([mark[flat[starts[j] : starts[j] + ny[j]]].sum() for j in able])
                mark[at] = 0
                for j in able[common * 100 >= (n + ny[able] - common) * percent]:
                    if part_y[j] != part[i]:
                        out.append(tuple(sorted((x.cid[i], y.cid[j]))))
                        part[part == part_y[j]] = part[i]
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def block_links(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components, among ``held`` (node, label, outside, CARRIED): each member outside its node's main
    component is compared with every other member. Members are dealt by a hash into blocks of about BLOCK rows or
    BLOCK_SHINGLES shingles; visitors and residents of two blocks meet in one task, and at most a spanning forest leaves it. A pair that
    shares several nodes is compared in the least of them."""
    blocks = lambda rows, n: F.greatest(F.lit(1), F.ceil(F.greatest(rows / BLOCK, n / BLOCK_SHINGLES))).cast("int")
    away = lambda c: F.sum(F.when(F.col("outside"), c).otherwise(0))
    sizes = held.groupBy("node").agg(blocks(F.count("*"), F.sum("n")).alias("ys"), away(F.lit(1)).alias("away"), blocks(away(F.lit(1)), away(F.col("n"))).alias("xs")).where("away > 0").drop("away")
    nodes = held.groupBy("cid").agg(F.collect_set("node").alias("nodes"))
    rows = cut(held.join(cut(sizes), "node").join(nodes, "cid").join(sets, "cid"))
    block = lambda n: F.pmod(F.xxhash64("cid", F.lit(7)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    carried = ["node", "label", "outside", "nodes", "shingles", *CARRIED]
    visitors = rows.where("outside").select(*carried, F.lit(True).alias("visitor"), block("xs").alias("x"), every("ys").alias("y"))
    residents = rows.select(*carried, F.lit(False).alias("visitor"), every("xs").alias("x"), block("ys").alias("y"))
    return visitors.union(residents).groupBy("node", "x", "y").applyInPandas(_block_links(percent), "a binary, b binary").distinct()


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def chosen_path_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Links are pairs with 100*|A and B| >= percent*|A or B|."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(base.mapInPandas(_signatures(width, "doc_id", "text"), "doc_id long, n int, cid binary, tops array<long>, deep array<int>, s0 long, s1 long, s2 long, s3 long"))
    classes = cut(
        signed.where("cid is not null")
        .groupBy("cid")
        .agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "tops", "deep", "s0", "s1", "s2", "s3")])
    )
    rows = classes.select(*CARRIED, F.posexplode("tops").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), *CARRIED)
    small, stars, held = [], [], []
    for level in range(len(LEVELS) + 1):
        rows = cut(rows) if level else rows
        sizes = cut(rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"))
        rows = cut(rows.join(sizes, "node"))
        few = rows.where(F.col("size") <= SMALL_NODE)
        small.append(few.alias("x").join(few.alias("y"), (F.col("x.node") == F.col("y.node")) & (F.col("x.cid") < F.col("y.cid")) & _near("x", "y", percent)).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")))
        rest = rows.where(F.col("size") > SMALL_NODE).drop("size")
        if rest.isEmpty():
            break
        pivots = cut(rest.groupBy("node").agg(*[F.min(F.struct(F.xxhash64("cid", F.lit(p)).alias("o"), *CARRIED)).alias(f"p{p}") for p in range(3)]))
        with_pivots = rest.join(pivots, "node").select("node", F.struct(*CARRIED).alias("x"), "p0", "p1", "p2")
        near = cut(with_pivots.select("node", "x", *[F.when(_near("x", f"p{p}", percent), F.col(f"p{p}.cid")).alias(f"c{p}") for p in range(3)]))
        for p in range(3):
            stars.append(near.where(F.col("x.cid") != F.col(f"c{p}")).select(*_ordered(F.col("x.cid"), F.col(f"c{p}"))))
        alike = near.groupBy("node").agg(F.avg(F.coalesce("c0", "c1", "c2").isNotNull().cast("int")).alias("share"))
        rest = cut(rest.join(cut(alike), "node"))
        held.append(rest.where("share >= 0.5").drop("share"))
        rest = rest.where("share < 0.5").drop("share")
        if level >= BLOCKED_FROM:
            sized = cut(rest.join(sizes, "node"))
            held.append(sized.where((F.col("size") <= BLOCKED) | F.lit(level == len(LEVELS))).drop("size"))
            rest = sized.where(F.col("size") > BLOCKED).drop("size")
        if level < len(LEVELS):
            tokens, branches = LEVELS[level]
            seeded = rest.join(classes.select("cid", "deep"), "cid").select("*", F.explode(F.array(*[F.lit(b) for b in range(branches)])).alias("branch"))
            chosen = [F.element_at("deep", (F.pmod(F.xxhash64("node", "branch", F.lit(t)), F.lit(DEEP)) + 1).cast("int")) for t in range(tokens)]
            rows = seeded.select(F.xxhash64("node", "branch", *chosen).alias("node"), *CARRIED)
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].union(parts[1]), *parts[2:]])
    exhaustive = cut(union(small).distinct())
    star = cut(union(stars).distinct()) if stars else None
    order = lambda c: F.xxhash64(c)
    ends = exhaustive.select(F.col("a").alias("me"), F.col("b").alias("other")).union(exhaustive.select("b", "a"))
    first = ends.groupBy("me").agg(F.min_by("other", order("other")).alias("other")).select(*_ordered(F.col("me"), F.col("other")))
    first = first.union(star) if star is not None else first
    members = ends.select("me")
    if star is not None:
        members = union([members, star.select("a"), star.select("b"), *[h.select("cid") for h in held]])
    wanted = cut(members.distinct().join(classes.select(F.col("cid").alias("me"), "rep"), "me").select(F.col("rep").alias("doc_id")).distinct())
    texts = base.join(wanted, "doc_id", "left_semi").select("text")
    if not wanted.where("doc_id is null").isEmpty():
        texts = texts.union(base.where("doc_id is null").select("text"))
    sets = cut(texts.mapInPandas(_sets(width), "cid binary, shingles array<long>").dropDuplicates(["cid"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b")

    links = cut(confirmed(cut(first.distinct())))
    labels = components(links)
    at = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"l{side}"))
    apart = exhaustive.join(at("a"), "a", "left").join(at("b"), "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    blocked = None
    if held:
        held = cut(union(held).join(labels.select(F.col("id").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid")))
        main = cut(held.groupBy("node", "label").count().groupBy("node").agg(F.max_by("label", F.struct("count", "label")).alias("main")))
        blocked = cut(block_links(held.join(main, "node").withColumn("outside", F.col("label") != F.col("main")).drop("main"), sets, percent))
    more = cut(confirmed(cut(apart.distinct())))
    more = more.union(blocked) if blocked is not None else more
    if not more.isEmpty():
        labels = components(links.union(more))
    grouped = classes.select("cid", "rep").join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = cut(grouped.groupBy("label").agg(F.min("rep").alias("component_id")))
    named = cut(cut(grouped).join(least, "label").select("cid", "component_id"))
    out = signed.select("doc_id", "n", "cid").join(named, "cid", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
