"""Numbered operators against plain versions: the machine's score, packing by exhaustive rules, mixtures by every set of languages, odd rows of searches and joins."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm.best_fit import pack
from memlake.llm.impact_index import impact_topk
from memlake.llm.language_mixture import mixture
from memlake.llm.multi_index import multi_index_links
from memlake.llm.toxicity_fm import FactorizationMachine, toxicity

VECTORS = "vec_id long, embedding array<float>, label int, score string, rank string, id string"


def test_machine_scores_are_the_double_sum():
    r = np.random.default_rng(2)
    model = FactorizationMachine(0.3, {}, r.normal(size=30), r.normal(size=(30, 8)))
    for n in (0, 1, 2, 7, 30):
        at = sorted(r.choice(30, n, replace=False).tolist())
        z = 0.3 + sum(model.w[i] for i in at) + sum(float(model.v[i] @ model.v[j]) for i, j in combinations(at, 2))
        assert model.score(at) == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), rel=1e-9)


def test_toxicity_of_a_very_long_labelled_text(spark):
    insult = "those gruk people are vile filth"
    texts = [(i, (insult if i % 2 else "a calm and pleasant day by the sea") + f" number {i}") for i in range(300)] + [(1001, "calm words and more " * 40_000), (1002, insult + " " + "filler " * 60_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = docs.select("doc_id", F.when((F.col("doc_id") % 2 == 1) & (F.col("doc_id") < 1000) | (F.col("doc_id") == 1002), 1).otherwise(0).alias("toxic"), F.lit(1).alias("quality"))
    got = {x.doc_id: x.score for x in toxicity(docs, labels).collect()}
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values()) and got[1001] < 0.5
    assert np.mean([got[i] > 0.5 for i in range(1, 300, 2)]) > 0.95 and np.mean([got[i] < 0.5 for i in range(0, 300, 2)]) > 0.95


def plain_pack(pieces, lengths, overhead):
    """Each piece into the open bin with the least room that takes it, oldest among equals; else the length of least cost, tried by filling it."""
    bins, left, out = [], Counter(pieces), []
    for size in pieces:
        left[size] -= 1
        fits = [(length - used, i) for i, (length, used) in enumerate(bins) if length - used >= size]
        if fits:
            i = min(fits)[1]
        else:
            costs = []
            for length in (c for c in lengths if c >= size):
                room, rest = length - size, sorted(left.elements(), reverse=True)
                for other in rest:
                    room -= other if other <= room else 0
                costs.append(((length + overhead) / (length - room), -length, length))
            i = len(bins)
            bins.append((min(costs)[2], 0))
        out.append((i, bins[i][1]))
        bins[i] = (bins[i][0], bins[i][1] + size)
    return [(i, at, min(c for c in lengths if c >= bins[i][1])) for i, at in out]


def test_packing_matches_a_plain_version():
    r = random.Random(8)
    for _ in range(300):
        lengths = tuple(sorted(r.sample(range(4, 40), r.randrange(1, 4))))
        pieces = sorted((r.randrange(1, lengths[-1] + 1) for _ in range(r.randrange(0, 14))), reverse=True)
        overhead = r.choice([0, 2, 16])
        assert pack(pieces, lengths, overhead) == plain_pack(pieces, lengths, overhead), (pieces, lengths, overhead)


def test_mixtures_match_the_best_set_of_languages():
    """Over every set of languages: the penalised likelihood of the chosen set is the best or next to it."""
    r = np.random.default_rng(4)
    p = r.dirichlet(np.full(60, 0.2), 4) + 1e-4
    p /= p.sum(1, keepdims=True)

    def like(rows, n):
        share = np.full(len(rows), 1 / len(rows))
        for _ in range(400):
            resp = share[:, None] * p[rows]
            share = (resp / resp.sum(0)) @ n / n.sum()
        return float(n @ np.log(share @ p[rows])), share

    for true in ([0], [2], [0, 1], [1, 3], [0, 2, 3]):
        shares = r.dirichlet(np.full(len(true), 8.0))
        counts = r.multinomial(6000, shares @ p[true]).astype(float)
        chosen, got = mixture(p, counts)
        assert sorted(chosen) == true
        n = counts / 3
        penalty = max(2 * np.log(n.sum() + 1), 0.02 * n.sum())
        scores = {s: like(list(s), n)[0] - penalty * len(s) for k in (1, 2, 3, 4) for s in combinations(range(4), k)}
        assert max(scores, key=scores.get) == tuple(true)
        assert np.abs(got[np.argsort(chosen)] - like(true, n)[1]).max() < 0.05


def test_topk_with_null_ids_repeats_and_clashing_names(spark):
    r = np.random.default_rng(1)
    x = {i: [float(v) for v in r.normal(size=6).astype(np.float32)] for i in range(250)}
    rows = [(i, v, i % 3, "s", "r", "i") for i, v in x.items()]
    rows += [(None, x[3], 1, "s", None, None), rows[100], rows[100], rows[7], (251, None, 1, None, None, None), (300, [float("nan")] * 6, 1, None, None, None), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, None, None, None)]
    got = {}
    for y in impact_topk(spark.createDataFrame(rows, VECTORS)).collect():
        got.setdefault(y.query_id, []).append((y.rank, y.vec_id, y.score))
    whole = {i: np.floor(1024 * np.asarray(v, np.float64)).astype(np.int64) for i, v in x.items()}
    times = Counter(i for i, v, *_ in rows if i is not None and i in x)
    for q in (0, 100, 200):
        every = sorted((-int(whole[q] @ whole[i]), i) for i in x if i != q for _ in range(times[i]))[:10]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(every)]
    assert set(got) == {0, 100, 200}


def test_links_with_null_ids_and_clashing_names(spark):
    one, other = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0]
    rows = [(1, one, 5, "s", "r", "i"), (2, other, 5, None, None, None), (None, one, 5, "s", None, None), (3, one, None, None, None, None), (4, [0.0, 0.0, 0.0], 5, None, None, None), (5, None, 5, None, None, None), (6, [0.0, 1.0, 0.0], 5, None, None, None)]
    got = sorted((x.vec_id is None, x.vec_id or 0, x.n_links >= 1, x.component_id if x.vec_id else None, x.kept) for x in multi_index_links(spark.createDataFrame(rows, VECTORS)).collect())
    assert len(got) == 7
    known = {i: (linked, component, kept) for null, i, linked, component, kept in got if not null}
    assert known[1] == (True, 1, True) and known[2] == (True, 1, False)
    assert all(known[i] == (False, i, True) for i in (3, 4, 5, 6))
