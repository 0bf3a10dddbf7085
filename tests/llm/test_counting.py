"""Collocations, language-model scores and source divergence against plain Python, and the sketch that they share."""

import math
import random
import re
from collections import Counter
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_corpus import empty_docs, odd_docs

from memlake.llm import count_min, partial_matching, slices
from memlake.llm.collocations import collocations
from memlake.llm.count_min import answers, by_slice, hot_cells, may_reach, sketch
from memlake.llm.divergence import source_divergence
from memlake.llm.slices import hashes, numbered

DOCS = "doc_id long, text string, lang string, source string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def some_docs(spark, seed=3, n=160):
    """Common and rare words, marks, tabs, letters beyond ASCII, nulls, repeated rows, one source with a third of the rows."""
    r = random.Random(seed)
    vocabulary = [*"the of And to in élan Été straße naïve x1 a-b".split(), *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6))]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for i in range(n):
        words = r.choices(vocabulary, weights, k=r.choice([0, 1, 3, 40, 120]))
        text = "".join(w + r.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b"]) for w in words)
        rows.append((i, r.choice([text, text, text, None]), r.choice(["en", "en", "fr", None]), r.choice(["hot", "s1", "s2", "s3", None])))
    rows += [(n, "only here", "xx", "alone"), (n + 1, "...", "yy", "s1"), (n + 2, None, "yy", "s2"), rows[5], rows[5]]
    return spark.createDataFrame(rows, DOCS), rows


def brute_collocations(rows, least, most, top, share=100):
    count, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            count.update((lang or "und", tuple(w[a : a + k])) for k in range(1, most + 1) for a in range(len(w) - k + 1))
    found = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    inside = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
    out = {}
    for (lang, p), a in found.items():
        if any(x == lang and inside(p, q) and 100 * b >= share * a for (x, q), b in found.items()):
            continue
        cuts = [(1000 * a * n[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), (a, count[lang, p[:k]], count[lang, p[k:]], n[lang], score)))
    return {(lang, i + 1, p.decode(), *rest) for lang, each in out.items() for i, (_, _, p, rest) in enumerate(sorted(each)[:top])}


@pytest.mark.parametrize(("least", "most", "top", "share"), [(3, 5, 2000, 100), (8, 3, 5, 60)])
def test_collocations_match_brute_force(spark, least, most, top, share):
    docs, rows = some_docs(spark)
    got = collocations(docs.withColumn("n", F.lit(1)).withColumn("phrase", F.lit("clash")), least, most, top, share)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = [tuple(x) for x in got.collect()]
    assert len(found) > 8 and len(found) == len(set(found))
    assert set(found) == brute_collocations(rows, least, most, top, share)


def test_collocations_whatever_the_slices_and_blocks(spark, monkeypatch):
    """The same rows where each document is a slice of its own, and where a narrow sketch rules nothing out."""
    docs, rows = some_docs(spark, seed=4)
    want = brute_collocations(rows, 4, 5, 2000)
    monkeypatch.setattr("memlake.llm.collocations.slices", lambda d, **c: slices.slices(d, 1, **c))
    assert {tuple(x) for x in collocations(docs, 4).collect()} == want
    monkeypatch.setattr("memlake.llm.collocations.may_reach", lambda keys, hot, blocks, number=0: np.ones(len(keys), bool))
    assert {tuple(x) for x in collocations(docs, 4).collect()} == want


def test_collocation_scores_beyond_64_bits(spark):
    exact = spark.sql("select 9000000000000 as a, 900000000000000 as n, 9000000000000 as l, 9000000000001 as r")
    wide = lambda c: c.cast("decimal(19,0)")
    got = exact.select(F.call_function("div", wide(1000 * F.col("a")) * wide(F.col("n")), wide(F.col("l")) * wide(F.col("r")))).first()[0]
    assert got == 1000 * 9000000000000 * 900000000000000 // (9000000000000 * 9000000000001)


def brute_divergence(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    count, df, groups = Counter(), Counter(), {}
    for _, text, lang, source in rows:
        found = Counter(term.findall((text or "").translate(FOLD)))
        groups.setdefault(lang or "", set()).add(source or "")
        for t, n in found.items():
            count[lang or "", source or "", t] += n
            df[lang or "", t] += 1
    out = set()
    for lang, sources in groups.items():
        kept = [t for (x, t), n in df.items() if x == lang and n >= least]
        p = {}
        for s in [*sources, None]:
            c = {t: count[lang, s, t] if s is not None else sum(count[lang, x, t] for x in sources) for t in kept}
            p[s] = {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources - {s})
            terms = sorted((-f(p[s][t], p[None][t]), t.encode()) for t in kept if count[lang, s, t] and p[s][t] > p[None][t])
            for part, ranked in (("pair", pairs), ("term", terms[:top])):
                out |= {(lang, s, part, x.decode(), -v, i + 1) for i, (v, x) in enumerate(ranked)}
    return out


@pytest.mark.parametrize(("least", "top"), [(3, 200), (10, 4), (10_000, 5)])
def test_divergence_matches_brute_force(spark, least, top):
    docs, rows = some_docs(spark)
    got = source_divergence(docs.withColumn("term", F.lit("clash")).withColumn("n", F.lit(2)), least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute_divergence(rows, least, top)


def brute_matching(texts, held):
    """A trie of dictionaries, and symbols excluded one by one."""
    below = {}
    coded = [b"\xff" * 4 + (t or "").translate(FOLD).encode() + b"\xff" for t in texts]
    for x in (x for x, h in zip(coded, held, strict=True) if not h):
        for i, o in product(range(4, len(x)), range(5)):
            below.setdefault(x[i - o : i], Counter())[x[i]] += 1

    def one(x, i):
        seen, lp = set(), 0.0
        for o in range(4, -1, -1):
            here = {s: n for s, n in below.get(x[i - o : i], {}).items() if s not in seen}
            if not here:
                continue
            bottom = sum(here.values()) + len(here)
            if x[i] in here:
                return lp + math.log10(here[x[i]] / bottom)
            lp += math.log10(len(here) / bottom)
            seen |= set(here)
        return lp - math.log10(256 - len(seen))

    return [sum(one(x, i) for i in range(4, len(x))) for x in coded]


def brute_base(texts, held):
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) + [None] for t in texts]
    c = Counter(w for each, h in zip(words, held, strict=True) if not h for w in each)
    total = sum(c.values())
    return [(len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 0.1) / (total + 0.1 * (len(c) + 1))) for x in w)) for w in words]


@pytest.mark.parametrize("make", ["some", "odd", "held"])
def test_partial_matching_matches_brute_force(spark, make):
    docs = {"some": lambda: some_docs(spark)[0], "odd": lambda: odd_docs(spark), "held": lambda: some_docs(spark)[0].where("doc_id = 9")}[make]()
    rows = docs.select("doc_id", "text").collect()
    held = [crc32(str("" if x.doc_id is None else x.doc_id).encode()) % 10 == 0 for x in rows]
    texts = [x.text for x in rows]
    want = sorted(zip([-1 if x.doc_id is None else x.doc_id for x in rows], held, brute_base(texts, held), brute_matching(texts, held), strict=True))
    got = partial_matching.partial_matching(docs.withColumn("score", F.lit(1)).withColumn("answer", F.lit(1))).collect()
    assert len(got) == len(rows)
    for (i, h, (n, known, total, base), score), x in zip(want, sorted(got, key=lambda x: (-1 if x.doc_id is None else x.doc_id, x.held_out, (x.n_tokens, x.n_known, x.train_tokens, x.base_score))), strict=True):
        assert (i, h, n, known, total) == (-1 if x.doc_id is None else x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens)
        assert base == pytest.approx(x.base_score, rel=1e-9) and score == pytest.approx(x.score, rel=1e-9)


def test_a_bounded_trie_is_a_trie_and_prefers_text_to_noise(spark):
    docs, _ = some_docs(spark)
    parts = slices.slices(docs, held_out=F.lit(False))
    trie = partial_matching.train(parts, nodes=400)
    assert 100 < sum(len(x.grams) for x in trie) <= 400
    for order in range(1, 5):
        assert np.isin(trie[order].contexts >> np.uint64(8), trie[order - 1].contexts).all()
    r = random.Random(1)
    text = some_docs(spark, seed=9)[1]
    scrambled = [(i, "".join(r.sample(t, len(t))), "en", "s") for i, t, *_ in text if t and len(t) > 60]
    score = lambda rows: sum(x.score for x in partial_matching.partial_matching(docs.union(spark.createDataFrame([(10_000 + i, *x) for i, *x in rows], DOCS)).where("doc_id < 10000 or crc32(cast(doc_id as string)) % 10 = 0")).where("doc_id >= 10000").collect())
    plain = [x for x in text if x[1] and len(x[1]) > 60]
    assert score(plain) > score(scrambled)


@pytest.mark.parametrize("nodes", [0, 400, 3000])
def test_what_a_bounded_trie_leaves_out_is_asked_for(spark, nodes, monkeypatch):
    """Scores are those of all contexts, whatever the executors hold; groups of 500 n-grams."""
    monkeypatch.setattr(partial_matching, "GROUP", 500)
    docs = some_docs(spark)[0]
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([x.doc_id for x in rows], brute_matching([x.text for x in rows], [crc32(str(x.doc_id).encode()) % 10 == 0 for x in rows]), strict=True))
    got = partial_matching.partial_matching(docs, nodes).collect()
    assert len(got) == len(rows) and all(x.score == pytest.approx(want[x.doc_id], rel=1e-9) for x in got)


def test_empty_tables(spark):
    for run in (collocations, source_divergence, partial_matching.partial_matching):
        assert run(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("least", [2, 300, 5000])
def test_a_sketch_never_underestimates(spark, least):
    """Twelve slices that together reach the threshold for some keys: none of those is ruled out, and most others are."""
    r = np.random.default_rng(0)
    keys = r.integers(1, 1 << 63, 30_000, dtype=np.uint64)
    counts = r.integers(1, max(2, least // 6), (12, 30_000))
    counts[:, :500] = least // 12 + 1
    counts[:, 500:] = np.where(r.random((12, 29_500)) < 1 / 12, np.minimum(counts[:, 500:], max(1, least // 30)), 0)
    blocks = count_min.blocks_for(keys.size, 100)
    held = [(i, keys[c > 0], c[c > 0]) for i, c in enumerate(counts)]
    sent = pa.Table.from_batches([b for i, k, c in held for b in sketch(i, k, c, blocks, least)])
    back = {x.slice: x.hot for x in by_slice(answers(spark.createDataFrame(sent.to_pandas(), count_min.SENT), least)).collect()}
    reached = counts.sum(axis=0) >= least
    for i, k, c in held:
        may = may_reach(k, hot_cells([y.asDict() for y in back.get(i, [])], k, blocks), blocks)
        true = reached[counts[i] > 0]
        assert may[true].all()
        assert may[~true].mean() < 0.05


def test_hashes_do_not_depend_on_place_or_block():
    data = np.frombuffer(b"one two  one two three" * 50, np.uint8)
    starts, ends = slices.tokens(data, slices.kinds(b" "))
    whole, small = hashes(data, starts, ends, 7), hashes(data, starts, ends, 7, block=5)
    assert (whole == small).all()
    first, number = numbered(whole, whole)
    assert len(first) == len({bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)}) and (whole[first][number] == whole).all()


def test_numbers_of_colliding_hashes():
    first, number = numbered(np.array([5, 5, 1, 5], np.uint64), np.array([1, 2, 3, 1], np.uint64))
    assert len(first) == 3 and number[0] == number[3] != number[1]
