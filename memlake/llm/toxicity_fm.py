"""Toxicity by a factorization machine over hashed terms.

Labels are learnt from a bounded sample (about SAMPLE labelled rows outside the held-out fold, chosen by a hash); terms are
hashed words and word beginnings. Spark counts in how many sampled texts of each class a term occurs; the FEATURES terms whose counts
differ most by a chi-square test become features, and only they reach the driver, which trains the machine: a weight and a latent
vector for each, so that a pair of terms (an insult and the mention of a group) adds to the score what neither adds alone.
Scoring reads whole texts and uses nothing but the text.

Defined results: null and empty texts get the score of a text without features; without labels of both kinds every score is the
share of positives (0 if there are no labels). A label of a document counts once however often it is repeated, and documents that
share an id each count; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import cut, fold_bucket, sampled

SAMPLE = 20_000
HASHES = 1 << 20
FEATURES = 4096
FACTORS = 6
EPOCHS = 30
#: Besides the word itself, its first letters are terms, so that inflected insults share a term.
STEMS = (4, 5)
CHI2 = 12.0
#: Weight of a positive row, as they are the rarer ones.
POSITIVE = 4.0

_WORD = re.compile(r"\w+")


def _terms(word: str) -> tuple[int, ...]:
    return tuple(xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) % HASHES for x in (word, *(f"^{word[:n]}" for n in STEMS if len(word) > n)))


class Terms:
    """The hashed terms of a text or, with ``slots``, the slots of those that are features; words already met are remembered."""

    def __init__(self, slots: dict[int, int] | None = None):
        self.slots, self.memo = slots, {}

    def __call__(self, text: str | None) -> list[int]:
        out: set[int] = set()
        for w in set(_WORD.findall(text.lower())) if text else ():
            own = self.memo.get(w)
            if own is None:
                if len(self.memo) > 300_000:
                    self.memo.clear()
                own = _terms(w)
                if self.slots is not None:
                    own = tuple(self.slots[t] for t in own if t in self.slots)
                self.memo[w] = own
            if own:
                out.update(own)
        return sorted(out)


class FactorizationMachine:
    """Score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>) over the slots of the features a text holds."""

    def __init__(self, w0: float, index: dict[int, int], w: np.ndarray, v: np.ndarray):
        self.w0, self.index, self.w, self.v = w0, index, w, v

    def score(self, at: list[int]) -> float:
        v = self.v[at]
        z = self.w0 + self.w[at].sum() + 0.5 * (v.sum(0) ** 2 - (v * v).sum(0)).sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(y: np.ndarray, lens: np.ndarray, at: np.ndarray, features: list[int], seed: int = 3) -> FactorizationMachine:
    """y: labels 0 or 1; lens: features of each row; at: the rows' slots, one after another. AdaGrad on the logistic loss with L2."""
    rng = np.random.default_rng(seed)
    y = y.astype(float)
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return FactorizationMachine(-30.0 if not pos else 30.0, {}, np.empty(0), np.empty((0, FACTORS)))
    best, index = features, {h: i for i, h in enumerate(features)}
    row_of = np.repeat(np.arange(len(y)), lens)
    starts = np.searchsorted(row_of, np.arange(len(y) + 1))
    w0, w, v = float(np.log(pos / neg)), np.zeros(len(best)), rng.normal(0, 0.02, (len(best), FACTORS))
    gw, gv, g0 = np.full(len(best), 1e-2), np.full(v.shape, 1e-2), 1e-2
    for _ in range(EPOCHS):
        for rows_at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
            size = starts[rows_at + 1] - starts[rows_at]
            own = np.repeat(np.arange(len(rows_at)), size)
            idx = at[np.repeat(starts[rows_at] - np.concatenate(([0], size.cumsum()[:-1])), size) + np.arange(size.sum())]
            vi = v[idx]
            s = np.zeros((len(rows_at), FACTORS))
            np.add.at(s, own, vi)
            z = w0 + np.bincount(own, w[idx], len(rows_at)) + 0.5 * ((s * s).sum(1) - np.bincount(own, (vi * vi).sum(1), len(rows_at)))
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows_at]
            err = np.where(y[rows_at] > 0, POSITIVE, 1.0) * err
            e = err[own]
            dw, dv = np.zeros_like(w), np.zeros_like(v)
            np.add.at(dw, idx, e)
            np.add.at(dv, idx, e[:, None] * (s[own] - vi))
            hit = np.unique(idx)
            dw, dv = dw[hit] + 1e-3 * w[hit] * len(rows_at), dv[hit] + 3e-3 * v[hit] * len(rows_at)
            gw[hit] += dw**2
            gv[hit] += dv**2
            w[hit] -= 0.3 * dw / np.sqrt(gw[hit])
            v[hit] -= 0.05 * dv / np.sqrt(gv[hit])
            g0 += err.sum() ** 2
            w0 -= 0.3 * err.sum() / np.sqrt(g0)
    return FactorizationMachine(w0, index, w, v)


def features(found: DataFrame, pos: int, neg: int) -> list[int]:
    """At most FEATURES terms that tell the classes apart; found: toxic, terms (distinct in a row)."""
    counts = found.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("a"))
    n, a = F.col("n").cast("double"), F.col("a").cast("double")
    apart = a * (neg - (n - a)) - (n - a) * (pos - a)
    chi2 = (pos + neg) * apart * apart / F.greatest(n * (pos + neg - n) * float(pos) * float(neg), F.lit(1.0))
    return sorted(r.term for r in counts.where("n >= 3").select("term", chi2.alias("chi2")).where(F.col("chi2") >= CHI2).orderBy(F.desc("chi2"), "term").limit(FEATURES).collect())


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """docs: doc_id, text; labels: doc_id, toxic. Only rows outside the held-out fold are read. The driver gets at most FEATURES
    slots for each sampled row, however long its text is."""
    known = labels.where((fold_bucket() != 0) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    picked = cut(known.where(sampled(["doc_id"], sample, known.count(), 5)))

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Terms()
        for pdf in batches:
            yield pd.DataFrame({"row": pdf.row, "toxic": pdf.toxic, "terms": [of(t) for t in pdf.text]})

    texts = docs.join(F.broadcast(picked), "doc_id").select(F.xxhash64("doc_id", "text", F.lit(5)).alias("row"), "toxic", "text")
    found = cut(texts.mapInPandas(terms, "row long, toxic int, terms array<int>"))
    found = found.where(sampled(["row"], sample, found.count()))
    sums = {r.toxic: r["count"] for r in found.groupBy("toxic").count().collect()}
    pos, neg = sums.get(1, 0), sums.get(0, 0)
    chosen = features(found, pos, neg) if pos and neg else []
    slots = {h: i for i, h in enumerate(chosen)}

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"row": pdf.row, "toxic": pdf.toxic, "at": [[slots[t] for t in x if t in slots] for x in pdf.terms]})

    rows = found.mapInPandas(own, "row long, toxic int, at array<int>").toArrow().sort_by([("row", "ascending"), ("toxic", "ascending")])
    at = rows["at"].combine_chunks()
    return fit(rows["toxic"].to_numpy(), at.value_lengths().to_numpy(zero_copy_only=False), at.flatten().to_numpy(zero_copy_only=False), chosen)


def scorer(model: FactorizationMachine):
    """A column function: score of a text."""
    slots = Terms(model.index)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(slots(t)) for t in texts], dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    score = scorer(learn(base, labels, sample))
    out = base.select("doc_id", (fold_bucket() == 0).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
