"""Language proportions of each document by expectation-maximisation over n-gram likelihoods.

Every language has a multinomial over hashed character 1- to 3-grams, learnt from labelled rows outside the held-out fold (about
PER_LANGUAGE different documents of each language, chosen by a hash; all of them where there are fewer). A document is a mixture of languages; EM finds the
proportions. The set of languages grows greedily from the best single one while the log-likelihood, with each gram counted as a
third of an observation as they overlap, gains more than the penalty for one more language. The prediction is the language with
the largest proportion, the score that proportion.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or if nothing was learnt; ties go to the
alphabetically first language. Whole texts are read, whatever their length. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import fold_bucket, sampled

BUCKETS = 1 << 15
PER_LANGUAGE = 1500
MIN_SHARE = 0.03
UNIT = 1 << 20

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gram buckets of a text and their counts; empty without a letter."""
    empty = np.empty(0, np.int64), np.empty(0)
    if not text:
        return empty
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return empty
    c = np.where(letter, c, np.uint32(32))
    c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)]))
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    h = [c * np.uint32(2654435761), c[:-1] * np.uint32(2246822519) + c[1:] * np.uint32(3266489917), c[:-2] * np.uint32(668265263) + c[1:-1] * np.uint32(374761393) + c[2:] * np.uint32(2870177450 | 1)]
    h[0] = h[0][c != 32]
    g = np.concatenate(h)
    g ^= g >> np.uint32(15)
    n = np.bincount((g * np.uint32(2246822519)) >> np.uint32(17), minlength=BUCKETS)
    at = np.nonzero(n)[0]
    return at, n[at].astype(np.float64)


def _em(p: np.ndarray, n: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    share = np.full(len(p), 1 / len(p))
    for _ in range(rounds if len(p) > 1 else 0):
        r = share[:, None] * p
        new = (r / r.sum(0)) @ n / n.sum()
        if np.abs(new - share).max() < 1e-3:
            share = new
            break
        share = new
    return share, float(n @ np.log(share @ p))


def mixture(p: np.ndarray, n: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Languages chosen by penalised likelihood and their proportions. p: likelihood of each gram by language; n: gram counts."""
    n = n / 3
    penalty = max(2 * np.log(n.sum() + 1), 0.02 * n.sum())
    single = np.log(p) @ n
    chosen = [int(single.argmax())]
    share, best = np.ones(1), float(single.max())
    rivals = [int(i) for i in np.nonzero(_em(p, n, 6)[0] >= MIN_SHARE)[0] if i != chosen[0]]
    while rivals:
        tried = [(i, *_em(p[[*chosen, i]], n)) for i in rivals]
        i, new, like = max(tried, key=lambda x: x[2])
        if like - best <= penalty or new[-1] < MIN_SHARE:
            break
        chosen, share, best = [*chosen, i], new, like
        rivals.remove(i)
    return chosen, share


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, totals: dict[str, int] | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and their gram likelihoods (language x bucket). docs: doc_id, text, lang. totals: documents of each language, if known."""
    rows = docs.where((fold_bucket() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = totals or {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return [], np.empty((0, BUCKETS))
    chosen = F.lit(False)
    for lang, n in sorted(totals.items()):
        if n > per_language:
            chosen = F.when(F.col("lang") == lang, sampled(["doc_id", "text"], per_language, n, 11)).otherwise(chosen)
    few = [lang for lang, n in totals.items() if n <= per_language]
    sample = rows.where(F.col("lang").isin(few) | chosen).select("lang", "text").distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts in units of 2^-20, a document weighing at most 3,000 grams: whole numbers, so that their order does not matter."""
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf.lang, pdf.text, strict=True):
                at, n = gram_counts(text)
                if lang not in held:
                    held[lang] = np.zeros(BUCKETS, np.int64)
                held[lang][at] += np.rint(n * (UNIT / max(1.0, n.sum() / 3000))).astype(np.int64)
        for lang, n in held.items():
            at = np.nonzero(n)[0]
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    grams = sample.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(totals)
    table = np.full((len(langs), BUCKETS), 0.5)
    np.add.at(table, (grams.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(int), grams.bucket.to_numpy(int)), grams.n.to_numpy(float) / UNIT)
    return langs, table / table.sum(1, keepdims=True)


def language_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and mixture: the chosen languages with their proportions, largest first."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    langs, table = learn(base, per_language)
    table = table.astype(np.float32)

    @F.pandas_udf("struct<lang_pred string, score double, mixture array<struct<lang string, share double>>>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            at, n = gram_counts(t)
            if not len(at) or not langs:
                out.append(("und", 0.0, []))
                continue
            chosen, share = mixture(table[:, at].astype(np.float64), n)
            parts = sorted(zip((langs[i] for i in chosen), share.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
            out.append((parts[0][0], min(1.0, parts[0][1]), [{"lang": a, "share": b} for a, b in parts]))
        return pd.DataFrame(out, columns=["lang_pred", "score", "mixture"])

    return base.select("doc_id", (fold_bucket() == 0).alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.mixture")
