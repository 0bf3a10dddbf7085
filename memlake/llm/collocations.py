"""Phrase collocations: merged count-min sketches rule out rare n-grams, a second pass counts the survivors exactly, then scores and subsumes.

Two sketches (``count_min``) are filled, first with how often each slice holds each word and pair of words, then with its longer n-grams whose
pairs all survive the first. An n-gram as frequent as asked has hot cells in every row, so it survives in all slices that hold it, and so
do its parts, which are at least as frequent. The last reading counts survivors by their words, longer ones only where both shorter ones
survive, and sends them packed to the block of their hash, where the counts of a phrase are added up by its text. A chance survivor fails the exact threshold, so the sketches decide what is shuffled,
never what is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import cut
from memlake.llm.count_min import SENT, answers, blocks_for, by_slice, hot_cells, may_reach, sketch
from memlake.llm.slices import hashes, kinds, mix, numbered, rows_of, slices, strings, text_seeds, tokens

#: Words end at blanks and tabs, pieces at these marks.
_KINDS = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Cells of a sketch for each word of the corpus. A word begins two n-grams of the first sketch, so a cell holds about four, far below usual thresholds.
CELLS = 0.5
#: Words of the n-grams of the first sketch.
SHORT = 2
#: Words of the corpus whose surviving phrases meet in one block.
PART = 1 << 23
#: Phrases that a task gathers before it sends them.
GATHERED = 200_000


def _words(row: dict, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts, ends, pieces and languages (places in the slice's list) of a slice's words, and hashes that tell languages apart."""
    data = row["text"]
    starts, ends = tokens(data, _KINDS)
    piece = np.cumsum(_KINDS[data] == 2, dtype=np.int32)[starts] if len(starts) else starts
    doc = np.searchsorted(row["ends"], starts, "right")
    langs, lang = np.unique(np.asarray(row["lang"], dtype=object), return_inverse=True)
    lang = lang[doc]
    return data, starts, ends, piece, lang, mix(hashes(data, starts, ends, seed) ^ text_seeds(pa.array(langs), seed)[lang])


def _longer(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix(h * _FACTOR + last)


def _sent(name: int, grams: np.ndarray, blocks: int, least: int, number: int) -> Iterator[pa.RecordBatch]:
    grams = np.sort(grams)
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return sketch(name, grams[first], np.diff(first, append=len(grams)), blocks, least, number)


def _short_grams(piece: np.ndarray, word: np.ndarray, most: int) -> np.ndarray:
    """The words and pairs of a slice, for the first sketch."""
    return np.concatenate([word, _longer(word[:-1], word[1:])[piece[:-1] == piece[1:]]]) if most > 1 else word


def _long_grams(piece: np.ndarray, word: np.ndarray, most: int, hot: list[np.ndarray], blocks: int) -> np.ndarray:
    """Its n-grams of more words where every pair has survived the first sketch, for the second."""
    h, alive = _longer(word[:-1], word[1:]), piece[:-1] == piece[1:]
    alive[alive] = may_reach(h[alive], hot, blocks)
    found, pairs = [word[:0]], alive
    for n in range(SHORT + 1, most + 1):
        h, alive = _longer(h[:-1], word[n - 1 :]), alive[:-1] & pairs[n - 2 :]
        found.append(h[alive])
    return np.concatenate(found)


def _short(blocks: int, least: int, most: int):
    """What each slice sends to the first sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, _, _, piece, _, word = _words(row, 1)
            yield from _sent(row["slice"], _short_grams(piece, word, most), blocks, least, 0)

    return run


def _long(blocks: int, least: int, most: int):
    """What each slice sends to the second sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, _, _, piece, _, word = _words(row, 1)
            hot = hot_cells(row["hot"], _short_grams(piece, word, most), blocks)
            yield from _sent(row["slice"], _long_grams(piece, word, most, hot, blocks), blocks, least, 1)

    return run


def _survivors(blocks: int, most: int, parts: int):
    """The surviving n-grams of a task's slices, spelt out, counted and packed for each of ``parts`` blocks of phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows_of(batches):
            data, starts, ends, piece, lang, word = _words(row, 1)
            langs, hot = pa.array(np.unique(np.asarray(row["lang"], dtype=object)), pa.string()), [hot_cells(row["hot"], _short_grams(piece, word, most), blocks)]
            hot.append(hot_cells(row["hot"], _long_grams(piece, word, most, hot[0], blocks), blocks, 1))
            first, number = numbered(word, mix(hashes(data, starts, ends, 2) ^ text_seeds(langs, 2)[lang]))
            phrases, found = [], []
            h, known, alive = word, number.astype(np.int64), may_reach(word[first], hot[0], blocks)[number]
            for n in range(1, most + 1):
                at = np.flatnonzero(alive)
                if n > 1:
                    at = at[at + n - 1 < len(word)]
                    at = at[alive[at + 1] & (piece[at] == piece[at + n - 1])]
                    h_at = _longer(h[at], word[at + n - 1])
                    pair = (known[at] << 32) | number[at + n - 1]
                    seen = may_reach(h_at, hot[n > SHORT], blocks, int(n > SHORT))
                    at, h_at, pair = at[seen], h_at[seen], pair[seen]
                    h, known, alive = np.zeros_like(h), np.zeros_like(known), np.zeros_like(alive)
                    h[at], alive[at] = h_at, True
                    _, known[at] = np.unique(pair, return_inverse=True)
                if not len(at):
                    break
                _, one, counts = np.unique(known[at], return_index=True, return_counts=True)
                spelt = at[one]
                words = [strings(data, starts[spelt + i], ends[spelt + i]) for i in range(n)]
                phrase = words[0] if n == 1 else pc.binary_join_element_wise(*words, " ")
                phrases.append(phrase)
                found.append(np.stack([h[spelt] if n > 1 else word[spelt], lang[spelt].astype(np.uint64), np.full(len(one), n, np.uint64), counts.astype(np.uint64)]))
            if phrases:
                held.append((pa.concat_arrays(phrases), *np.concatenate(found, axis=1), langs))
            if sum(len(x[0]) for x in held) > GATHERED:
                yield _packed(*_together(held), parts)
                held = []
        if held:
            yield _packed(*_together(held), parts)

    return run


_PACKED = pa.schema([("langs", pa.list_(pa.string())), ("part", pa.int64()), ("phrases", pa.int32()), ("size", pa.int64()), ("data", pa.binary())])
_EXACT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64())])


def _together(held: list[tuple]) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """The phrases of several slices (phrases, hashes, languages, sizes, counts, names of languages) with their counts added up."""
    names: dict = {}
    lang = np.concatenate([np.array([names.setdefault(x, len(names)) for x in h[5].to_pylist()], np.int64)[h[2].astype(np.int64)] for h in held])
    spelt = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
    keys, first, at = np.unique(spelt.indices.to_numpy() * len(names) + lang, return_index=True, return_inverse=True)
    total = np.zeros(len(keys), np.uint64)
    np.add.at(total, at, np.concatenate([h[4] for h in held]))
    one, size = (np.concatenate([h[i] for h in held])[first] for i in (1, 3))
    return spelt.dictionary.take(pa.array(keys // len(names))), np.stack([one, (keys % len(names)).astype(np.uint64), size, total]), pa.array(list(names), pa.string())


def _packed(phrase: pa.Array, found: np.ndarray, langs: pa.Array, parts: int) -> pa.RecordBatch:
    """Phrases with hash, language, number of words and count, a row for each part; in order, so that they compress well."""
    order = pc.sort_indices(phrase).to_numpy()
    part = ((found[0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)[order]
    order = order[np.argsort(part, kind="stable")]
    part, planes = np.sort(part), found[1:, order].astype(np.uint32)
    spelt = phrase.take(pa.array(order)).cast(pa.large_string())
    offsets = np.frombuffer(spelt.buffers()[1], np.int64)[: len(spelt) + 1]
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    rows = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        raw = planes[:, a:b].tobytes() + np.diff(offsets[a : b + 1]).astype(np.uint32).tobytes() + spelt.buffers()[2][int(offsets[a]) : int(offsets[b])].to_pybytes()
        rows.append((langs.to_pylist(), int(part[a]), b - a, len(raw), pa.compress(raw, codec="zstd", asbytes=True)))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


def _merged(least: int):
    """The exact counts of a part's phrases."""

    def run(group: pa.Table) -> pa.Table:
        langs, columns = {}, []
        for row in group.to_pylist():
            raw, k = pa.decompress(row["data"], row["size"], codec="zstd", asbytes=True), row["phrases"]
            lang, size, n, lens = (np.frombuffer(raw, np.uint32, k, 4 * k * i) for i in range(4))
            ends = np.cumsum(lens, dtype=np.int64)
            spelt = strings(np.frombuffer(raw, np.uint8, offset=16 * k), ends - lens, ends)
            columns.append((spelt, np.array([langs.setdefault(x, len(langs)) for x in row["langs"]], np.int64)[lang], size, n))
        spelt = pa.chunked_array([x[0] for x in columns]).combine_chunks().dictionary_encode()
        lang, size, n = (np.concatenate([x[i] for x in columns]) for i in range(1, 4))
        keys, first, at = np.unique(spelt.indices.to_numpy() * len(langs) + lang, return_index=True, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, n)
        keep = total >= least
        name = pa.array(list(langs), pa.string()).take(pa.array((keys % len(langs))[keep]))
        return pa.Table.from_arrays([name, spelt.dictionary.take(pa.array((keys // len(langs))[keep])), pa.array(size[first][keep].astype(np.int32)), pa.array(total[keep])], schema=_EXACT)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of words of each language in each slice."""
    for row in rows_of(batches):
        _, _, _, _, lang, _ = _words(row, 1)
        langs = np.unique(np.asarray(row["lang"], dtype=object))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.bincount(lang, minlength=len(langs)))], names=["lang", "n"])


def frequent_phrases(docs: DataFrame, least: int = 100, most: int = 5, lang: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """docs: text, lang -> exact counts (lang, phrase, size, n) of every phrase of 1 to ``most`` words with n >= ``least``, and (lang, n), the number of words."""
    parts = slices(docs, lang=F.coalesce(F.col("lang") if lang is None else lang, F.lit("und")))
    totals = cut(parts.select("text", "ends", "lang").mapInArrow(_counted, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")))
    words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = blocks_for(words, CELLS)
    asked = cut(answers(parts.mapInArrow(_short(blocks, least, most), SENT), least))
    with_answers = lambda hot: parts.join(by_slice(hot).hint("shuffle_hash"), "slice", "left")
    both = with_answers(asked.union(answers(with_answers(asked).mapInArrow(_long(blocks, least, most), SENT), least)))
    packed = both.mapInArrow(_survivors(blocks, most, words // PART + 1), "langs array<string>, part long, phrases int, size long, data binary")
    exact = packed.groupBy("part").applyInArrow(_merged(least), "lang string, phrase string, size int, n long")
    return cut(exact), totals


def subsumed(phrases: DataFrame, share: int = 100) -> DataFrame:
    """lang, phrase of those inside a longer phrase that is at least ``share`` hundredths as frequent."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda a: F.array_join(F.slice(words, a, n), " "))))
    held = phrases.where("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("n").alias("longer"))
    most = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return phrases.join(most, ["lang", "phrase"]).where(100 * F.col("longer") >= share * F.col("n")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = 100, most: int = 5, top: int = 2000, share: int = 100) -> DataFrame:
    """docs: text, lang -> lang, rank, phrase, a, l, r, n, score: for each language its ``top`` phrases of 2 to ``most`` words that occur ``least`` times.

    The score is floor(1000 * a * n / (l * r)) at the cut of a phrase that makes it least, the first such cut; l and r are the counts of
    its two parts. Products are decimals of 38 digits: exact while 1000 * a, n, l and r have at most 18 digits. Order: score and a descending, then bytes of the phrase.

    Null texts and texts without words hold nothing; a null language is ``und`` and joins rows that say so; rows count as often as they
    stand in the table, repeated ones too; other columns are never read. No phrase as frequent: no rows."""
    exact, totals = frequent_phrases(docs, least, most)
    phrases = exact.where("size > 1")
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    known = lambda name, count: exact.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    scored = cuts.join(known("head", "l"), ["lang", "head"]).join(known("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    wide = lambda c: c.cast("decimal(19,0)")
    # No product has more than 38 digits in its type, so that none is rounded.
    exactly = F.call_function("div", wide(1000 * F.col("a")) * wide(F.col("n")), wide(F.col("l")) * wide(F.col("r")))
    scored = scored.withColumn("score", exactly)
    least_cut = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    left = least_cut.join(subsumed(phrases, share), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
