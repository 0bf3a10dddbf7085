"""Source divergence audit: how far the words of a language's sources are from each other, and which terms set a source apart.

Document frequencies are first overestimated by merged count-min sketches (``count_min``): a slice sends how many of its documents hold
each term. A term that enough documents hold has hot cells in every row, so it survives in every slice; the others, most of the
vocabulary, are discarded before anything is shuffled. Survivors are counted exactly by (lang, source, term), and their exact document
frequency decides what is kept: a slice sends its survivors packed, each to the block of its hash, where all of a term's counts meet. Sources
meet in a sparse join, over the terms that both hold; what a term held by one of them or by neither adds is the same for all terms of equal
count, and is added up from histograms of counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import cut
from memlake.llm.count_min import SENT, answers, blocks_for, by_slice, hot_cells, may_reach, sketch
from memlake.llm.slices import gathered, hashes, kinds, mix, numbered, rows_of, slices, strings, text_seeds, tokens

#: Everything but letters A-Z, a-z and what lies beyond ASCII parts terms.
_KINDS = kinds(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Cells of the sketch for a byte of text. A document holds fewer distinct terms than a quarter of its bytes, so that a cell gets
#: less than half an item, well below small thresholds.
CELLS = 0.5
BILLION = 1_000_000_000
#: Bytes of a slice, and of the text whose terms meet in one block.
SLICE, PART = 4 << 20, 24 << 20


def _terms(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts, ends and documents of a slice's terms; place of the first and number of each distinct (lang, term); their keys."""
    data = row["text"]
    starts, ends = tokens(data, _KINDS)
    doc = np.searchsorted(row["ends"], starts, "right")
    langs, lang = np.unique(np.asarray(row["lang"], dtype=object), return_inverse=True)
    one, two = (mix(hashes(data, starts, ends, seed) ^ text_seeds(pa.array(langs, pa.string()), seed)[lang[doc]]) for seed in (3, 4))
    first, number = numbered(one, two)
    return data, starts, ends, doc, first, number, one[first]


def _distinct(number: np.ndarray, other: np.ndarray, kinds_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers, and how often each occurs."""
    pairs, counts = np.unique(number.astype(np.int64) * kinds_ + other, return_counts=True)
    return pairs // kinds_, pairs % kinds_, counts


def _partial(blocks: int, least: int):
    """First reading: the document frequencies of a slice's terms, for the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            *_, doc, first, number, keys = _terms(row)
            term, _, _ = _distinct(number, doc, len(row["ends"]))
            yield from sketch(row["slice"], keys, np.bincount(term, minlength=len(first)), blocks, least)

    return run


def _survivors(blocks: int, parts: int):
    """Second reading: occurrences and documents of the surviving terms for each source of the slice, packed for each of ``parts`` blocks of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            data, starts, ends, doc, first, number, keys = _terms(row)
            alive = may_reach(keys, hot_cells(row["hot"], keys, blocks), blocks)
            number, doc = np.where(alive, np.cumsum(alive) - 1, -1)[number], doc[: len(number)]
            first, keys, number, doc = first[alive], keys[alive], number[number >= 0], doc[number >= 0]
            if not len(first):
                continue
            (langs, lang), (sources, source) = (np.unique(np.asarray(row[c], dtype=object), return_inverse=True) for c in ("lang", "source"))
            term, group, n = _distinct(number, source[doc], len(sources))
            once, at, _ = _distinct(number, doc, len(row["ends"]))
            _, _, df = _distinct(once, source[at], len(sources))
            own_lang = lang[np.searchsorted(row["ends"], starts[first], "right")]
            part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)]
            spans = [(a, b, *np.searchsorted(term, [a, b]).tolist()) for a, b in zip(bounds, bounds[1:], strict=False)]
            packed = []
            for a, b, i, j in spans:
                spelt, _ = gathered(data, starts[first[a:b]], ends[first[a:b]])
                planes = (own_lang[a:b], ends[first[a:b]] - starts[first[a:b]], np.bincount(term[i:j] - a, minlength=b - a), group[i:j], n[i:j], df[i:j])
                raw = b"".join(x.astype(np.uint32).tobytes() for x in planes) + spelt.tobytes()
                packed.append((int(part[a]), b - a, j - i, len(raw), pa.compress(raw, codec="zstd", asbytes=True)))
            names = [pa.array([list(x)] * len(spans), pa.list_(pa.string())) for x in (langs, sources)]
            yield pa.RecordBatch.from_arrays([*names, *[pa.array(c, f.type) for c, f in zip(zip(*packed, strict=True), list(_PACKED)[2:], strict=True)]], schema=_PACKED)

    return run


_PACKED = pa.schema([("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("part", pa.int64()), ("terms", pa.int32()), ("pairs", pa.int32()), ("size", pa.int64()), ("data", pa.binary())])
_COUNTS = pa.schema([("tid", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("first", pa.int64())])


def _merged(least: int):
    """All counts of a block of terms: those of terms held by ``least`` documents of their language, with the language's total. ``tid``
    numbers a language's term, ``first`` is 1 on one row of each."""

    def run(group: pa.Table) -> pa.Table:
        langs, sources, columns = {}, {}, []
        for row in group.to_pylist():
            raw = pa.decompress(row["data"], row["size"], codec="zstd", asbytes=True)
            t, p = row["terms"], row["pairs"]
            lang, lens, many, source, n, df = (np.frombuffer(raw, np.uint32, k, 4 * o) for k, o in ((t, 0), (t, t), (t, 2 * t), (p, 3 * t), (p, 3 * t + p), (p, 3 * t + 2 * p)))
            ends = np.cumsum(lens, dtype=np.int64)
            spelt = strings(np.frombuffer(raw, np.uint8, offset=4 * (3 * t + 3 * p)), ends - lens, ends)
            known = lambda names, found: np.array([found.setdefault(x, len(found)) for x in names], np.int64)
            columns.append((spelt, known(row["langs"], langs)[lang], many.astype(np.int64), known(row["sources"], sources)[source], n.astype(np.int64), df.astype(np.int64)))
        spelt = pa.chunked_array([x[0] for x in columns]).combine_chunks().dictionary_encode()
        lang, many, source, n, df = (np.concatenate([x[i] for x in columns]) for i in range(1, 6))
        keys, code = np.unique(spelt.indices.to_numpy() * len(langs) + lang, return_inverse=True)
        pairs, at = np.unique(np.repeat(code, many) * len(sources) + source, return_inverse=True)
        sums = [np.zeros(len(pairs), np.int64) for _ in range(2)]
        for total, x in zip(sums, (n, df), strict=True):
            np.add.at(total, at, x)
        key = pairs // len(sources)
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        total, held = (np.add.reduceat(x, begin)[key] for x in sums)
        keep = held >= least
        opens = np.zeros(len(pairs), np.int64)
        opens[begin] = 1
        name = lambda found, codes: pa.array(list(found), pa.string()).take(pa.array(codes))
        part = group.column("part")[0].as_py() << 32
        out = [pa.array(part + key[keep]), name(langs, (keys % len(langs))[key[keep]]), name(sources, (pairs % len(sources))[keep]), spelt.dictionary.take(pa.array((keys // len(langs))[key[keep]])), pa.array(sums[0][keep]), pa.array(total[keep]), pa.array(opens[keep])]
        return pa.Table.from_arrays(out, schema=_COUNTS)

    return run


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / (total + vocabulary)), exact; by decimals where 64 bits would not do."""
    below = F.greatest(total + vocabulary, F.lit(1))
    wide = _div((count + 1).cast("decimal(20,0)") * F.lit(BILLION).cast("decimal(10,0)"), below.cast("decimal(20,0)"))
    return F.when(count < BILLION, _div((count + 1) * F.lit(BILLION).cast("long"), below)).otherwise(wide) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q), exact: shares stay below 2 * 10**9."""
    return _div((p - q) * (p - q), q)


def term_counts(docs: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """docs: text, lang, source -> exact counts (tid, lang, source, term, n, total, first) of the terms that ``least_docs`` documents of their
    language hold, total being the language's count; and all groups (lang, source)."""
    parts = slices(docs, SLICE, lang=F.coalesce("lang", F.lit("")), source=F.coalesce("source", F.lit("")))
    size = parts.agg(F.coalesce(F.sum(F.element_at("ends", -1).cast("long")), F.lit(0))).first()[0]
    blocks = blocks_for(size, CELLS)
    asked = by_slice(answers(parts.mapInArrow(_partial(blocks, least_docs), SENT), least_docs))
    packed = parts.join(asked.hint("shuffle_hash"), "slice", "left").mapInArrow(_survivors(blocks, size // PART + 1), "langs array<string>, sources array<string>, part long, terms int, pairs int, size long, data binary")
    counts = packed.groupBy("part").applyInArrow(_merged(least_docs), "tid long, lang string, source string, term string, n long, total long, first long")
    groups = parts.select(F.explode(F.arrays_zip("lang", "source")).alias("g")).select("g.*").distinct()
    return cut(counts), groups


def _pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """terms: tid, gid, p, z; groups: gid, lang, source, own, v, z -> lang, source, item, value for all ordered pairs of a language's sources.

    z is the share of a term that a group lacks, own the number of terms that it has. The sum over all terms is taken as if no term
    were shared, from histograms, and the sparse join of shared terms puts right what that gets wrong."""
    side = lambda end, *more: groups.select("lang", F.col("gid").alias(end), *[F.col(c).alias(c + end) for c in more])
    both = side("a", "own", "z", "v").join(side("b", "own", "z"), "lang").where("a <> b")
    lacking = both.select("a", "b", ((F.col("va") - F.col("owna") - F.col("ownb")) * apart(F.col("za"), F.col("zb"))).alias("value"))
    held = terms.groupBy(F.col("gid").alias("a"), "p").agg(F.count("*").alias("m")).join(side("a"), "a").join(side("b", "z"), "lang").where("a <> b")
    alone = held.groupBy("a", "b").agg(F.sum(F.col("m") * apart(F.col("p"), F.col("zb"))).alias("there"), F.sum(F.col("m") * apart(F.col("zb"), F.col("p"))).alias("back"))
    end = lambda x: terms.select("tid", F.col("gid").alias(x), F.col("p").alias("p" + x), F.col("z").alias("z" + x))
    shared = end("a").join(end("b"), "tid").where("a < b")
    over = lambda p, z, q, w: apart(F.col(p), F.col(q)) - apart(F.col(p), F.col(w)) - apart(F.col(z), F.col(q)) + apart(F.col(z), F.col(w))
    righted = shared.groupBy("a", "b").agg(F.sum(over("pa", "za", "pb", "zb")).alias("there"), F.sum(over("pb", "zb", "pa", "za")).alias("back"))
    for sums in (alone, righted):
        ways = F.array(F.struct("a", "b", F.col("there").alias("value")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("value")))
        lacking = lacking.union(sums.select(F.explode(ways).alias("w")).select("w.*"))
    name = lambda x, c: groups.select(F.col("gid").alias(x), *(["lang"] if x == "a" else []), F.col("source").alias(c))
    return lacking.groupBy("a", "b").agg(F.sum("value").alias("value")).join(name("a", "source"), "a").join(name("b", "item"), "b").select("lang", "source", "item", "value")


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """docs: text, lang, source -> lang, source, part, item, value, rank, for every (lang, source) that occurs.

    A language keeps the terms that ``least_docs`` of its documents hold; N is a group's count of kept terms, V their number, and a term's share
    1 + floor(10**9 * (count + 1) / (N + V)). Part ``pair``: every other source of the language with floor((p - q)**2 / q) summed over all
    kept terms, p the group's share and q the other's. Part ``term``: kept terms that the group holds and whose share is above the
    language's, with the same measure against the language's share, down to rank ``top``. Ranks go by value descending, then by bytes.

    Nulls in text, lang and source are read as empty; rows count as often as they stand in the table; other columns are never read. A
    group without kept terms has its pairs, and they are 0 where the language keeps none; a source alone in its language has no pairs."""
    terms, groups = term_counts(docs, least_docs)
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"), F.sum("first").alias("firsts"))
    all_terms = own.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("v"))
    groups = groups.join(own.drop("firsts"), ["lang", "source"], "left").join(all_terms, "lang", "left").na.fill(0, ["total", "own", "lang_total", "v"])
    groups = cut(groups.select("*", share(F.lit(0), F.col("total"), F.col("v")).alias("z"), F.monotonically_increasing_id().alias("gid")))
    facts = terms.join(groups.select("lang", "source", "gid", F.col("total").alias("mine"), "lang_total", "v", "z"), ["lang", "source"])
    facts = facts.select("tid", "gid", "lang", "source", "term", share(F.col("n"), F.col("mine"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_total"), F.col("v")).alias("q"), "z")
    above = facts.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    others = _pairs(facts, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(above).where(F.col("rank") <= top).union(ranked(others))
