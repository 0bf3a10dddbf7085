"""Language-model scores by prediction by partial matching over bytes, beside a smoothed unigram score.

The model is a trie of byte contexts of up to ``ORDER`` bytes, nearest byte first, counted over all training texts. A symbol is looked up
below the longest context that the trie holds. Where it is not there, the code pays an escape and goes on below the context without its
furthest byte, with the symbols excluded that the longer context has seen. An escape weighs as many as the context has symbols (method
C). What follows a context holds everything that follows a longer one, so the exclusion below a context depends on that context alone:
escapes and denominators are numbers of the trie's nodes, and texts are scored by lookups of their distinct n-grams, in numpy.

Every executor holds the contexts that occur most. Where those are not all, the n-grams below the other contexts are scored once in groups
that share the nearest two bytes, each with all its contexts, and slices ask for those that they hold: a bound on what is held drops nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import cut
from memlake.llm.slices import hashes, kinds, mix, numbered, rows_of, slices, tokens
from memlake.llm.totals import ASKED, answered, ask, totals_of

#: Bytes of the longest context, and the symbol that stands before and after a text; no UTF-8 text holds it.
ORDER, EDGE = 4, 0xFF
#: Most n-grams in the trie that every executor holds: 16 bytes for each and 40 for a context, under 120 MB in all.
NODES = 1 << 21
#: N-grams that are scored together where that trie is not whole (or those of one pair of bytes, if they are more).
GROUP = 1 << 18
LEFT = "slice long, block long, grams binary, lps binary"
_LEFT = pa.schema([("slice", pa.int64()), ("block", pa.int64()), ("grams", pa.binary()), ("lps", pa.binary())])
SLICE, HELD = 2 << 20, 10
_KINDS = kinds(b" \t\n\x0b\x0c\r")


def grams(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each byte of the texts, and for each text's end: its context, nearest byte in the highest place, and the symbol in the lowest byte.
    A text's line feed at the end is read as EDGE, and what precedes a text is EDGE."""
    data = data.copy()
    data[ends - 1] = EDGE
    starts = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts)
    key = data.astype(np.uint64)
    for back in range(1, ORDER + 1):
        before = np.full(len(data), EDGE, np.uint8)
        before[back:] = data[:-back]
        before[place < back] = EDGE
        key |= before.astype(np.uint64) << np.uint64(8 * (ORDER + 1 - back))
    return key


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def _place(ordered: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The place of each value in an ordered list, -1 if it is not there."""
    if not len(ordered):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(ordered, asked), len(ordered) - 1)
    return np.where(ordered[at] == asked, at, -1)


@dataclass
class Level:
    """Contexts of one length and the n-grams below them; logarithms to base 10."""

    contexts: np.ndarray
    whole: np.ndarray  # denominator of a context where a lookup begins
    escape: np.ndarray  # its escape
    below: np.ndarray  # denominator of the next shorter context without this one's symbols
    below_escape: np.ndarray
    grams: np.ndarray
    counts: np.ndarray


def levels(counted: list[tuple[np.ndarray, np.ndarray]]) -> list[Level]:
    """counted: for each length of context, n-grams in order and their counts; every n-gram of a context that is there, and all shorter ones."""
    out, shorter = [], None
    with np.errstate(divide="ignore"):
        for order, (found, n) in enumerate(counted):
            context = found >> np.uint64(8)
            first = runs(context)
            q, total = np.diff(first, append=len(found)), np.add.reduceat(n, first) if len(found) else n
            below, below_escape = np.zeros(len(first)), np.zeros(len(first))
            if order:
                # The same symbols below the context without its furthest byte.
                short = (context[first] >> np.uint64(8))
                again = counted[order - 1][1][_place(counted[order - 1][0], (context >> np.uint64(8) << np.uint64(8)) | (found & np.uint64(255)))]
                at = _place(shorter[0], short)
                left, symbols = shorter[1][at] - np.add.reduceat(again, first) if len(found) else n, shorter[2][at] - q
                below = np.where(symbols > 0, np.log10(np.maximum(left + symbols, 1)), 0.0)
                below_escape = np.where(symbols > 0, np.log10(np.maximum(symbols, 1)) - below, 0.0)
            whole = np.log10(total + q)
            out.append(Level(context[first], whole, np.log10(q) - whole, below, below_escape, found, np.log10(n)))
            shorter = (context[first], total, q)
    return out


def code(trie: list[Level], keys: np.ndarray) -> np.ndarray:
    """log10 probability of the symbol of each n-gram (as ``grams`` makes them, in order, so that lookups run through the trie once)."""
    lp, left = np.zeros(len(keys)), np.arange(len(keys))
    longer = np.full(len(keys), -1)
    for order in range(ORDER, -1, -1):
        level = trie[order]
        context = keys[left] >> np.uint64(8 * (ORDER + 1 - order))
        node = _place(level.contexts, context)
        gram = _place(level.grams, (context << np.uint64(8)) | (keys[left] & np.uint64(255)))
        begun, here = longer >= 0, node >= 0
        above = trie[order + 1] if order < ORDER else level
        if len(level.contexts):
            bottom, escape = level.whole[node], level.escape[node]
            if len(above.contexts):
                bottom, escape = np.where(begun, above.below[longer], bottom), np.where(begun, above.below_escape[longer], escape)
            lp[left] += np.where(gram >= 0, level.counts[gram] - bottom, np.where(here, escape, 0.0))
        keep = gram < 0
        left, longer = left[keep], np.where(here, node, longer)[keep]
    unseen = 256 - len(trie[0].grams)
    lp[left] -= np.log10(max(unseen, 1))
    return lp


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of all texts with their counts in training texts, added up over a task's slices while they are few."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def added() -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        order = np.argsort(keys)
        first = runs(keys[order])
        return keys[order][first], np.add.reduceat(counts[order], first)

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["gram", "n"])

    for row in rows_of(batches):
        ends = row["ends"]
        learnt = np.repeat(~np.asarray(row["held_out"]), np.diff(ends, prepend=0))
        marked = np.sort(grams(row["text"], ends) << np.uint64(1) | learnt)
        keys = marked >> np.uint64(1)
        first = runs(keys)
        held.append((keys[first], np.add.reduceat((marked & np.uint64(1)).astype(np.int64), first)))
        if sum(len(x[0]) for x in held) > 1 << 21:
            held = [added()]
            if len(held[0][0]) > 1 << 20:
                yield rows(*held.pop())
    if held:
        yield rows(*added())


def counted_grams(parts: DataFrame) -> DataFrame:
    """gram, n: every n-gram that occurs, and how often in training texts (0: only elsewhere)."""
    return cut(parts.select("text", "ends", "held_out").mapInArrow(_train, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))


def _by_order(rows: DataFrame, orders: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """rows: order, context, symbol, n -> for each length of context its n-grams in order and their counts."""
    flat = rows.select("order", F.shiftleft("context", 8).bitwiseOR(F.col("symbol")).alias("gram"), "n").toArrow()
    order, gram, n = (flat.column(c).to_numpy() for c in ("order", "gram", "n"))
    place = np.lexsort([gram, order])
    order, gram, n = order[place], gram[place].astype(np.uint64), n[place].astype(np.int64)
    bounds = np.searchsorted(order, np.arange(orders + 1))
    return [(gram[a:b], n[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def _frequent(counted: DataFrame, nodes: int) -> tuple[list[Level], list[tuple[np.ndarray, np.ndarray]] | None]:
    """The trie of the contexts that occur most, with all their symbols, as many as ``nodes`` allows; a context's shorter ones occur more often,
    so they are kept before it. Beside it all n-grams below contexts of no and one byte, 65,792 at most, if any context is left out."""
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("order"), F.shiftright("gram", 8 * (ORDER + 1 - o)).alias("context"), (F.col("gram").bitwiseAND(255)).alias("symbol")) for o in range(ORDER + 1)]))
    below = cut(counted.where("n > 0").select(each.alias("x"), "n").groupBy("x.order", "x.context", "x.symbol").agg(F.sum("n").alias("n")))
    contexts = below.groupBy("order", "context").agg(F.sum("n").alias("total"), F.count("*").alias("q"))
    step = F.floor(8 * F.log2(F.col("total").cast("double"))).cast("int")
    sizes = sorted(contexts.groupBy(step.alias("step")).agg(F.sum("q").alias("q")).collect(), reverse=True)
    kept, least = 0, None
    for at, q in sizes:
        if kept + q > nodes:
            least = at + 1
            break
        kept += q
    if least is None:
        return levels(_by_order(below, ORDER + 1)), None
    frequent = below.join(contexts.where(step >= least).select("order", "context"), ["order", "context"], "left_semi")
    return levels(_by_order(frequent, ORDER + 1)), _by_order(below.where("order < 2"), 2)


def train(parts: DataFrame, nodes: int = NODES) -> list[Level]:
    """The trie of the training texts of ``parts`` that every executor holds. Counts cover all texts."""
    return _frequent(counted_grams(parts), nodes)[0]


def _held(trie: list[Level], keys: np.ndarray) -> np.ndarray:
    """Of n-grams, which ones the trie scores as if it held every context: those whose longest context is there, and with it all shorter ones."""
    return _place(trie[ORDER].contexts, keys >> np.uint64(8)) >= 0


def _shortened(keys: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams with contexts of ``order`` bytes, and their counts."""
    short = keys >> np.uint64(8 * (ORDER + 1 - order)) << np.uint64(8) | (keys & np.uint64(255))
    place = np.argsort(short)
    first = runs(short[place])
    return short[place][first], np.add.reduceat(n[place], first) if len(first) else n


def _blocks(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of n-grams by blocks of hash values, in order within a block, and each block with where it begins and ends."""
    block = ((mix(keys) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    if not len(keys):
        return order, []
    first = runs(block[order])
    return order, [(int(block[order[a]]), int(a), int(b)) for a, b in zip(first, np.append(first[1:], len(keys)), strict=True)]


def _sent(name: int, keys: np.ndarray, blocks: int, lps: np.ndarray | None = None) -> pa.RecordBatch:
    """Distinct n-grams in order, by block, as differences, which pack well; with their scores, or asking for them."""
    order, spans = _blocks(keys, blocks)
    packed = [np.diff(keys[order[a:b]], prepend=np.uint64(0)).tobytes() for _, a, b in spans]
    scores = [None if lps is None else lps[order[a:b]].tobytes() for _, a, b in spans]
    return pa.RecordBatch.from_arrays([pa.array([name] * len(spans), pa.int64()), pa.array([x[0] for x in spans], pa.int64()), pa.array(packed, pa.binary()), pa.array(scores, pa.binary())], schema=_LEFT)


def _left_out(counted: DataFrame, trie, top, blocks: int) -> DataFrame:
    """Scores of the n-grams that the trie does not hold, by block. Groups share the nearest two bytes of their contexts, so that they hold all
    longer contexts that a lookup meets, and a group has 256 ** 3 n-grams at most, whatever the corpus; shorter contexts are in ``top``."""

    def run(group: pa.Table) -> pa.Table:
        keys, n = group.column("gram").to_numpy().astype(np.uint64), group.column("n").to_numpy()
        place = np.argsort(keys)
        keys, n = keys[place], n[place]
        learnt = n > 0
        own = levels([*top.value, *[_shortened(keys[learnt], n[learnt], o) for o in range(2, ORDER + 1)]])
        keys = keys[~_held(trie.value, keys)]
        return pa.Table.from_batches([_sent(-1, keys, blocks, code(own, keys))], _LEFT)

    groups = counted.count() // GROUP + 1
    pair = F.shiftright("gram", 8 * (ORDER - 1))
    return counted.groupBy(F.pmod(F.xxhash64(pair), F.lit(groups)).alias("group")).applyInArrow(run, LEFT)


def _answers(group: pa.Table) -> pa.Table:
    """One block: the scores that each slice asks for, in the order in which it asks."""
    unpacked = lambda x: np.cumsum(np.frombuffer(x, np.uint64), dtype=np.uint64)
    rows = group.to_pylist()
    known = [(unpacked(x["grams"]), np.frombuffer(x["lps"], np.float64)) for x in rows if x["slice"] < 0]
    keys, lps = (np.concatenate(x) for x in zip(*known, strict=True))
    place = np.argsort(keys)
    keys, lps = keys[place], lps[place]
    asked = [x for x in rows if x["slice"] >= 0]
    told = [lps[np.searchsorted(keys, unpacked(x["grams"]))].tobytes() for x in asked]
    return pa.table([pa.array([x["slice"] for x in asked], pa.int64()), pa.array([x["block"] for x in asked], pa.int64()), pa.array(told, pa.binary())], ["slice", "block", "lps"])


def _asked_left(trie, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            keys = np.sort(grams(row["text"], row["ends"]))
            keys = keys[runs(keys)]
            yield _sent(row["slice"], keys[~_held(trie.value, keys)], blocks)

    return run


def _words(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document of each word; number of each word; and the two hashes of each number; bytes, folded."""
    data = row["text"]
    starts, ends = tokens(data, _KINDS)
    doc = np.searchsorted(row["ends"], starts, "right")
    one, two = hashes(data, starts, ends, 5), hashes(data, starts, ends, 6) & np.uint64(0xFFFFFFFF)
    first, number = numbered(one, two)
    return doc, number, one[first], two[first], data


def _asked(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            doc, number, one, two, _ = _words(row)
            learnt = ~np.asarray(row["held_out"])
            yield from ask(row["slice"], one, two, np.bincount(number[learnt[doc]], minlength=len(one)), blocks)

    return run


def _scored(trie, blocks: int | None, learnt: int, words: int, distinct: int):
    """trie: a broadcast of levels; blocks: how many answer for what it leaves out, if anything; learnt: training texts; words and distinct:
    their words, counted all and once."""
    tokens_, kinds_ = words + learnt, distinct + (learnt > 0)
    base = lambda c: np.log10((c + 0.1) / (tokens_ + 0.1 * (kinds_ + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            doc, number, _, _, data = _words(row)
            ends, count = row["ends"], len(row["ends"])
            per = lambda weights: np.bincount(doc, weights=weights, minlength=count)
            c = totals_of(row["answer"])[number]
            packed = np.sort((grams(data, ends) << np.uint64(24)) | np.repeat(np.arange(count, dtype=np.uint64), np.diff(ends, prepend=0)))
            keys, owner = packed >> np.uint64(24), (packed & np.uint64((1 << 24) - 1)).astype(np.int64)
            first = runs(keys)
            once = code(trie.value, keys[first])
            if blocks is not None:
                left = np.flatnonzero(~_held(trie.value, keys[first]))
                told = [np.frombuffer(x["lps"], np.float64) for x in sorted(row["told"] or [], key=lambda x: x["block"])]
                once[left[_blocks(keys[first][left], blocks)[0]]] = np.concatenate([np.zeros(0), *told])
            lp = np.repeat(once, np.diff(first, append=len(keys)))
            known = per((c > 0).astype(float)).astype(np.int64) + (learnt > 0)
            columns = [pa.array(row["id"], pa.int64()), pa.array(row["held_out"]), pa.array(np.bincount(doc, minlength=count) + 1), pa.array(known), pa.array(np.full(count, tokens_)), pa.array(per(base(c)) + base(learnt)), pa.array(np.bincount(owner, weights=lp, minlength=count))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def partial_matching(docs: DataFrame, nodes: int = NODES) -> DataFrame:
    """docs: doc_id, text -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row for each document.

    Documents whose crc32 of the id as text is a multiple of 10 are held out; all others are learnt from. Texts are read whole, with A-Z
    lower-cased. ``base_score`` is the log10 probability of the words and the end under smoothed counts of the training words, and ``score``
    that of the bytes and the end under partial matching with what the training texts taught (a training text is scored by a model
    that has seen it). The counts that ``base_score`` needs come by request from blocks of words (``totals``), whatever their number.
    ``nodes`` bounds the n-grams that every executor holds, those of the most frequent contexts; scores below all other contexts come by
    request, so that it changes no score.

    A null text is read as empty, and its score is that of the end alone; a null id stays null and is held out; rows that repeat are
    each scored and each learnt from; other columns are never read. Without training texts every byte has the probability 1/256. No documents:
    no rows."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % HELD == 0
    parts = slices(docs, SLICE, id=F.col("doc_id").cast("long"), held_out=held)
    sums = parts.agg(F.coalesce(F.sum(F.element_at("ends", -1).cast("long")), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("held_out", lambda h: ~h))), F.lit(0))).first()
    blocks = sums[0] // (16 << 20) + 1
    answer = cut(answered(parts.select("slice", "text", "ends", "held_out").mapInArrow(_asked(blocks), ASKED)))
    words = answer.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    counted = counted_grams(parts)
    frequent, top = _frequent(counted, nodes)
    sent = parts.sparkSession.sparkContext.broadcast
    trie = sent(frequent)
    each = answer.groupBy("slice").agg(F.collect_list(F.struct("block", "totals")).alias("answer"))
    both = parts.join(each.hint("shuffle_hash"), "slice", "left")
    if top is not None:
        asked = parts.select("slice", "text", "ends").mapInArrow(_asked_left(trie, blocks), LEFT)
        told = _left_out(counted, trie, sent(top), blocks).union(asked).groupBy("block").applyInArrow(_answers, "slice long, block long, lps binary")
        both = both.join(told.groupBy("slice").agg(F.collect_list(F.struct("block", "lps")).alias("told")).hint("shuffle_hash"), "slice", "left")
    return both.mapInArrow(_scored(trie, None if top is None else blocks, sums[1], words[0], words[1]), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
