"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from the base patterns (matches that fail a check are kept as negative evidence) and from looser patterns
(spelt-out mail addresses, addresses of eight groups, masked and dotted cards, national and grouped phone numbers). Four labelers vote on each: the pattern's own checks, gazetteers (top-level
domains, calling codes, issuer digits, address ranges), the words around it, and its borders; a vote is 1, -1 or 0 (abstains).
The number of candidates with each pattern of votes is counted over all documents (at most 4 kinds x 2 x 81 rows);
expectation-maximisation on that table estimates each labeler's reliability and each pattern's probability, and a logistic
classifier of single candidates is trained on those probabilities. Base matches are anchors: what their check says is held while the
reliabilities of the other labelers are learnt, so that these explain labelers and not kinds; an abstaining labeler says nothing. Base spans
that pass their checks always stay; other candidates are added if the classifier accepts them, two labelers at least speak for them (one
of them the gazetteer or the context), none of the checks speaks against them, and no span is overlapped.

Everything else happens in the row of the text: its candidates are found once and written, fitting and selecting read them. Positions
are code points, end exclusive. Matches are found by splitting the text at the pattern: the lengths of the pieces give the positions. Defined results: null and empty texts have no spans; repeated
rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import cut, let

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. Possessive forms and the look-behind change no match; they keep the search linear.
BASE_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns, no part of the base.
LOOSE_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[(](?:at|AT)[\])] ?| (?:at|AT) )[A-Za-z0-9-]++(?:(?: ?[\[(](?:dot|DOT)[\])] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z*.-])(?:(?:[*xX]{4}[\x20-]?){2,3}[0-9]{4}|[0-9]{4}(?:\.[0-9]{4}){3})(?![0-9A-Za-z*]|[.-][0-9A-Za-z*])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[.-][0-9]{4}|0[0-9]{1,4}[\x20/-][0-9]{2,4}(?:[\x20-][0-9]{2,4}){1,3})(?![0-9A-Za-z-])",
}
#: Gazetteers and context words.
TOP_LEVEL = "com|org|net|edu|gov|info|biz|io|co|de|fr|es|it|uk|us|eu|ch|at|nl|be|pl|se|no|dk|fi|pt|ie|ca|au|jp|cn|in|br|mx|ru"
CALLING = "1|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|52|55|61|62|64|65|81|82|86|90|91|351|352|353|358|420|421"
FOR = {"email": "mail|e-mail|email|contact|write|reach", "ip": "ip|host|server|address|addr|login|from", "card": "card|visa|mastercard|amex|credit|debit|pay|payment", "phone": "phone|tel|telephone|call|fax|mobile|cell|contact"}
AGAINST = "version|ver|v|isbn|issn|order|invoice|sku|part|section|sec|fig|figure|page|chapter|build|release|no"

LABELERS = ("check", "gazetteer", "context", "border")
AROUND = 24
ACCEPT = 0.5


#: Elements folded at once by ``running``, code points of a piece of text in ``redact``.
FOLD, PIECE = 64, 1024


def running(values: Column, start: int, step) -> Column:
    """For each element of an array of integers, ``step`` folded over all elements before it. Folds of FOLD elements, then of their
    results, keep the work proportional to the number of elements."""
    empty = F.array().cast("array<int>")

    def fold(part: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), empty.alias("out"))
        return F.aggregate(part, begin, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def blocks(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(FOLD)), lambda b: F.slice(v, b + 1, F.lit(FOLD)))
        return let(parts, lambda p: F.flatten(F.zip_with(p, fold(F.transform(p, lambda x: F.aggregate(x, F.lit(start), lambda a, b: step(a, b))), F.lit(start)), fold)))

    return let(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(empty))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _found(text: Column, pattern: str) -> Column:
    """Structs (start, end, match, before, after) of the matches of ``pattern``; the pieces between them give the positions."""

    def place(hits: Column) -> Column:
        def each(p: Column) -> Column:
            gap = lambda i: F.get(p["gaps"], i)
            lengths = F.transform(hits, lambda m, i: F.length(m) + F.length(gap(i)))

            def one(starts: Column) -> Column:
                return F.transform(
                    hits,
                    lambda m, i: F.struct(
                        (F.get(starts, i) + F.length(gap(i))).alias("start"),
                        (F.get(starts, i) + F.length(gap(i)) + F.length(m)).alias("end"),
                        m.alias("match"),
                        F.substring(gap(i), -AROUND, AROUND).alias("before"),
                        F.substring(gap(i + 1), 1, AROUND).alias("after"),
                    ),
                )

            return let(running(lengths, 0, _add), one)

        return F.when(F.size(hits) > 0, let(F.struct(F.split(text, pattern, -1).alias("gaps")), each))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), value)
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    """The check of a base match."""
    n = F.length(_digits(m))
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: ~p.rlike("^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?$"))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(m))).otherwise(False)
    return ((n >= 9) & (n <= 15)) if kind == "phone" else F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _candidates(kind: str, base: bool, found: Column) -> Column:
    """Structs (kind, base, start, end, votes) of one pattern's matches. base: passes as a base span."""

    def judge(x: Column) -> Column:
        m, before, after = x["match"], F.lower(x["before"]), F.lower(x["after"])
        passed = _passes(kind, m) if base else F.lit(False)
        check = F.when(passed, 1).otherwise(-1) if base else F.lit(0)
        if kind == "email":
            tail = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)\W*$", 1))
            gazetteer = _vote(tail.rlike(f"^(?:{TOP_LEVEL})$"), ~tail.rlike("[a-z]"))
        elif kind == "ip" and not base:
            gazetteer = _vote(m.rlike("^[23fF]"), m.rlike("^0+:"))
        elif kind == "card" and not base:
            gazetteer = _vote(m.rlike("^[*xX]") | (_digits(m).rlike("^[3-6]|^2[2-7]") & _luhn(_digits(m))), ~m.rlike("^[*xX]") & ~_luhn(_digits(m)))
        elif kind == "phone" and not base:
            gazetteer = _vote(m.rlike(r"^\(?[2-9][0-8][0-9]\)?[\x20.-][2-9]") | F.length(_digits(m)).between(9, 12), F.length(_digits(m)) < 8)
        elif kind == "ip":
            first = F.regexp_extract(m, "^0*([0-9]{1,3})", 1).cast("int")
            gazetteer = _vote(first.between(1, 223), (first == 0) | (first > 223))
        elif kind == "card":
            gazetteer = _vote(_digits(m).rlike("^[3-6]|^2[2-7]"), _digits(m).rlike("^0"))
        else:
            gazetteer = _vote(_digits(m).rlike(f"^(?:{CALLING})"), _digits(m).rlike("^0"))
        word = lambda w: rf"(?:^|[^a-z0-9])(?:{w})[^a-z0-9]{{0,4}}$"
        context = _vote(before.rlike(word(FOR[kind])) | after.rlike(rf"^[^a-z0-9]{{0,3}}(?:{FOR[kind]})(?:[^a-z0-9]|$)"), before.rlike(word(AGAINST)))
        glued = before.rlike("[a-z0-9]$") | after.rlike("^[a-z0-9]")
        border = _vote((before.rlike(r"(?:^|\s|[(\[<:,;\"'])$")) & (after.rlike(r"^(?:$|[\s)\]>,;:.!?\"'])")), glued)
        votes = [v.cast("int").alias(n) for n, v in zip(LABELERS, (check, gazetteer, context, border), strict=True)]
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), passed.alias("base"), F.struct(*votes).alias("votes"))

    return F.transform(found, judge)


CANDIDATES = "array<struct<kind:int,start:int,end:int,base:boolean,votes:struct<check:int,gazetteer:int,context:int,border:int>>>"


def candidates(text: Column) -> Column:
    """All candidates of a text. Write them once (``cut``): fitting and selecting both read them."""
    empty = F.array().cast(CANDIDATES)

    def judged(kind: str, base: bool):
        return lambda found: F.when(found.isNotNull(), _candidates(kind, base, found))

    def each(t: Column) -> Column:
        parts = []
        for base, patterns in ((True, BASE_PATTERNS), (False, LOOSE_PATTERNS)):
            for kind, pattern in patterns.items():
                loose = {"email": r"(?:[\[(\x20](?:at|AT)[\])\x20])", "ip": "(?:[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:)", "card": r"(?:[*xX]{4}|[0-9]{4}\.[0-9]{4}\.)", "phone": r"(?:[0-9][\x20./-][0-9]{2})"}
                cheap = t.rlike(loose[kind]) if not base else {"email": F.instr(t, "@") > 0, "phone": F.instr(t, "+") > 0}.get(kind, F.lit(True))
                parts.append(F.coalesce(F.when(cheap, let(_found(t, pattern), judged(kind, base))), empty))
        return F.concat(*parts)

    return let(F.coalesce(text.cast("string"), F.lit("")), each)


#: What labelers are taken to be before any evidence, in votes: more often right than wrong.
BELIEF = {(1, 1): 4.0, (1, 0): 2.0, (1, -1): 1.0, (0, 1): 1.0, (0, 0): 2.0, (0, -1): 4.0}
#: Probability of an anchor that passes its check, and bounds of the share of personal data among other candidates.
SURE, RARE, COMMON = 0.97, 0.1, 0.5


def expectation_maximisation(table: list[tuple[int, tuple[int, ...], int]], rounds: int = 40) -> tuple[list[float], list[dict[tuple[int, int], float]]]:
    """table: (kind, votes, count). Each row's probability of being personal data, and per labeler the chances of its votes:
    {(truth, vote): chance}. Rows on which the check votes are anchors and keep their probability; the others start from the sum of their votes."""
    anchor = [v[0] != 0 for _, v, _ in table]
    prob = [SURE if v[0] > 0 else 1 - SURE if v[0] < 0 else min(0.9, max(0.1, 0.5 + 0.2 * sum(v[1:]))) for _, v, _ in table]
    rates: list[dict[tuple[int, int], float]] = []
    for _ in range(rounds):
        rates = []
        for j in range(len(LABELERS)):
            mass = dict(BELIEF)
            for (_, votes, n), p in zip(table, prob, strict=True):
                mass[1, votes[j]] += n * p
                mass[0, votes[j]] += n * (1 - p)
            sums = {t: sum(mass[t, v] for v in (-1, 0, 1)) for t in (0, 1)}
            rates.append({k: m / sums[k[0]] for k, m in mass.items()})
        own = [(n, p) for (_, _, n), p, held in zip(table, prob, anchor, strict=True) if not held]
        prior = min(COMMON, max(RARE, (sum(n * p for n, p in own) + 1) / (sum(n for n, _ in own) + 2)))
        for i, (_, votes, _) in enumerate(table):
            if not anchor[i]:
                odds = math.log(prior / (1 - prior)) + sum(math.log(r[1, v] / r[0, v]) for r, v in zip(rates, votes, strict=True) if v)
                prob[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prob, rates


def _features(votes: tuple[int, ...]) -> list[float]:
    return [1.0, *[float(v == s) for v in votes for s in (-1, 1)]]


def train(table: list[tuple[int, tuple[int, ...], int]], prob: list[float], rounds: int = 300) -> list[float]:
    """Logistic weights of the span classifier, fitted to the patterns' probabilities weighted by log counts."""
    x = [_features(v) for _, v, _ in table]
    c = [math.log(n + 1) for _, _, n in table]
    w = [0.0] * (1 + 2 * len(LABELERS))
    for _ in range(rounds):
        grad = [0.05 * v for v in w]
        for xi, ci, pi in zip(x, c, prob, strict=True):
            e = ci * (1 / (1 + math.exp(-sum(a * b for a, b in zip(w, xi, strict=True)))) - pi)
            for j, v in enumerate(xi):
                grad[j] += e * v
        w = [a - 0.5 * g / (sum(c) + 1) * 4 for a, g in zip(w, grad, strict=True)]
    return w


def fit(rows: DataFrame) -> list[float]:
    """Classifier weights learnt from the votes over all of ``rows``, which hold a column ``candidates``."""
    found = rows.select(F.explode("candidates").alias("c"))
    counted = found.groupBy("c.kind", *[F.col(f"c.votes.{n}") for n in LABELERS]).count().collect()
    table = sorted((r.kind, tuple(r[n] for n in LABELERS), r["count"]) for r in counted)
    return train(table, expectation_maximisation(table)[0]) if table else [-1.0] + [0.0] * (2 * len(LABELERS))


def accepted(weights: list[float]):
    """Condition on a candidate struct: the classifier accepts it, its check does not speak against it, and two labelers speak for it, the
    gazetteer or the context among them."""

    def test(c: Column) -> Column:
        z = F.lit(weights[0])
        for j, n in enumerate(LABELERS):
            v = c["votes"][n]
            z = z + F.when(v == -1, weights[1 + 2 * j]).when(v == 1, weights[2 + 2 * j]).otherwise(0.0)
        yes = lambda n: (c["votes"][n] == 1).cast("int")
        voices = yes("gazetteer") + yes("context") + yes("border")
        return (1 / (1 + F.exp(-z)) >= ACCEPT) & (c["votes"]["check"] >= 0) & (voices >= 2) & (yes("gazetteer") + yes("context") >= 1)

    return test


SPANS = "array<struct<kind:int,start:int,end:int>>"


def _free(more: Column, base: Column) -> Column:
    """Those of ``more`` that overlap none of ``base``: no base span that starts before ends later, none starts inside."""
    mark = lambda spans, n: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("own"), s["end"].alias("end"), s["kind"].alias("kind")))

    def each(row: Column) -> Column:
        ends = F.transform(row, lambda s: F.when(s["own"] == 0, s["end"]).otherwise(-1))
        starts = F.transform(F.reverse(row), lambda s: F.when(s["own"] == 0, s["start"]).otherwise(2**31 - 1))
        near = F.struct(running(ends, -1, F.greatest).alias("end"), F.reverse(running(starts, 2**31 - 1, F.least)).alias("start"))
        test = lambda n: F.transform(row, lambda s, i: F.when((s["own"] == 1) & (F.get(n["end"], i) <= s["start"]) & (F.get(n["start"], i) >= s["end"]), F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
        return F.array_compact(let(near, test))

    return F.when((F.size(more) > 0) & (F.size(base) > 0), let(F.array_sort(F.concat(mark(base, 0), mark(more, 1))), each)).otherwise(more)


def with_spans(rows: DataFrame, weights: list[float]) -> DataFrame:
    """``rows`` with arrays ``base_spans`` and ``spans`` of (kind, start, end) for their ``candidates``, each by kind as in KINDS, then start."""
    slim = lambda a: F.transform(a, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))).cast(SPANS)
    test, others = accepted(weights), [c for c in rows.columns if c != "candidates"]
    kept = F.struct(slim(F.filter("candidates", lambda c: c["base"])).alias("base"), slim(F.filter("candidates", lambda c: ~c["base"] & test(c))).alias("more"))
    both = let(kept, lambda k: F.struct(k["base"].alias("base"), F.array_sort(F.concat(k["base"], _free(k["more"], k["base"]))).alias("all")))
    return rows.select(*others, both.alias("_found")).select(*others, F.col("_found.base").alias("base_spans"), F.col("_found.all").alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced once."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(pieces: Column, a: Column, b: Column) -> Column:
        def part(j: Column) -> Column:
            begin = F.greatest(a - j * PIECE, F.lit(0))
            return F.substring(F.get(pieces, j), begin + 1, F.least(b - j * PIECE, F.lit(PIECE)) - begin)

        return F.when(b > a, F.array_join(F.transform(F.sequence(F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")), part), "")).otherwise("")

    def join(x: Column) -> Column:
        at = lambda i: F.get(x["done"], i)
        parts = F.transform(x["order"], lambda s, i: F.when(s["start"] >= at(i), F.concat(piece(x["pieces"], at(i), s["start"]), F.get(names, s["kind"]))).otherwise(""))
        end = F.array_max(F.transform(x["order"], lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), piece(x["pieces"], end, F.length(text)))

    def each(order: Column) -> Column:
        done = running(F.transform(order, lambda s: s["end"]), 0, F.greatest)
        return let(F.struct(order.alias("order"), done.alias("done"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces")), join)

    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.when(F.size(spans) > 0, let(order, each)).otherwise(text)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base_spans, spans."""
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), candidates(F.col(text_col)).alias("candidates")))
    return with_spans(rows, fit(rows))


def span_text(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans. Texts are not carried on."""
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), candidates(F.col(text_col)).alias("candidates")))
    rows = with_spans(rows, fit(rows))
    of = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(span_text("base_spans"), 256).alias("base_sha256"), span_text("spans").alias("spans"))
