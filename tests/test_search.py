"""The positional index: stems, question syntax, cover density, what is read, and the trace of a search."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from memlake.functions.chunking import chunks
from memlake.operators.passages import answer, fuse_passages, opening, resolved, trace
from memlake.operators.written import new_path
from memlake.search.analysis import positions, words
from memlake.search.english import stem
from memlake.search.postings import may_answer, read_postings, search, write_postings
from memlake.search.question import parse, score

#: Published samples of the stemming rules.
STEMS = """consigned:consign consignment:consign consistency:consist consolatory:consolatori conspicuous:conspicu conspiracy:conspiraci constancy:constanc
knackeries:knackeri knavish:knavish knightly:knight generously:generous hopping:hop hoping:hope happy:happi say:say ties:tie cries:cri gas:gas this:this
gaps:gap luxuriate:luxuri agreed:agre relational:relat rational:ration sensibility:sensibl analogy:analog fully:fulli electricity:electr hopefulness:hope
adoption:adopt controlling:control roll:roll skies:sky dying:die news:news inning:inning proceed:proceed youth:youth dogs':dog dog's:dog""".split()


@pytest.mark.parametrize("pair", STEMS)
def test_stems(pair):
    word, want = pair.split(":")
    assert stem(word) == want


def test_positions_count_stop_words_and_fold():
    assert words("The cat sat on THE mats", "english") == [None, "cat", "sat", None, None, "mat"]
    assert positions("a b a", "simple") == {"a": [1, 3], "b": [2]}
    assert words(None, "english") == [] and words("... \n", "simple") == [] and words("Élan_2", "simple") == ["élan", "2"]


def test_question_syntax():
    wanted = lambda q: [[[t for t, _ in p] for p in a.wanted] for a in parse(q)]
    barred = lambda q: [[[t for t, _ in p] for p in a.barred] for a in parse(q)]
    assert wanted("running dogs") == [[["run"], ["dog"]]]
    assert wanted('"sat on the mat" or fish -bones') == [[["sat", "mat"]], [["fish"]]] and barred('"sat on the mat" or fish -bones') == [[], [["bone"]]]
    assert parse('"sat on the mat"')[0].wanted == ((("sat", 0), ("mat", 3)),)
    assert wanted('-"big dog" cat') == [[["cat"]]] and barred('-"big dog" cat') == [[["big", "dog"]]]
    assert wanted("cat CAT cat's") == [[["cat"]]]
    assert wanted("well-known") == [[["well", "known"]]]
    for nothing in ("", None, "the of", "-cat", '"', "or or", "- !"):
        assert parse(nothing) == ()
    assert wanted('open "quote here') == [[["open"], ["quot"]]] or wanted('open "quote here') == [[["open"], ["quot", "here"]]]


#: Worked by hand for the question: quick fox or "lazy dog" -cat. A cover of two words with n others between weighs 0.1 / (1 + n).
HAND = {
    1: ("quick fox", 0.1),
    2: ("quick brown fox", 0.05),
    3: ("fox quick", 0.1),
    4: ("quick fox quick", 0.2),
    5: ("quick red brown fox and a quick fox", 0.1 / 3 + 0.1 / 3 + 0.1),
    6: ("a lazy dog", 0.1),
    7: ("lazy lazy dogs", 0.1),
    8: ("a lazy dog, a quick fox", 0.2),
    9: ("quick foxes and cats", 0.1),
    10: ("a lazy dog and a cat", None),
    11: ("lazy brown dog", None),
    12: ("quick", None),
    13: ("", None),
    14: (None, None),
}


def test_ten_texts_by_hand(spark):
    question = 'quick fox or "lazy dog" -cat'
    for text, want in HAND.values():
        got = score(parse(question), positions(text, "english"))
        assert got == (None if want is None else pytest.approx(want)), text
    rows = [(i, 0, t) for i, (t, _) in HAND.items()]
    path = new_path(spark, "test-postings")
    postings = write_postings(spark.createDataFrame(rows, "data_id long, ordinal int, chunk string"), path)
    found = search(postings, {"q": question, "none": "zebra", "empty": ""}, 100).collect()
    assert {x.data_id: x.score for x in found} == {i: round(w, 6) for i, (_, w) in HAND.items() if w is not None}
    best = sorted(((-round(w, 6), i) for i, (_, w) in HAND.items() if w is not None))
    assert [x.data_id for x in sorted(found, key=lambda x: x.rank)] == [i for _, i in best]
    assert search(read_postings(spark, path), {"q": question}, 2).count() == 2
    allowed = spark.createDataFrame([(2,), (12,)], "data_id long")
    assert [x.data_id for x in search(postings, {"q": question}, 5, allowed=allowed).collect()] == [2]


def brute(alternatives, text):
    """Every stretch, and those that hold no shorter one."""
    at = {w: [i for i, x in enumerate(text, 1) if x == w] for w in set(text)}
    terms = {t for a in alternatives for p in (*a.wanted, *a.barred) for t, _ in p}
    has = lambda p, a, b: any(all(s + d <= b and text[s + d - 1] == t for t, d in p) for s in range(a, b + 1))
    if not any(all(has(p, 1, len(text)) for p in a.wanted) and not any(has(p, 1, len(text)) for p in a.barred) for a in alternatives):
        return None
    met = [a for a in alternatives if all(has(p, 1, len(text)) for p in a.wanted) and not any(has(p, 1, len(text)) for p in a.barred)]
    held = [(a, b) for a, b in combinations(range(1, len(text) + 1), 2) if any(all(has(p, a, b) for p in x.wanted) for x in met)]
    held += [(a, a) for a in range(1, len(text) + 1) if any(all(has(p, a, a) for p in x.wanted) for x in met)]
    least = [(a, b) for a, b in held if not any((c, d) != (a, b) and a <= c and d <= b for c, d in held)]
    inside = lambda a, b: sum(a <= p <= b for t in terms for p in at.get(t, []))
    return sum(0.1 / (1 + (b - a) - (inside(a, b) - 1)) for a, b in least)


def test_covers_match_every_stretch():
    r = random.Random(4)
    for _ in range(400):
        text = [r.choice("abcde") for _ in range(r.randrange(0, 14))]
        parts = [r.choice(["a", "b", "c", '"a b"', '"b a"', '"c x d"', "-e", '-"d d"', "or"]) for _ in range(r.randrange(1, 6))]
        question = parse(" ".join(parts), "simple")
        want = brute(question, text) if question else None
        got = score(question, positions(" ".join(text), "simple"))
        assert got == (None if want is None else pytest.approx(want)), (parts, text)


def test_a_question_reads_its_own_partitions_only(spark):
    path = new_path(spark, "test-postings")
    rows = [(i, 0, f"word{i} common") for i in range(400)]
    postings = write_postings(spark.createDataFrame(rows, "data_id long, ordinal int, chunk string"), path, "simple")
    plan = search(postings, {"q": "word7"}, 5, "simple")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "term" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert [x.data_id for x in search(postings, {"q": "word7"}, 5, "simple").collect()] == [7]
    assert search(postings, {"q": "common"}, 1000, "simple").count() == 400


def test_empty_index(spark):
    postings = write_postings(spark.createDataFrame([], "data_id long, ordinal int, chunk string"), new_path(spark, "test-postings"))
    assert search(postings, {"q": "word"}, 5).count() == 0


def test_fusion_trace_and_answer(spark):
    arm = lambda *rows: spark.createDataFrame(list(rows), "data_id long, ordinal int, score double, rank int")
    arms = {"vector": arm((1, 0, 0.9, 1), (2, 0, 0.5, 2), (3, 1, 0.4, 3)), "lexical": arm((2, 0, 0.2, 1), (4, 0, 0.1, 2), (3, 0, 0.1, 3))}
    fused = fuse_passages(arms, 2).collect()
    assert [(x.data_id, x.ordinal, x.arms) for x in fused] == [(2, 0, "lexical,vector"), (1, 0, "vector"), (4, 0, "lexical"), (3, 0, "lexical"), (3, 1, "vector")]
    assert fused[0].score == round(1 / 62 + 1 / 61, 6)
    best = fuse_passages(arms, 2, "none").collect()
    assert [(x.data_id, x.score) for x in best] == [(1, 0.9), (2, 0.5), (3, 0.4), (3, 0.1), (4, 0.1)]
    frame = spark.createDataFrame(fused)
    waiting = spark.createDataFrame([(9,), (4,), (1,)], "data_id long")
    cited = spark.createDataFrame([(2,)], "data_id long")
    got = {x.data_id: (x.rank, x.used, x.reason) for x in trace(frame, waiting, 2, cited).collect()}
    # 4 and 3 were cut; 1 was shown, so it is not listed again as waiting, and still takes its number.
    assert got == {2: (1, True, None), 1: (2, False, "retrieved_not_cited"), 4: (3, False, "threshold"), 3: (4, False, "threshold"), 9: (8, False, "not_yet_enriched")}
    chunks = spark.createDataFrame([(2, 0, "  one\n two "), (1, 0, "x" * 400), (4, 0, "y")], "data_id long, ordinal int, chunk string")
    quotes = {x.marker: x.quote for x in answer(frame, chunks, 2).collect()}
    assert quotes == {1: "one two [1]", 2: "x" * 280 + " [2]"}
    said = spark.createDataFrame([("a [2] b [1] c [9] [2] [x] [0]",)], "t string").select(resolved(F.col("t"), 3).alias("n"))
    assert said.first().n == [1, 2]
    assert [(x.data_id, x.ordinal) for x in opening(chunks.withColumn("ordinal", F.col("ordinal") + 2), arm((2, 0, 1.0, 1)).drop("ordinal")).collect()] == [(2, 2)]


def test_a_shared_word_is_sent_once_a_chunk(spark):
    """Many questions with one common word: what is grouped is the chunks, not the chunks of every question."""
    rows = [(i, 0, f"the word{i % 20} and the rest") for i in range(300)]
    postings = write_postings(spark.createDataFrame(rows, "data_id long, ordinal int, chunk string"), new_path(spark, "test-postings"), "simple")
    found = search(postings, {f"q{i}": f"the word{i}" for i in range(20)}, 100, "simple")
    assert found.count() == 300 and {x.question for x in found.collect()} == {f"q{i}" for i in range(20)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [data_id" in plan and "Join Inner" not in plan


def test_postings_hold_a_term_once_a_piece(spark):
    rows = [(i, i % 3, "common Common word" + str(i)) for i in range(500)]
    chunks = spark.createDataFrame(rows, "data_id long, ordinal int, chunk string").coalesce(1)
    postings = write_postings(chunks, new_path(spark, "test-postings"), "simple")
    held = postings.where("term = 'common'").collect()
    assert len(held) == 1 and sorted(zip(held[0].data_ids, held[0].ordinals, map(tuple, held[0].positions), strict=True)) == [(i, i % 3, (1, 2)) for i in range(500)]


def test_what_may_answer_holds_all_that_answers(spark):
    """Random texts, with capitals, signs, and letters whose lower case has other letters: the same answers with and without the texts that cannot."""
    r = random.Random(4)
    bits = ["one", "Two", "three", "ONE two", "\u212aey", "\u0130on", "\u039f\u03a3", "four-five", "twone", "\n\n"]
    texts = spark.createDataFrame([(i, None if i % 50 == 7 else " ".join(r.choices(bits, k=r.randrange(0, 5)))) for i in range(400)], "data_id long, text string")
    questions = {"a": '"one two" or "three four"', "b": "key -three", "c": "\u03bf\u03c2", "d": "-one", "e": "two five or ion"}
    run = lambda rows, asked, where: sorted(map(tuple, search(write_postings(chunks(rows), new_path(spark, where), "simple"), asked, 500, "simple").collect()))
    for name, question in questions.items():
        may = may_answer({name: question}, "simple", F.col("text"))
        want = run(texts, {name: question}, "all")
        assert run(texts.where(may), {name: question}, "some") == want and (want or name == "d")
    assert texts.where(may_answer({"a": questions["a"]}, "simple", F.col("text"))).count() < 200
    assert texts.where(may_answer({"a": "running"}, "english", F.col("text"))).count() == 400
