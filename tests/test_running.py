"""Running numbers within hot keys, summaries, evidence of hot edges."""

from pyspark.sql import functions as F

from memlake.operators.containers import summaries
from memlake.operators.graph import conflicts, evidence_of, facts_of_claims
from memlake.operators.running import running


def test_running_numbers_of_a_hot_key(spark):
    keys = [None, "hot", "hot", "hot", "cold"]
    rows = [(keys[i % 5] if i % 50 else "once", i * 7919 % 5003, None if i % 9 == 0 else i % 13) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v int").repartition(7)
    got = running(df, ["k"], ["o"], {"s": F.col("v")}, {"b": F.col("v")}).collect()
    want, state = [], {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        n, s, b = state.get(k, (0, 0, None))
        want.append((k, o, v, n + 1, s, b))
        state[k] = (n + 1, s + (v or 0), v)
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    plain = running(df, ["k"], ["o"]).collect()
    assert sorted((str(x.k), x.o, x.n) for x in plain) == sorted((str(k), o, n) for k, o, _, n, _, _ in want)
    assert running(df.limit(0), ["k"], ["o"], {"s": F.col("v")}).count() == 0


def test_summaries(spark):
    rows = [("p", 3, " c ", "org", []), ("p", 1, "a", "shared", ["user:1", "user:2"]), ("p", 2, None, "shared", ["user:2"]), ("p", 9, "z", "private", []), ("q", 5, "alone", "org", [])]
    got = summaries(spark.createDataFrame(rows, "g string, data_id long, text string, access_level string, shared_with array<string>"), "g", 3).collect()
    assert len(got) == 1 and got[0].text == "a\n\n\n\nc" and got[0].level == "shared" and got[0].principals == ["user:2"]
    assert [(s.data_id, s.span_start, s.span_end) for s in got[0].sources] == [(1, 0, 1), (2, 3, 3), (3, 5, 6)]
    assert all(got[0].text[s.span_start : s.span_end] == {1: "a", 2: "", 3: "c"}[s.data_id] for s in got[0].sources)


def test_evidence_and_conflicts(spark):
    claims = spark.range(4000).select(F.lit("s").alias("subject"), F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("object"), (F.col("id") % 1000 + 5).alias("fact_id"), F.col("id").alias("valid_from"))
    got = {x.object: x for x in evidence_of(claims).collect()}
    assert (got["hot"].evidence, got["hot"].sources, got["hot"].valid_from, got["hot"].last_seen) == (990, "6,7,8", 1, 3999)
    assert (got["rare"].evidence, got["rare"].sources) == (10, "5,105,205")
    facts = facts_of_claims(spark.createDataFrame([("p", "lives", "Rome", 5, 1, 0.5), ("p", "lives", "Oslo", 5, 2, 0.9), ("p", "owns", "cat", 1, 3, None), ("p", "owns", "dog", 9, 4, 0.1), ("p", "lives", "Rome", 4, 5, 0.8), ("q", "owns", None, 1, 6, 1.0)], "subject string, predicate string, object string, valid_from int, fact_id long, confidence double"), ("lives",))
    rows = {(x.predicate, x.object): (x.valid_from, x.valid_to, x.evidence, x.confidence, x.superseded_by) for x in facts.collect()}
    assert rows == {("lives", "Rome"): (4, None, 2, 0.8, None), ("lives", "Oslo"): (5, None, 1, 0.9, None), ("owns", "cat"): (1, None, 1, None, None), ("owns", "dog"): (9, None, 1, 0.1, None)}
    assert sorted((x.predicate, x.objects) for x in conflicts(facts).collect()) == [("lives", "Rome,Oslo"), ("owns", "cat,dog")]
    moved = facts_of_claims(spark.createDataFrame([("p", "lives", "Rome", 1, 1, 0.5), ("p", "lives", "Oslo", 3, 2, 0.5), ("p", "lives", "Rome", 2, 3, 0.5), ("p", "lives", "Bern", 9, 4, 0.5)], "subject string, predicate string, object string, valid_from int, fact_id long, confidence double"), ("lives",))
    assert sorted((x.object, x.valid_from, x.valid_to, x.superseded_by) for x in moved.collect()) == [("Bern", 9, None, None), ("Oslo", 3, 9, 4), ("Rome", 1, 3, 2), ("Rome", 2, 9, 4)]
