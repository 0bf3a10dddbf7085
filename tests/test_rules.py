"""Small worlds with results worked out by hand: access, chunks, embeddings, names, sniffing, selectors, facts, hierarchy, merges."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from memlake.functions.chunking import hash_embedding, spans
from memlake.functions.names import normalize_name
from memlake.functions.selectors import compile_selector
from memlake.operators.access import Principal, assigned, strictest, visible
from memlake.operators.components import on_circles
from memlake.operators.containers import closure, would_cycle
from memlake.operators.evidence import drawn_under, from_source, known_at, readable, seeds, visible_facts, walk
from memlake.operators.graph import conflicts, supersede
from memlake.operators.lifecycle import merged
from memlake.operators.retrieval import Filter, narrowed
from memlake.operators.routing import fan_out, poll, route
from memlake.operators.upkeep import linked
from memlake.sources.parsing import sniffed, sniffed_bytes


def test_who_sees_what(spark):
    rows = [(level, who, org) for level in ("private", "restricted", "shared", "org", "public") for who in ("me", "you") for org in ("o", "p")]
    items = spark.createDataFrame([(level, who, org, ["user:u"], False) for level, who, org in rows], "access_level string, owner_id string, org_id string, shared_with array<string>, deleted boolean")
    seen = lambda user: {(x.access_level, x.owner_id) for x in items.where(visible(Principal(user, "o"))).collect()}
    open_to_all = {(level, who) for level in ("org", "public") for who in ("me", "you")}
    assert seen("me") == open_to_all | {("private", "me"), ("shared", "me")}
    assert seen("u") == open_to_all | {(level, who) for level in ("shared", "restricted") for who in ("me", "you")}
    assert items.where(visible(Principal("me", "q"))).count() == 0


@pytest.mark.parametrize(
    ("members", "want"),
    [
        ([("public", []), ("shared", ["u1", "u2"]), ("shared", ["u2", "u3"])], ("shared", ["u2"])),
        ([("shared", ["u1"]), ("shared", ["u2"])], ("shared", [])),
        ([("shared", ["u1"]), ("private", ["u1"])], ("private", [])),
        ([("org", ["u1"]), ("public", [])], ("org", [])),
    ],
)
def test_strictest(spark, members, want):
    level, left = strictest()
    got = spark.createDataFrame(members, "access_level string, shared_with array<string>").agg(level.alias("level"), left.alias("left")).first()
    assert (got.level, got.left) == want


def test_level_of_a_write(spark):
    cases = {
        (None, None, None): ("private", None),
        (None, "shared", None): ("org", None),
        (None, "personal", None): ("private", None),
        ("public", None, None): ("public", None),
        ("shared", "personal", "a"): ("shared", "wider_than_connection"),
        ("public", "shared", None): ("public", "wider_than_connection"),
        ("restricted", "shared", "a"): ("restricted", None),
        ("shared", None, None): ("shared", "principals_required"),
        ("secret", None, None): ("secret", "unknown_level"),
    }
    rows = spark.createDataFrame([(a, s, [p] if p else [], i) for i, (a, s, p) in enumerate(cases)], "asked string, scope string, principals array<string>, i int")
    got = rows.select("i", assigned(F.col("asked"), F.col("principals"), F.col("scope")).alias("a")).orderBy("i").collect()
    assert [(x.a.level, x.a.error) for x in got] == list(cases.values())


def test_chunks():
    assert spans("a" * 700 + "\n\n" + "b" * 700) == [(0, 700), (702, 1402)]
    assert spans("a" * 500 + "\n\n" + "b" * 500 + "\n \n" + "c" * 900) == [(0, 1002), (1005, 1905)]
    assert spans("x" * 3000) == [(0, 1200), (1050, 2250), (2100, 3000)]
    assert spans("\n\n\n") == spans(" ") == [] and spans("\n\none") == [(2, 5)]


def test_hash_embedding():
    import hashlib

    digest = hashlib.blake2b(b"word", digest_size=8).digest()
    v = hash_embedding("Word!", 64)
    assert v[int.from_bytes(digest[:4], "big") % 64] == (1.0 if digest[4] & 1 else -1.0) and abs(v).sum() == 1
    assert hash_embedding("", 8).tolist() == hash_embedding(None, 8).tolist() == [1.0] + [0.0] * 7


def test_names(spark):
    want = {"Dr. Élodie  O'Neil, PhD": "elodie o neil", "Miss Jane Roe III": "jane roe", "Acme Inc": "acme inc", "Straße": "strasse", "ﬁne Ltd.": "fine ltd", "Dr": "", "J. Smith": "j smith", None: None}
    got = spark.createDataFrame([(n,) for n in want], "n string").select("n", normalize_name(F.col("n")).alias("x")).collect()
    assert {x.n: x.x for x in got} == want


def test_sniffing(spark):
    want = {"[1, 2": "text/plain", " {\"a\": 1}": "application/json", "on <html> pages": "text/plain", "\ufeff\n<!DOCTYPE html>": "text/html", "<?xml v?><html>": "text/html", "<?xml v?><a>": "text/plain", "": "application/json"}
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", sniffed(F.col("t")).alias("k")).collect()
    assert {x.t: x.k for x in got} == want
    payloads = {b"plain": "text/plain", b"<html>": "text/html", b"a\x00b": "application/octet-stream", b"\xff\xfe": "application/octet-stream", b"\x01\x02ab": "application/octet-stream"}
    got = spark.createDataFrame([(bytearray(t),) for t in payloads], "t binary").select("t", sniffed_bytes(F.col("t")).alias("k")).collect()
    assert {bytes(x.t): x.k for x in got} == payloads


def test_selectors(spark):
    doc = '{"a": {"b": "Berlin"}, "n": "7", "l": [{"x": 5}], "t": true}'
    row = spark.createDataFrame([(doc,)], "d string")
    hit = lambda **k: not row.where(compile_selector({p.replace("_", "."): c for p, c in k.items()}, F.col("d"))).isEmpty()
    assert hit() and hit(a_b=["Lisbon", "Berlin"]) and not hit(a_b=["Lisbon"])
    assert hit(n={"op": "gt", "value": 6}) and not hit(n={"op": "lt", "value": 7}) and not hit(a_b={"op": "gt", "value": 1})
    assert hit(a_b={"op": "contains", "value": ["rome", "erl"]}) and hit(l_0_x={"op": "eq", "value": [5, 6]}) and not hit(l_1_x={"op": "eq", "value": 5})
    assert hit(z={"op": "ne", "value": 1}) and hit(z={"op": "not_in", "value": [1]}) and not hit(z={"op": "exists"}) and hit(z={"op": "exists", "value": False}) and hit(t=[True])


def test_facts(spark):
    day = lambda m: datetime.datetime(2024, m, 1)
    claims = lambda *c: spark.createDataFrame([(s, o, i, day(m)) for i, (s, o, m) in enumerate(c)], "subject string, object string, fact_id long, valid_from timestamp_ntz")
    left = lambda *c: sorted((x.subject, x.object, x.valid_from, x.valid_to, x.evidence) for x in supersede(claims(*c)).collect())
    assert left(("p", "Lisbon", 1), ("p", "Berlin", 6)) == [("p", "Berlin", day(6), None, 1), ("p", "Lisbon", day(1), day(6), 1)]
    assert [x[3] for x in left(("p", "Berlin", 6), ("p", "Lisbon", 1))] == [None, None]
    assert [x[3] for x in left(("p", "Berlin", 6), ("p", "Lisbon", 6))] == [None, None]
    # A repeated claim closes others by its own date, though the fact it adds to starts earlier.
    assert left(("p", "Berlin", 6), ("p", "Lisbon", 3), ("p", "Lisbon", 9)) == [("p", "Berlin", day(6), day(9), 1), ("p", "Lisbon", day(3), None, 2)]
    both = conflicts(supersede(claims(("p", "Berlin", 6), ("p", "Lisbon", 6)))).first()
    assert (both.claims, both.objects) == (2, "Berlin,Lisbon")


def test_deep_hierarchies(spark):
    chain = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(12)] + [("d", "n1"), ("n2", "d")], "child string, parent string")
    below = {x.id: x.depth for x in closure(chain, spark.createDataFrame([("n0",)], "root string")).collect()}
    assert below["n0"] == 0 and below["n2"] == 2 and below["n12"] == 12 and len(below) == 14
    asked = spark.createDataFrame([("n0", "n12"), ("n12", "n0"), ("n3", "n3")], "child string, parent string")
    assert {(x.child, x.parent): x.refused for x in would_cycle(chain, asked).collect()} == {("n0", "n12"): True, ("n12", "n0"): False, ("n3", "n3"): True}


def test_long_merges(spark):
    rows = [(i, i - 1 if i else None) for i in range(50)] + [(100, 101), (101, 100), (102, 101)]
    got = {x.id: x.survivor for x in merged(spark.createDataFrame(rows, "id long, merged_into long")).collect()}
    assert {got[i] for i in range(50)} == {0} and (got[100], got[101], got[102]) == (100, 101, 102)


ACL = "org_id string, owner_id string, access_level string, shared_with array<string>, deleted boolean"


def test_facts_are_seen_through_evidence(spark):
    me = Principal("me", "o")
    row = lambda key, owner, level, deleted=False: (key, "o", owner, level, [], deleted)
    records = spark.createDataFrame([row(1, "you", "org"), row(2, "you", "private"), row(3, "me", "private"), row(4, "me", "org", True)], f"data_id int, {ACL}")
    own = [("open", "derived", "private"), ("hidden", "derived", "public"), ("erased", "derived", "public"), ("said", "asserted", "org"), ("unsaid", "asserted", "private"), ("two", "derived", "private")]
    facts = spark.createDataFrame([(f, b, *row(0, "you", level)[1:]) for f, b, level in own], f"fact_id string, basis string, {ACL}")
    backing = [("open", 1, "a"), ("open", 1, None), ("hidden", 2, "a"), ("erased", 4, "a"), ("unsaid", 1, "a"), ("two", 1, None), ("two", 3, "b"), ("two", 2, "a")]
    seen = readable(spark.createDataFrame(backing, "fact_id string, data_id int, template string"), records, me)
    held = visible_facts(facts, seen, me)
    names = lambda df: {x.fact_id for x in df.collect()}
    assert {(x.fact_id, x.evidence) for x in held.collect()} == {("open", 1), ("said", 0), ("two", 2)}
    assert names(drawn_under(held, seen, "a")) == {"open"}
    assert names(drawn_under(held, seen, None)) == {"open", "said", "two"}
    assert names(from_source(held, seen, data_id=3)) == {"two"}
    assert names(from_source(held, seen, data_id=2)) == set()
    assert names(from_source(held, seen, members=records.where("data_id < 3").select("data_id"))) == {"open", "two"}


def test_both_clocks(spark):
    day = lambda d: datetime.datetime(2020, 1, d)
    kind = "fact_id string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz, retracted_at timestamp_ntz"
    facts = spark.createDataFrame([("open", day(1), None, day(2), None), ("closed", day(1), day(5), day(2), None), ("retracted", day(1), None, day(2), day(6))], kind)
    at = lambda v, r: {x.fact_id for x in facts.where(known_at(F.lit(day(v)).cast("timestamp_ntz"), F.lit(day(r)).cast("timestamp_ntz"))).collect()}
    assert at(1, 1) == set()
    assert at(4, 2) == at(1, 5) == {"open", "closed", "retracted"}
    assert at(5, 5) == {"open", "retracted"}
    assert at(5, 6) == {"open"}


def test_a_walk_passes_only_what_is_seen(spark):
    facts = spark.createDataFrame([("f1", "a", "b"), ("f2", "c", "b"), ("f3", "a", "d"), ("f4", "e", "f")], "fact_id string, subject string, object string")
    named = spark.createDataFrame([(x,) for x in "abcef"], "id string")
    root = lambda x: spark.createDataFrame([(x,)], "id string")
    nodes, between = walk(facts, named, root("a"), 2)
    assert {(x.id, x.hops) for x in nodes.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {x.fact_id for x in between.collect()} == {"f1", "f2"}
    assert walk(facts, named, root("d"), 2)[0].count() == 0


def test_seeds_are_named_and_mentioned(spark):
    entities = spark.createDataFrame([("1", "ada"), ("2", "ada lovelace"), ("3", "ad"), ("4", "lovelace"), ("5", "babbage")], "id string, name string")
    named = spark.createDataFrame([(x,) for x in ("1", "2", "3", "5")], "id string")
    assert [x.id for x in seeds(entities, named, "who was ada lovelace").collect()] == ["2", "1"]


def test_routing_of_writes(spark):
    kind = "data_id int, project_id string, owner_id string, scope string, asked_type string, asked_key string"
    writes = spark.createDataFrame([(1, "p", "u", "shared", "", "k"), (2, "p", "u", "shared", None, None), (3, "p", "u", None, None, ""), (4, "p", "u", "shared", None, None), (4, "p", "u", "shared", "thread", None)], kind)
    members = spark.createDataFrame([(4,), (4,)], "data_id int")
    got = {tuple(x) for x in route(writes, members).collect()}
    assert got == {(1, "default", "k", "u", "explicit"), (2, "default", "p", None, "routed"), (3, "default", "u", "u", "routed"), (4, None, None, None, None), (4, "thread", None, "u", "explicit")}


def test_feed_and_deliveries(spark):
    keys = lambda key, *xs: spark.createDataFrame([(x,) for x in xs], f"{key} string")
    events = [(1, "f", "r", None), (2, "g", "r", None), (3, None, "r", None), (4, None, "s", "m"), (5, None, "s", None), (6, "g", None, "m")]
    observed = spark.createDataFrame(events, "sequence int, fact_id string, data_id string, memory_id string")
    page = lambda since, limit: [x.sequence for x in poll(observed, keys("fact_id", "f"), keys("data_id", "r"), keys("memory_id", "m"), since, limit).collect()]
    assert page(0, 9) == [1, 3, 4, 6]
    assert page(1, 2) == [3, 4]
    matches = spark.createDataFrame([(1, "p", "a"), (2, "p", "b"), (3, "q", "a")], "event_id int, project_id string, alert_id string")
    kind = "subscription_id int, project_id string, alert_id string, enabled boolean, kind string"
    subscriptions = spark.createDataFrame([(1, "p", "a", True, "alert"), (2, "p", None, True, "alert"), (3, "p", None, False, "alert"), (4, "q", None, True, "standing")], kind)
    delivered = spark.createDataFrame([(2, 2)], "subscription_id int, event_id int")
    assert {tuple(x) for x in fan_out(matches, subscriptions, delivered).collect()} == {(1, 1), (2, 1)}


def test_narrowing_keeps_rows_single(spark):
    day = datetime.datetime(2024, 1, 1)
    records = spark.createDataFrame([(i, "p", ["t"], None, day) for i in (1, 2, 3)], "data_id int, project_id string, tags array<string>, template string, event_time timestamp_ntz")
    members = spark.createDataFrame([("m", 1), ("n", 1), ("m", 2)], "memory_id string, data_id int")
    artifacts = spark.createDataFrame([(1, ["k"]), (1, ["k"]), (2, ["x"])], "data_id int, keywords array<string>")
    mentions = spark.createDataFrame([("e", 1), ("e", 3)], "entity string, data_id int")
    found = lambda f: sorted(x.data_id for x in narrowed(records, f, members, artifacts, mentions).collect())
    assert found(Filter()) == [1, 2, 3]
    assert found(Filter(memories=("m", "n"))) == [1, 2]
    assert found(Filter(memories=("m", "n"), keywords=("k",), entities=("e",), tags=("t",), project="p", since="2024-01-01", until="2024-01-01")) == [1]
    assert found(Filter(template="z")) == found(Filter(tags=("u",))) == found(Filter(until="2023-12-31")) == []


def test_circles_of_any_length(spark):
    """Random links, a circle of 12 with a tail into it and one out of it, one of two, a link to itself and missing ends, against a plain walk."""
    r = random.Random(2)
    names = [f"v{i}" for i in r.sample(range(1000), 200)]
    ring = names[:12]
    pairs = [*zip(ring, ring[1:] + ring[:1]), (names[80], ring[0]), (ring[5], names[81]), (names[81], names[82]), (names[83], names[84]), (names[84], names[83]), (names[85], names[85]), (None, names[86]), (names[86], None)]
    pairs += [(r.choice(names[90:]), r.choice(names[90:])) for _ in range(110)]
    on: dict = {}
    for a, b in pairs:
        on.setdefault(a, set()).add(b)

    def reached(a):
        found, todo = set(), [a]
        while todo:
            for b in on.get(todo.pop(), ()):
                if b is not None and b not in found:
                    found.add(b)
                    todo.append(b)
        return found

    want = {(a, b) for a, b in pairs if a and b and a != b and a in reached(b)}
    got = [tuple(x) for x in on_circles(spark.createDataFrame(pairs, "a string, b string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 14
    assert on_circles(spark.createDataFrame([], "a string, b string")).count() == 0


def test_a_long_circle_is_refused(spark):
    """Of 80 links in a row one is asked for that leads back from the end to the start."""
    link = "source string, relation string, target string, created_by string, confidence double"
    standing = spark.createDataFrame([(f"m{i}", "about", f"m{i + 1}", "explicit", None) for i in range(80)], link)
    asked = spark.createDataFrame([("m80", "about", "m0", "agent", 0.5, 1), ("m80", "continues", "m0", "agent", 0.5, 2)], link + ", seq long")
    after, refused = linked(standing, asked, spark.createDataFrame([(f"m{i}",) for i in range(81)], "memory_id string"))
    assert [tuple(x) for x in refused.collect()] == [(1, "closes_a_circle")] and after.count() == 81
