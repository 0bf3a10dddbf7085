"""The erasure cascade and its proof; entities by identifier and name, merges and their undoing."""

import random

import pytest
from pyspark.sql import functions as F

from memlake.operators.components import components
from memlake.operators.entities import entities, merged, resolve, survivors
from memlake.operators.erasure import Mark, Reference, Registry, proof, purge, reached
from memlake.plans.erasure_queries import REGISTRY

NAMES = "data_id long, seq int, name string, type string, identifier string"


def test_components_of_chains_stars_and_rings(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(300)] + [(5000 + i, 5000 + (i + 1) % 7) for i in range(7)] + [(9, 9), (9000, 9000), (None, 4)]
    r.shuffle(links)
    got = {x.id: x.label for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {5000 + i: 5000 for i in range(7)} | {9000: 9000}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_resolution_does_not_depend_on_order(spark):
    rows = [
        (1, 0, "Priya Raman", "person", "mailto:P@x.org"), (2, 0, "priya  RAMAN", "person", None), (3, 0, "P. Raman", "person", "p@x.org/"), (4, 0, "p raman", "person", "raman@y.org"),
        (5, 0, "Raman Ltd", "organization", "raman@y.org"), (6, 0, "Priya Raman", "location", None), (7, 0, "Dr. Priya Raman PhD", "person", None), (7, 1, "Priya Raman", "person", None),
        (8, 0, "", "person", "p@x.org"), (9, 0, None, None, None), (10, 0, "Thing", None, ""), (11, 0, "Alien", "alien", "p@x.org"), (12, 0, "Lone", "topic", "only@z.org"),
    ]
    key = lambda frame: {(x.data_id, x.surface): (x.entity, x.resolved_by) for x in resolve(frame).collect()}
    got = key(spark.createDataFrame(rows, NAMES))
    assert got == key(spark.createDataFrame(rows[::-1], NAMES).repartition(3))
    one = got[1, "Priya Raman"][0]
    assert {e for (i, _), (e, _) in got.items() if i in (1, 2, 3, 4, 5, 7)} == {one} and got[6, "Priya Raman"][0] != one
    assert [got[i, s][1] for i, s in ((1, "Priya Raman"), (2, "priya  RAMAN"), (3, "P. Raman"), (4, "p raman"), (5, "Raman Ltd"), (12, "Lone"))] == ["new", "exact_name", "identifier", "identifier", "identifier", "new"]
    assert len([1 for i, _ in got if i == 7]) == 1 and not {8, 9, 11} & {i for i, _ in got} and got[10, "Thing"][0] == "other:thing"
    named = {x.entity: x for x in entities(resolve(spark.createDataFrame(rows, NAMES))).collect()}
    assert named[one].display_name == "Dr. Priya Raman PhD" and named[one].mentions == named[one].records == 6
    assert resolve(spark.createDataFrame([], NAMES)).count() == 0


def test_merge_then_unmerge_restores_the_mentions(spark):
    names = [(i, 0, n, "person", None) for i, n in enumerate(["Ann", "Ann", "Bob", "Cyd", "Cyd", "Dee"])]
    base = resolve(spark.createDataFrame(names, NAMES))
    journal = lambda *rows: spark.createDataFrame(list(rows), "merge_id int, source string, target string, undone boolean")
    of = lambda j, m=base: {x.data_id: x.entity for x in merged(m, j).collect()}
    ann, bob, cyd, dee = (f"person:{n}" for n in ("ann", "bob", "cyd", "dee"))
    before = of(journal((1, ann, bob, True)))
    assert before == {0: ann, 1: ann, 2: bob, 3: cyd, 4: cyd, 5: dee}
    chain = ((1, ann, bob, False), (2, bob, cyd, False))
    assert of(journal(*chain)) == {0: cyd, 1: cyd, 2: cyd, 3: cyd, 4: cyd, 5: dee}
    assert of(journal(chain[0], (2, bob, cyd, True))) == {0: bob, 1: bob, 2: bob, 3: cyd, 4: cyd, 5: dee}
    later = resolve(spark.createDataFrame([*names, (9, 0, "Ann", "person", None)], NAMES))
    assert of(journal((1, ann, bob, False)), later)[9] == bob and of(journal((1, ann, bob, True)), later) == before | {9: ann}
    assert of(journal((1, ann, bob, False), (2, bob, ann, False), (3, dee, dee, False)))[5] == dee
    assert {x.source: x.entity for x in survivors(journal(*((i, f"e{i}", f"e{i + 1}", False) for i in range(20)))).collect()} == {f"e{i}": "e20" for i in range(20)}


def world(spark):
    f = spark.createDataFrame
    stores = {
        "records": f([(1, "a", None), (2, "b", None), (3, None, None)], "data_id long, text string, purged_at timestamp_ntz"),
        "chunks": f([(10, 1), (11, 1), (20, 2)], "chunk_id long, data_id long"),
        "embeddings": f([(100, 10), (110, 11), (200, 20), (300, None)], "vec_id long, chunk_id long"),
        "edges": f([(1, 1, 7), (2, 1, 8), (3, 2, 8), (4, 1, 9)], "edge_id long, data_id long, fact_id long"),
        "facts": f([(7, "derived", None), (8, "derived", None), (9, "asserted", None)], "fact_id long, basis string, reason string"),
        "answers": f([(5, "x"), (6, "y")], "query_id long, answer string"),
        "seen": f([(1, 1, 5), (2, 2, 6), (3, 2, 5)], "seen_id long, data_id long, query_id long"),
        "notes": f([(1, 0, 1), (2, 1, None), (3, 2, None), (4, 9, None)], "note_id long, on_note long, data_id long"),
    }
    registry = Registry(
        "records",
        {"records": "data_id", "chunks": "chunk_id", "embeddings": "vec_id", "edges": "edge_id", "facts": "fact_id", "answers": "query_id", "seen": "seen_id", "notes": "note_id"},
        (Reference("chunks", "data_id", "records"), Reference("embeddings", "chunk_id", "chunks"), Reference("edges", "data_id", "records"), Reference("seen", "data_id", "records"), Reference("notes", "data_id", "records"), Reference("notes", "on_note", "notes")),
        (Mark("facts", "edges", "fact_id", "none_left", "basis = 'derived' and reason is null", (("reason", "'gone'"),)), Mark("answers", "seen", "query_id", "any_lost", "true", (("answer", "null"),))),
        ("text",),
    )
    return stores, registry, f([(1,), (1,)], "data_id long")


def test_cascade_walks_to_the_end(spark):
    stores, registry, gone = world(spark)
    lost = {n: sorted(r[0] for r in d.collect()) for n, d in reached(stores, registry, gone).items()}
    # Notes hang on notes: 2 on 1, 3 on 2; 4 hangs on one that is not there.
    assert lost == {"records": [1], "chunks": [10, 11], "embeddings": [100, 110], "edges": [1, 2, 4], "seen": [1], "notes": [1, 2, 3]}
    after = purge(stores, registry, gone, "2024-01-01")
    rows = lambda n: sorted(tuple(r) for r in after[n].collect())
    assert rows("facts") == [(7, "derived", "gone"), (8, "derived", None), (9, "asserted", None)]
    assert rows("answers") == [(5, None), (6, "y")] and rows("seen") == [(2, 2, 6), (3, 2, 5)]
    tomb = {r.data_id: r for r in after["records"].collect()}
    assert tomb[1].text is None and tomb[1].purged_at is not None and tomb[2].text == "b" and tomb[2].purged_at is None
    again = purge(after, registry, gone, "2030-01-01")
    assert all(sorted(map(tuple, again[n].collect()), key=repr) == sorted(map(tuple, after[n].collect()), key=repr) for n in after)


def test_the_proof_is_false_for_every_reference_left(spark):
    stores, registry, gone = world(spark)
    whole = {x.store: x.remaining for x in proof(purge(stores, registry, gone, "2024-01-01"), registry, gone).collect()}
    # A note that hung on nothing before the purge is reported too: it dangles.
    assert whole == {"records": 0, "chunks": 0, "embeddings": 0, "edges": 0, "seen": 0, "notes": 1, "facts": 0}
    for left in registry.references:
        forgetful = Registry(registry.root, registry.keys, tuple(r for r in registry.references if r != left), registry.marks, registry.cleared)
        found = {x.store: x.complete for x in proof(purge(stores, forgetful, gone, "2024-01-01"), registry, gone).collect()}
        assert not found[left.child], left
    unmarked = Registry(registry.root, registry.keys, registry.references, (), registry.cleared)
    assert not {x.store: x.complete for x in proof(purge(stores, unmarked, gone, "2024-01-01"), registry, gone).collect()}["facts"]
    untouched = {x.store: x.complete for x in proof(stores, registry, gone).collect()}
    assert not any(untouched[n] for n in ("records", "chunks", "edges", "seen", "notes"))
    assert not {x.store: x.complete for x in proof(stores, registry, spark.createDataFrame([(77,)], "data_id long")).collect()}["records"]


def test_the_registry_names_fourteen_stores_beside_the_records():
    assert len(REGISTRY.keys) == 15 and {r.child for r in REGISTRY.references} | {m.store for m in REGISTRY.marks} | {"records"} == set(REGISTRY.keys)


def test_extra_columns_survive(spark):
    stores, registry, gone = world(spark)
    stores["facts"] = stores["facts"].withColumn("x", F.lit(1))
    assert purge(stores, registry, gone, "2024-01-01")["facts"].columns == ["fact_id", "basis", "reason", "x"]
    with pytest.raises(KeyError):
        purge({"records": stores["records"]}, registry, gone, "2024-01-01")
