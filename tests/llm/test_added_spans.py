"""Spans that the labelers add to the base ones: planted forms are found and look-alikes are not, alone and among ordinary text."""

import pytest
from pyspark.sql import functions as F

from memlake.llm.pii_labelers import expectation_maximisation, pii_report

FORMS = {
    "email": [("please write ", "joe [at] example [dot] com", "."), ("contact ", "ann.lee (at) mail.example.org", ", please"), ("email ", "bob at example dot net", ".")],
    "ip": [("from host ", "2001:db8:0:0:0:ff00:42:8329", "."), ("the server ", "fe80:0:0:0:1:2:3:4", " is up")],
    "card": [("paid by card ", "**** **** **** 4242", "."), ("visa ", "4111.1111.1111.1111", ", thanks"), ("credit card ", "XXXX-XXXX-XXXX-0005", ".")],
    "phone": [("tel ", "212-555-1234", " today"), ("call ", "(415) 555-2671", "."), ("phone ", "030 1234 5678", ", please")],
}
ALIKE = ["order 212-555-1234 shipped", "version 1234.5678.1234.5678 of it", "section 030 1234 5678 says", "we met at noon dot dot", "look at example dot", "ratio 1:2:3:4 and 12:30:15", "xxxx and **** stars", "invoice 1111.2222.3333.4444", "isbn 020 1234 5678"]


def planted(repeat):
    rows, want = [], set()
    for n in range(repeat):
        for kind, forms in FORMS.items():
            for before, span, after in forms:
                i = 1_000_000 + len(rows)
                text = "x" * (n % 7) + " some words and then " + before + span + after
                rows.append((i, text))
                want.add((i, kind, text.index(span), text.index(span) + len(span)))
        for text in ALIKE:
            rows.append((1_000_000 + len(rows), text))
    return rows, want


@pytest.mark.parametrize("among", [False, True])
def test_planted_spans_are_added(spark, among):
    rows, want = planted(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if among:
        docs = docs.union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    got = set()
    for x in pii_report(docs).where(F.col("doc_id") >= 1_000_000).collect():
        assert x.n_email + x.n_ip + x.n_card + x.n_phone == 0
        got |= {(x.doc_id, k, int(a), int(b)) for k, a, b in (s.split(":") for s in x.spans.split(",") if s)}
    assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.95


def test_ordinary_text_gains_next_to_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    report = pii_report(docs).agg(F.sum(F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone")), F.sum(F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))))).first()
    assert report[0] <= report[1] <= report[0] * 1.1 + 5


def test_reliabilities_are_learnt_from_anchors():
    """A context labeler that is right on all anchors and one that is noise: only the first can carry a candidate whose check abstains."""
    table = [(0, (1, 0, 1, 1), 500), (0, (1, 0, 1, -1), 500), (0, (-1, 0, -1, 1), 500), (0, (-1, 0, -1, -1), 500), (3, (0, 0, 1, 0), 50), (3, (0, 0, 0, 1), 50), (3, (0, 0, -1, 1), 50)]
    prob, rates = expectation_maximisation(table)
    assert prob[0] == prob[1] == 0.97 and prob[2] < 0.05
    assert prob[4] > 0.9 and prob[5] < 0.55 and prob[6] < 0.05
    assert rates[2][1, 1] > 0.9 and abs(rates[3][1, 1] - rates[3][0, 1]) < 0.1
