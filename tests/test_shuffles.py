"""What is shuffled: rows dealt by their keys once, never what they explode into."""

import pytest

from memlake.plans.registry import QUERIES, passage_queries
from memlake.search.postings import write_postings

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["heuristic_keywords", "inverted_text", "graph_overview"])
def test_one_shuffle_with_a_number_of_tasks_that_follows_the_rows(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plan


def test_one_question_indexes_what_may_answer_and_walks_the_graph_once(spark, monkeypatch):
    """Chunks that are indexed for a question hold its words, and the arm over the graph is read back, not walked for each of its uses."""
    indexed = []
    monkeypatch.setattr(passage_queries, "write_postings", lambda rows, *rest: (indexed.append(rows), write_postings(rows, *rest))[1])
    arms = passage_queries._arms(spark, SF)
    every = passage_queries._chunks(spark, SF)
    assert indexed[0].select("data_id").distinct().count() < every.select("data_id").distinct().count()
    assert "o_orderkey" not in arms["graph"]._jdf.queryExecution().optimizedPlan().toString()
