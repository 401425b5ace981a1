from __future__ import annotations

from watchloom.plans import topics


def test_terms_travel_without_their_documents(spark):
    """Sums per topic and term leave the tasks; before, every term was shuffled with every document that has it."""
    rows = spark.createDataFrame([(k % 2, k, "red fox runs, red fox") for k in range(6)], "topic int, doc_key long, document string")
    plan = topics.topic_keywords(rows)._jdf.queryExecution().sparkPlan().toString()
    assert "Generate explode" in plan and "doc_key" not in plan.split("Generate explode")[0]


def test_rows_of_one_document_count_once(spark):
    """Also where the key is null or a document is: blue and green occur in two documents, red in one that has two rows."""
    rows = [(1, 1, "red red"), (1, 1, "red blue"), (1, 2, "blue"), (1, None, "green"), (1, None, "green lone"), (2, 1, "green"), (2, 5, None)]
    df = spark.createDataFrame(rows, "topic int, doc_key long, document string")
    got = {(r.topic, r.term) for r in topics.topic_keywords(df).collect()}
    assert got == {(1, "blue"), (1, "green"), (2, "green")}
