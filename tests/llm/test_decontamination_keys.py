"""Benchmark items that template windows alone can't find."""

from lodestack.llm import decontaminate
from tests.llm.test_text_operators import QUESTION

FILLER = "some quite different words stand around it in every one of these texts "
NATALIA = "Natalia sold clips to 48 of her friends in April, and then she sold half as many clips in May. How many clips did Natalia sell altogether in April and May?"
SHORT, NUMERIC, EIGHT = "What is the capital of France?", "Compute 12 + 34 - 5 * 7 + 8 - 9 + 14 - 3", "Which old river runs past that small town"


def found(spark, docs, items):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}


def test_all_kinds_of_items(spark):
    around = lambda t: FILLER + t + " " + FILLER
    other = NUMERIC.replace("12", "13").replace("34", "35").replace("14", "15")
    docs = [around(x) for x in (SHORT, EIGHT, NATALIA.lower(), NATALIA.upper(), QUESTION.upper(), NUMERIC, other, "What is the capital of Spain?")]
    got = found(spark, [*docs, FILLER], [SHORT, EIGHT, NATALIA, QUESTION, NUMERIC])
    assert got == {(0, 0), (1, 1), (2, 2), (3, 2), (4, 3), (5, 4)}


def test_very_short_items_condemn_nothing(spark):
    docs = [FILLER + "they asked why the bridge was shut. Why not walk?", "Why?", FILLER + "Name three rivers. " + FILLER]
    items = ["Why?", "Why not", "...", None, "Name three rivers."]
    assert found(spark, docs, items) == {(2, 4)}
    frame = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {r["item_id"] for r in decontaminate.too_short(frame).collect()} == {0, 1, 2, 3}
