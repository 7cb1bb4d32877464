"""A doc_id with several texts loses no component."""

from tests.llm.conftest import SCHEMA, prose
from tidemark.llm import simhash


def test_each_text_of_a_repeated_id_keeps_a_row(spark):
    a, b, c = (prose(700 + i, 80) for i in range(3))
    rows = [(1, a), (1, b), (1, b), (2, b), (3, c), (3, c), (4, c), (3, a)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)
    got = sorted((r.doc_id, r.text) for r in simhash.one_of_each(df).collect())
    assert got == sorted([(1, a), (1, b), (3, c)])


def test_equal_ids_in_different_components(spark):
    a, b = prose(801, 80), prose(802, 80)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(1, a), (1, b), (2, b)]], SCHEMA)
    assert sorted(r.text for r in simhash.one_of_each(df).collect()) == sorted([a, b])
