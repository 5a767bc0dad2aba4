import pytest
from ledgerloom.llm import mixing


def test_targets_of_absent_values_are_alike_at_every_size(spark):
    d = spark.createDataFrame([(i, "a b c d", "x" if i % 4 else "y", "en") for i in range(40)], "doc_id long, text string, source string, lang string")
    marked = mixing._marked(d, "doc_id", "text", "source", "lang", None)
    targets = {"source": {"x": 0.3, "y": 0.2, "absent": 0.5}, "topic": {"prose": 0.5, "absent": 0.5}}
    one, two = ({r.id: r.probability for r in mixing.probabilities(marked, targets=targets, rounds=2, max_local=k).collect()} for k in (100, 0))
    assert set(one) == set(two) and all(one[i] == pytest.approx(two[i]) for i in one)
