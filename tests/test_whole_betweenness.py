"""Betweenness by searches through files against the graph in each task, and over a graph that has no inner node."""

import random

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from ledgerloom.operators import graph


def test_searches_through_files(spark, monkeypatch):
    r = random.Random(3)
    pairs = {(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(28)} | {("n1", "n1")}
    e = spark.createDataFrame(sorted(pairs), "src string, dst string")
    want = {x.id: x.score for x in graph.betweenness(e).collect()}
    monkeypatch.setattr(graph, "SMALL_EDGES", 0)
    monkeypatch.setattr(graph, "SEARCHED", 100)
    got = {x.id: x.score for x in graph.betweenness(e).collect()}
    assert got == pytest.approx(want) and max(want.values()) > 0


def test_no_inner_node_no_search(spark, monkeypatch):
    monkeypatch.setattr(DataFrame, "toPandas", lambda *_: pytest.fail("the edges went to the driver"))
    e = spark.createDataFrame([(f"C{i}", f"S{j}") for i in range(5) for j in range(3)], "src string, dst string")
    assert [x.score for x in graph.betweenness(e).collect()] == [0.0] * 8
