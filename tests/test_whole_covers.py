"""What is made of cover pages: each page written once, its parts found once, and in more tasks than one."""

import os

import pytest

from ledgerloom import registry
from ledgerloom.plans import views

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", ["rule_claims", "percent_candidates", "best_percent", "filing_cover", "cusip_extract"])
def test_pages_are_written_once(spark, name):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan()
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    text = plan.toString()
    assert text.count("SCHEDULE 13D") == 1
    assert text.count("CUSIP\\s*(?:No") <= 1 and text.count("[0-9]{1,3}(?:[.]") <= 2  # a pattern and its gaps


def test_pages_have_tasks(spark):
    assert views.covers(spark, DATA).rdd.getNumPartitions() > 4 and views.works(spark, DATA).rdd.getNumPartitions() > 4
