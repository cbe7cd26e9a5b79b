import compare
import pytest
from conftest import DATA

from foldstone.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_runs_and_matches(spark, name):
    assert compare.differs(spark, DATA, name).startswith("ok")


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
