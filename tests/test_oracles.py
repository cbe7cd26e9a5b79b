"""Every query with an oracle gives the oracle's rows; every other one runs."""

import importlib

import compare
import pytest
from conftest import DATA

import __spark_entry__ as entry

NAMES = [n for m in entry._CATALOGUES for n in importlib.import_module(m).QUERIES]


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, name):
    assert compare.differs(spark, DATA, name).startswith("ok")


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_catalogues_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
