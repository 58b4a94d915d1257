"""Tier (c): every registered query equals its DuckDB formulation at sf0.01
(row count, column names, values bit for bit), and the smoke entry runs."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_mod
from conftest import SF01
from contract_check import compare, duck

KEYS = sorted(set(entry_mod.queries()) - set(entry_mod.LLM_QUERIES))


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_oracle():
    assert set(KEYS) == set(entry_mod.oracle_sql()) - set(entry_mod.LLM_ORACLE_SQL)


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_oracle(spark, con, name):
    problems, ns, nd = compare(spark, con, name, entry_mod.queries()[name], entry_mod.oracle_sql()[name], SF01)
    assert not problems, problems


def test_entry_smoke(spark):
    r = entry_mod.entry(spark).collect()
    assert [tuple(x) for x in r] == [(150, 6, 3)]
