"""The driver's gate, locally: every registered query with an oracle equals its DuckDB
SQL at sf0.01 (rows, column names, order-insensitive values); the flagship runs."""

import os
import sys

import pytest

from conftest import ROOT, SF_CHECK

sys.path.insert(0, os.path.join(ROOT, "scripts"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import digest, duck  # noqa: E402

SQL = entry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_flagship_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["j"] for r in rows] == [0, 1]


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    pdf = entry.queries()[name](spark, SF_CHECK).toPandas()
    s_cols, s_n, s_hash = digest(list(pdf.columns), pdf.itertuples(index=False, name=None))
    res = con.execute(SQL[name])
    o_cols, o_n, o_hash = digest([d[0] for d in res.description], res.fetchall())
    assert (s_cols, s_n) == (o_cols, o_n)
    assert s_hash == o_hash
