"""Queries of the subpackage against their oracles."""

import pytest

import __spark_entry__ as entry
from quillspark.llm import queries
from tests.test_entry import SF, duck, pytestmark, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):  # noqa: F811
    df = entry.queries()[name](spark, SF)
    found = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, df.collect()) == rows(found.columns, found.fetchall())


def test_all_are_registered():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {x[: x.index("_") + 1] for x in names if x.startswith("op")} and "pipeline" in names
