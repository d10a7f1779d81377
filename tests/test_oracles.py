"""Every query with an oracle equals its DuckDB SQL on the smallest fixture (order-free)."""

import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

ORACLES = E.oracle_sql()
QUERIES = E.queries()


def _canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _canon(v.item())
        except (ValueError, AttributeError):
            pass
    return str(v) if not isinstance(v, (int, bool)) else v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return sorted((tuple(_canon(r[c]) for c in cols) for r in pdf.to_dict("records")), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sp = QUERIES[name](spark, SF_SMALL).toPandas()
    dk = duck.sql(ORACLES[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    assert len(sp) == len(dk)
    assert _rows(sp) == _rows(dk)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "total_addresses" in df.columns


def test_every_query_has_a_docstring():
    missing = [k for k, v in QUERIES.items() if not (v.__doc__ or "").strip()]
    assert not missing
