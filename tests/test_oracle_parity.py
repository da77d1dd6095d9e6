"""Every registered query with SQL agrees with DuckDB on sf0.001."""
import decimal
import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _spark_type(t) -> str:
    s = t.simpleString()
    return s.upper() if s.startswith("decimal") else _TYPES.get(s, s)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    assert {f.name: _spark_type(f.dataType) for f in df.schema.fields} == \
        {c: str(t) for c, t in zip(rel.columns, rel.types)}
    res = duck.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _rows(s_cols, s_rows) == _rows(d_cols, d_rows)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.records_evaluated == r.policy_decisions
    assert r.retry_now == r.recovery_attempts
    assert r.successful_recoveries + r.failed_recoveries == r.recovery_attempts
    assert r.revenue_recovered + r.revenue_unrecovered == r.revenue_at_risk
    assert r.exception_count == r.failed_recoveries + r.human_escalations
