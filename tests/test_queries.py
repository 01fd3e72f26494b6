"""Every query of the engine against its SQL, on the smallest tables."""

import math

import pytest

from tests.conftest import SF
from tidemill.plans.queries import ORACLE, QUERIES


def canon(rows, columns):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, bool):
            return v
        return round(float(v), 5) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted((tuple(cell(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    want = [dict(zip(columns, r, strict=True)) for r in cur.fetchall()]
    assert canon([r.asDict() for r in got.collect()], sorted(columns)) == canon(want, sorted(columns))


@pytest.mark.parametrize("name", ["svc_fit"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
