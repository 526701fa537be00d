"""Every query with SQL gives the SQL's rows on the smallest tables; the others give rows."""

import math

import pytest
from conftest import SMALL

from lodestone.plans import all_queries, all_sql


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, int | float):
            return f"{float(x):.5f}".replace("-0.00000", "0.00000")
        if isinstance(x, list | tuple):
            return str([one(v) for v in x])
        return str(x)

    return sorted([tuple(one(r[i]) for i in order) for r in rows])


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = all_queries()[name](spark, SMALL)
    got = duck.execute(all_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(got.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_gives_rows(spark, name):
    assert all_queries()[name](spark, SMALL).count() > 0
