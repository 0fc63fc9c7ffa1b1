import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cairnfield.plans import queries as plans

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


#: On a thin cloud no cell has all neighbours, no path is found, and no supplier has many points.
THIN = {"erode_mask", "smooth_paths", "draped_paths", "followed_paths", "path_cost", "enough_points"}


def same(a, b):
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or math.isnan(a) and math.isnan(b)
    return a == b


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)) if x is None else "", x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = ordered([tuple(r) for r in df.select(*columns).collect()])
    exp = ordered(duck.sql(f"SELECT {', '.join(columns)} FROM ({plans.ORACLE_SQL[name]})").fetchall())
    assert len(got) == len(exp) and (exp or name in THIN)
    bad = [(g, e) for g, e in zip(got, exp) if not all(map(same, g, e))]
    assert not bad, bad[:3]


def test_every_query_has_sql():
    """But for whole trajectories, whose single step is a query with SQL; test_engine has their properties."""
    assert set(plans.QUERIES) - set(plans.ORACLE_SQL) == {"apf_rollouts", "followed_paths"}


def test_entry(spark):
    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
