"""Carrots where distances tie: the query and its SQL take the same point."""

import duckdb

from cairnfield.plans import queries as plans


def test_distances_that_tie_in_sql_tie_in_the_query(spark, tmp_path):
    """Points as far from the pose as each other, whose distances `hypot` tells apart by a bit."""
    paths = [[(562, 399), (447, 606), (575, 164)]]
    # Every point that is mirrored at the pose, on either axis or the diagonal, is as far away as the first.
    for dx, dy in ((62, 101), (53, 106), (62, -101), (-107, 51), (13, 184), (96, 28), (100, 0), (171, 85)):
        paths.append([(500 + a, 500 + b) for a, b in ((dx, dy), (-dx, dy), (dy, dx), (dx, -dy), (-dy, -dx), (-dx, -dy), (3 * dx, 2 * dy))])
    rows = [(i, x * 77 % 1000, y * 143 % 1000, n) for i, path in enumerate(paths) for n, (x, y) in enumerate(path, 1)]  # 13 * 77 and 7 * 143 are 1 mod 1000
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(db.sql(plans.ORACLE_SQL["carrot"]).fetchall())
    got = sorted(map(tuple, plans.carrot(spark, str(tmp_path)).select("query_id", "seq").collect()))
    assert got == want and len(got) == len(paths)
    assert (0, 2) in got
