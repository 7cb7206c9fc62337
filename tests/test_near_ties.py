"""Queries against their SQL where distances tie, or meet a limit, up to rounding."""

import duckdb
import pandas as pd

from pointflux import plans


def same_as_sql(spark, folder, name, **tables):
    """The query's rows over these tables, which must be the SQL's."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pd.DataFrame(rows).to_parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = plans.QUERIES[name](spark, str(folder))
    result = con.execute(plans.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    want = sorted(tuple(dict(zip(columns, row))[c] for c in df.columns) for row in result.fetchall())
    got = sorted(tuple(r) for r in df.collect())
    assert got == want
    return got


def lines(tracks):
    """Line items of tracks: ``(line number, quantity, discount in hundredths, tax in hundredths)`` each."""
    return [{"l_orderkey": t, "l_linenumber": n, "l_quantity": float(q), "l_discount": d / 100, "l_tax": x / 100, "l_extendedprice": 1000.0} for t, keys in tracks.items() for n, q, d, x in keys]


def test_fewest_knots_at_the_limit(spark, tmp_path):
    """Distances of exactly 9, from the driver's tables (35953, 71238, 133938) and random ones; 35953's middle key is (-3.2, 7.4, 4) off."""
    tracks = {
        35953: [(2, 40, 9, 5), (6, 24, 0, 1), (7, 16, 7, 5)], 71238: [(1, 3, 2, 8), (3, 37, 6, 5), (4, 43, 1, 7), (5, 3, 6, 5)], 133938: [(1, 36, 8, 5), (3, 21, 4, 4), (5, 5, 6, 3), (7, 2, 0, 1)],
        1: [(2, 43, 6, 6), (3, 6, 0, 5), (4, 12, 6, 5), (6, 49, 8, 3)], 2: [(1, 39, 7, 4), (2, 39, 6, 1), (3, 14, 6, 8), (4, 14, 6, 5), (5, 24, 6, 3), (6, 29, 10, 6), (7, 46, 4, 2)],
    }
    got = same_as_sql(spark, tmp_path, "F612_fewest_knots", lineitem=lines(tracks))
    assert (35953, 3, 2) in got


def test_nearest_in_view_of_equals(spark, tmp_path):
    """Two bodies as far on either side of a face, the smaller id above; and in the last view a far id that is nearer by a cent."""
    at = {f: round(37.77 * f, 2) for f in range(40)}
    customers = [{"c_custkey": f, "c_nationkey": f, "c_acctbal": x} for f, x in at.items()]
    suppliers = [{"s_suppkey": 2 * f + i, "s_nationkey": f, "s_acctbal": round(x + side * (6.9 + f / 10), 2)} for f, x in at.items() for i, side in ((1, 1), (2, -1))]
    customers.append({"c_custkey": 100, "c_nationkey": 100, "c_acctbal": 0.0})
    suppliers += [{"s_suppkey": i, "s_nationkey": 100, "s_acctbal": x} for i, x in ((5, 1.02), (20005, 1.01))]
    got = same_as_sql(spark, tmp_path, "F310_nearest_in_view", customer=customers, supplier=suppliers)
    assert [r[:2] for r in got] == [*[(f, 2 * f + 1) for f in at], (100, 5)] and got[-1][2] == 1.01


def test_simplify_of_equal_errors(spark, tmp_path):
    """Quantities whose largest errors are equal but for rounding: the first splits."""
    tracks = {4584: [5, 6, 13, 2, 2, 12, 10], 19401: [9, 2, 4, 8, 1, 10, 7], 14381: [2, 8, 5, 5, 10, 1, 7], 14078: [5, 9, 12, 7, 6, 10, 1]}
    got = same_as_sql(spark, tmp_path, "F613_simplify", lineitem=lines({t: [(n + 1, q, 0, 0) for n, q in enumerate(qs)] for t, qs in tracks.items()}))
    assert got == [(4584, 7, 4), (14078, 7, 4), (14381, 7, 5), (19401, 7, 3)]
