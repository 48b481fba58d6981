"""Queries against their SQL on keys and values that the small tables do not have."""

from datetime import datetime
from itertools import permutations

import duckdb
from oracle import rows_of

from tidemark.checks import ORACLES, QUERIES


def same(spark, base, name, **made):
    """Run a query and its SQL on the ``made`` tables."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table, rows in made.items():
        rows.coalesce(1).write.parquet(f"{base}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{base}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(base))
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


def test_embedded_dates_of_late_years(spark, tmp_path):
    ids = [0, 1, 3652, 21184, 150000, 9_000_000]
    rows = [(i, 10 * i + style, datetime(1996, 3, 4)) for i in ids for style in range(5)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    same(spark, tmp_path, "embedded_dates", orders=orders)


def test_members_of_the_person_they_are_placed_with(spark, tmp_path):
    rows = [(k, 1, supp, q, flag) for k, (supp, q, flag) in enumerate((s, q, f) for s in (4, 999) for q in (5.0, 25.0, 48.0) for f in "ARN")]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_suppkey long, l_quantity double, l_returnflag string")
    same(spark, tmp_path, "reassigned_members", lineitem=lines)


def test_assembled_quality_half_way(spark, tmp_path):
    """Scores half way between two decimals, their sub-objects in any order of rows."""
    flags, sizes = "ANARN", [27.0, 39.0, 21.0, 42.0, 29.0]
    orders = [(k, 1778, datetime(1996, 3, 4), 88308.38, "F", "5-LOW") for k in range(120)]
    lines = [(k, i + 1, 5, sizes[i], flags[i] if flags[i] != "R" else "A") for k, p in enumerate(permutations(range(5))) for i in p]
    same(
        spark, tmp_path, "assembled_quality",
        orders=spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_totalprice double, o_orderstatus string, o_orderpriority string"),
        lineitem=spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_suppkey long, l_quantity double, l_returnflag string"),
    )
