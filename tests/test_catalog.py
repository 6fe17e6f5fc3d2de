"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from headway.plans import catalog, itineraries  # noqa: F401

SF = "/root/testdata/sf0.001"
#: Queries that find nothing on these smallest tables; on larger ones they do.
EMPTY = set("accessible_transfers block_successors candidate_pairs_grid integrity_violations lift_outage_difference same_station_pairs trips_past_midnight useful_transfers walking_bands".split())
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    values = pdf.astype(object).where(pdf.notna(), None).values.tolist()
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in values), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs) and (len(theirs) or name in EMPTY)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["hour", "mode", "n", "median", "mean", "std"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def compared(spark, folder, name):
    """The query's rows on a folder's tables, which are those of its SQL."""
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder if (folder / f'{t}.parquet').exists() else SF}/{t}.parquet')")
    ours, theirs = catalog.QUERIES[name](spark, str(folder)).toPandas(), c.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)
    return ours


@pytest.fixture
def two_districts(tmp_path):
    """Three stops whose keys lie 3,000 apart, so in one square on one spot, of which the first two are in one nation; a part that the first and third supply."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT 5 + 3000 * i AS s_suppkey, CAST(i // 2 AS INT) AS s_nationkey, 1.0 AS s_acctbal FROM range(3) t(i)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    c.execute(f"COPY (SELECT 1 AS l_orderkey, CAST(i AS INT) AS l_linenumber, 7 AS l_partkey, 5 + 6000 * i AS l_suppkey, DATE '1995-06-02' AS l_shipdate FROM range(2) t(i)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    return tmp_path


def test_transfers_of_stops_with_far_keys(spark, two_districts):
    """stops of one square are near each other whatever their keys are."""
    got = {(r.from_stop_id, r.to_stop_id): (r.min_transfer_time, r.source) for r in compared(spark, two_districts, "min_transfer_time").itertuples()}
    assert got == {(5, 3005): (180, "station"), (3005, 5): (180, "station"), (5, 6005): (247, "declared"), (6005, 5): (120, "walk"), (3005, 6005): (120, "walk"), (6005, 3005): (120, "walk")}


def test_network_counts_transfers_of_stops_with_far_keys(spark, two_districts):
    """the network's transfer edges are those of one square."""
    assert compared(spark, two_districts, "network_size").transfers.tolist() == [6]


def test_recoveries_by_trips_of_far_customers(spark, tmp_path):
    """trips are on one of 40 routes, so those of customers whose keys lie 40 apart replace each other."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT 10 * i AS o_orderkey, 3 + 40 * i AS o_custkey, '2-HIGH' AS o_orderpriority, DATE '1995-06-02' AS o_orderdate FROM range(4) t(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    c.execute(f"COPY (SELECT 10 * i AS l_orderkey, CAST(n AS INT) AS l_linenumber, 7 AS l_partkey, n AS l_suppkey, DATE '1995-06-02' AS l_shipdate FROM range(4) t(i), range(2) u(n)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got = [(r.leg_id, r.rank, r.trip_id) for r in compared(spark, tmp_path, "recoveries_topk").itertuples()]
    assert sorted(got) == [(0, 1, 10), (0, 2, 20), (10, 1, 20), (10, 2, 30), (20, 1, 30)]
