"""Customers with more orders than the small tables have."""

from logweave.plans import catalog


def test_milestones_of_busy_customers(spark, tmp_path):
    sizes = {1: 3, 2: 99, 3: 100, 4: 180, 5: 620}
    rows = [(k * 1000 + i, k) for k, n in sizes.items() for i in range(n)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_custkey: (r.n, r.milestone) for r in catalog.QUERIES["stats_milestones"](spark, str(tmp_path)).collect()}
    assert got == {1: (3, 25), 2: (99, 100), 3: (100, 150), 4: (180, 200), 5: (620, 700)}
