"""Registered queries cover the whole of their tables."""

from terrafuse.plans import catalogue

DIR = "/root/testdata/sf0.001"


def test_way_components_of_all_lines(spark):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for r in spark.read.parquet(f"{DIR}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        a, b = sorted((find(2 * r.l_orderkey), find(2 * r.l_partkey + 1)))
        top[b] = a
    got = {r.node: r.component for r in catalogue.QUERIES["way_components"](spark, DIR).collect()}
    assert got == {x: find(x) for x in top}
