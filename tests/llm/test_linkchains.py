"""Long chains and cycles of hosts."""

import pytest

from quarryline.llm import linkgraph


@pytest.mark.parametrize("hosts", [15, 40])
def test_distrust_goes_up_a_long_chain(spark, hosts):
    link = '<a href="http://{}/x">'
    rows = [(i, f"http://h{i}/fr", link.format(f"h{i + 1}")) for i in range(hosts)] + [(hosts, f"http://h{hosts}/fr", link.format("org"))]
    rows += [(1000, "http://org/es/1", ""), (1001, "http://apart/fr", ""), (1002, "http://net/de/1", "")]
    got = dict(linkgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "verdict").collect())
    assert got == {i: "block" for i in range(hosts + 1)} | {1000: "block", 1001: "allow", 1002: "allow"}


@pytest.mark.parametrize("others", [10, 2_500_000])
def test_verdicts_do_not_depend_on_how_many_hosts_share_the_ranks(spark, others):
    # one of `others` equal shares of distrust reaches 30,000 linkers, one of which is as much trusted
    linkers = 30_000
    edges = spark.range(linkers).selectExpr("concat('l', id) AS src", "'bad' AS dst", "1L AS n").unionByName(spark.createDataFrame([("good", "l0", 1)], "src string, dst string, n long"))
    share = 1.0 / others
    seeds = spark.createDataFrame([("bad", 0.0, share), ("rest", 0.0, 1 - share), ("good", 100 * share / linkers, 0.0), ("far", 1 - 100 * share / linkers, 0.0)], "host string, trust double, distrust double")
    ranks = {r.host: (r.trust, r.distrust) for r in linkgraph.propagate(edges, seeds).collect()}
    blocked = {h for h, (t, d) in ranks.items() if d > linkgraph.RATIO * (1 + linkgraph.MARGIN) * t}
    assert blocked == {f"l{i}" for i in range(1, linkers)} | {"bad", "rest"}


def test_ranks_of_a_cycle_reach_the_limit(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust double, distrust double")
    got = {r.host: r.trust for r in linkgraph.propagate(edges, seeds).collect()}
    d = linkgraph.DAMPING
    assert got == pytest.approx({"a": (1 - d) / (1 - d * d), "b": d * (1 - d) / (1 - d * d)}, abs=1e-8)
