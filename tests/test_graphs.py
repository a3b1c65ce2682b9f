"""Graph operators: work dealt to tasks of bounded size, results as of the vertices one by one."""

import numpy as np
from oracle import SF

from strandflow.operators import graphs
from strandflow.plans import structures


def test_links_come_from_many_tasks(spark):
    """Vertices are one small file, read by one task, which then made all links."""
    assert structures.links(spark, SF).rdd.getNumPartitions() > 1


def test_links_are_dealt_by_their_number(spark, monkeypatch):
    """More links are more tasks."""
    monkeypatch.setattr(graphs, "TASK_LINKS", 50, raising=False)
    e = spark.range(500).selectExpr("0L as g", "id as i", "id + 1 as j")
    both = graphs.both_ways(e)
    assert both.rdd.getNumPartitions() == 20 and both.count() == 1000


def test_results_of_the_order(spark):
    rng = np.random.default_rng(2)
    v = [(g, i) for g in range(3) for i in range(30)] + [(9, 1)]
    e = [(g, int(a), int(b)) for g in range(3) for a, b in rng.integers(0, 32, (60, 2))]
    vf, ef = spark.createDataFrame(v, "g long, i long"), spark.createDataFrame(e, "g long, i long, j long")
    near = {x: set() for x in v}
    for g, a, b in e:
        if a != b and (g, a) in near and (g, b) in near:
            near[g, a].add((g, b))
            near[g, b].add((g, a))
    greedy, split, a = {}, {}, dict.fromkeys(v, 1)
    for g in {g for g, _ in v}:
        size = [0, 0]
        for i in np.random.default_rng(1).permutation(sorted(i for h, i in v if h == g)).tolist():
            greedy[g, i] = int(not any(greedy.get(x) for x in near[g, i]))
            free = [k for k in (0, 1) if not any(split.get(x) == 2 - k for x in near[g, i])]
            split[g, i] = 0
            if free:
                k = min(free, key=lambda k: (size[k], k))
                split[g, i], size[k] = k + 1, size[k] + 1
        if size[1] > size[0]:
            split |= {x: 3 - s for x, s in split.items() if x[0] == g and s}
    for _ in range(10):
        moved = [x for x in v if 2 * sum(a[y] == a[x] for y in near[x]) > len(near[x])]
        a |= {x: 1 - a[x] for x in moved}
    for want, got in ((greedy, graphs.greedy_independent_set(vf, ef)), (split, graphs.greedy_bipartite_split(vf, ef)), (a, graphs.relabel_split(vf, ef))):
        assert {(r[0], r[1]): r[2] for r in got.collect()} == want


def test_matching_holds_packed_links(spark):
    """F32: 40 left vertices are 40 rows of their graph's task, not a row for each link."""
    e = spark.range(1600).selectExpr("0L as g", "id % 40 as i", "id div 40 + 7 as j")
    m = graphs.matching(e)
    assert "collect_set" in m._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.i, r.mate) for r in m.orderBy("i").collect()] == [(i, i + 7) for i in range(40)]
