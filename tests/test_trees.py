"""Trees of alignment rows: distances stay in the task that needs them, half of the matrix at most."""

import tracemalloc

import numpy as np
import pytest
from oracle import SF

from strandflow.functions.alphabet import DNA
from strandflow.operators import clusters, tree
from strandflow.plans import inputs, registry


def texts(n):
    rng = np.random.default_rng(4)
    own = rng.choice(list("ACGTN-"), 32)
    return ["".join(np.where(rng.random(32) < 0.8, own, rng.choice(list("ACGTN-"), 32))) for _ in range(n)]


@pytest.mark.parametrize("method", ["average", "weighted", "single", "complete"])
def test_linkage_of_rows(method):
    rows = texts(120)
    assert tree.linkage_of_rows(rows, DNA, method) == tree.linkage(1 - clusters.identity_table(rows, DNA), method)


def test_distances_of_long_rows():
    """Of more columns than are compared at a time."""
    rows = ["".join(x) for x in zip(*[iter("".join(texts(60)))] * 192)]
    want = [[sum(x == y and x in "ACGTN" for x, y in zip(a, b)) / min(sum(c in "ACGTN" for c in t) for t in (a, b)) for b in rows] for a in rows]
    assert (clusters.identity_table(rows, DNA) == np.array(want)).all()


def test_memory_of_a_tree():
    """Half a matrix of doubles, and no rows of pairs."""
    rows = texts(1500)
    tracemalloc.start()
    tree.linkage_of_rows(rows, DNA, "average")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1500 * 1500 * 8


@pytest.mark.parametrize("method", ["average", "weighted", "single", "complete"])
def test_heights_without_rows_of_pairs(spark, method):
    """No row for each pair of leaves is made or joined."""
    plan = registry.QUERIES[f"tree_{method}"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_trees_are_dealt_to_tasks(spark):
    """An alignment's rows are few, so that all trees came to one task."""
    rows = inputs.frame(spark, "/root/testdata/sf0.01", "small_msa")
    assert clusters.tree_weights(rows, DNA).rdd.getNumPartitions() == 4
    nodes = tree.grouped_trees(rows, DNA, "single")
    assert nodes.rdd.getNumPartitions() == 4
    assert tree.path_lengths(nodes).rdd.getNumPartitions() == 4


def test_wrong_heights_are_seen(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts(9))], "msa_id long, idx long, aln string")
    nodes = tree.grouped_trees(rows, DNA, "average")
    for method, exact in (("average", True), ("complete", False)):
        gaps = [abs(r.height - r.wanted) for r in tree.heights(rows, nodes, DNA, method).collect()]
        assert len(gaps) == 8 and (max(gaps) < 1e-9) == exact
