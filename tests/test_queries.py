"""Every registered query runs, and gives its SQL's rows where it has one."""

import numpy as np
import pytest
from oracle import SF, duck, same

from strandflow.operators import statistics, tree
from strandflow.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in registry.SQL:
        same(got, duck(registry.SQL[name]))


def test_truncated_fits_of_more_values(spark):
    """A table on which a search that ends early leaves a group short of its least."""
    got = registry.QUERIES["fit_gumbel_truncated"](spark, "/root/testdata/sf0.01").toPandas()
    same(got, duck(registry.SQL["fit_gumbel_truncated"], "/root/testdata/sf0.01"))


def guessed(text):
    t = (text or "").upper()
    count = lambda letters: sum(c in letters for c in t)
    n, acg, both = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count("ACG"), count("DHKMRSVWY")
    few = n * 2 // 100
    if n <= 10:
        return None
    if n > 2000 and count("N") == n:
        return "dna"
    if count("EFIJLOPQZ"):
        return "amino"
    for kind, x in (("dna", "T"), ("rna", "U")):
        if n - acg - count(x + "N") <= few and set("ACG" + x) <= set(t):
            return kind
    if n - acg - both - count("NTX") <= few and both > acg and len(set(t) & set("ACGDHKMRSVWYNT")) >= 15:
        return "amino"
    return None


def test_guess_alphabet_of_all_documents(spark, tmp_path):
    texts = ["ACGT" * 5, "acgu" * 5, "ACGT" * 30 + "HH", "ACGT" * 30 + "HHHH", "ACGA" * 5, "N" * 30, "N" * 2001, "ACGTNNNNACGT ACGT", "ACGDHKMRSVWYNT" * 3, "DHKMRSVWY" * 3, "MKVLAAGIEF", "MKVLAAGIEFL", "ACGT", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.kind for r in registry.QUERIES["guess_alphabet"](spark, str(tmp_path)).collect()}
    assert got == {i: guessed(t) for i, t in enumerate(texts)}
    assert {got[0], got[1], got[4], got[11]} == {"dna", "rna", None, "amino"}


def test_leaf_depths_of_a_ladder(spark):
    """300 levels, each with a leaf, beside a tree of one leaf."""
    rows = [(1, k, k - 1, k + 1, 1000 + k, float(k > 0), 1, None) for k in range(300)]
    rows += [(1, 1000 + k, k, -1, -1, 0.5, 1, f"l{k}") for k in range(300)] + [(2, 0, -1, -1, -1, 0.0, 1, "one")]
    got = {(r.tree_id, r.name): r.depth for r in tree.leaf_depths(spark.createDataFrame(rows, tree.NODE)).collect()}
    assert got == {(1, f"l{k}"): k + 0.5 for k in range(300)} | {(2, "one"): 0.0}


def plain_linkage(d, method):
    """Heights of the merges, each pair of clusters looked at in each step."""
    n = len(d)
    d = {(i, j): d[i][j] for i in range(n) for j in range(n) if i != j}
    size, live, out = dict.fromkeys(range(n), 1), list(range(n)), []
    for node in range(n, 2 * n - 1):
        a, b = min(((i, j) for i in live for j in live if i < j), key=lambda p: (d[p], p))
        out.append((a, b, d[a, b] / (2 if method in ("average", "weighted") else 1)))
        live = [x for x in live if x not in (a, b)]
        for x in live:
            u, v = d[a, x], d[b, x]
            new = {"average": (size[a] * u + size[b] * v) / (size[a] + size[b]), "weighted": (u + v) / 2, "single": min(u, v), "complete": max(u, v)}[method]
            d[node, x] = d[x, node] = new
        size[node] = size[a] + size[b]
        live.append(node)
    return out


@pytest.mark.parametrize("method", ["average", "weighted", "single", "complete"])
def test_linkage_with_ties(method):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 9, 25):
        m = rng.integers(1, 6, (n, n)).astype(float)
        m = np.triu(m, 1) + np.triu(m, 1).T
        t = tree.linkage(m, method)
        want = plain_linkage(m, method)
        assert [(t.left[k], t.right[k]) for k in range(n, 2 * n - 1)] == [w[:2] for w in want]
        assert t.valid()
    with pytest.raises(ValueError, match="more memory"):
        tree.linkage(np.zeros((tree.MOST_LEAVES + 1, 1)))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cells_are_not_broadcast(spark):
    """a table that looks small by its file's size has a row for each cell after it is cut up."""
    plan = registry.QUERIES["shuffle_within_columns"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan


def test_lognormal_leaves_no_value_out(spark):
    """ln 0 is null in Spark, which the means left out."""
    rows = [("a", 1.0), ("a", 0.0), ("b", -1.0), ("b", 2.0), ("c", 1.0), ("c", float(np.e**2))]
    got = {r.grp: (r.mu, r.sigma) for r in statistics.fit_lognormal(spark.createDataFrame(rows, "grp string, x double")).collect()}
    assert got["a"][0] == -np.inf and np.isnan(got["a"][1]) and np.isnan(got["b"]).all() and got["c"] == (1.0, 1.0)


@pytest.mark.parametrize("name", ["shuffled_doublets", "markov_residues"])
def test_shuffles_are_spread(spark, name):
    """the rows of one small file are shuffled by many tasks."""
    assert registry.QUERIES[name](spark, SF).rdd.getNumPartitions() > 1
