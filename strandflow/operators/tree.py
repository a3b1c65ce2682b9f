"""Trees: agglomerative linkage, Newick text, path distances, comparison."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet
from ..sources import scratch
from .pairs import Identities

NODE = "tree_id long, node long, parent long, left long, right long, branch_length double, size long, name string"


@dataclass
class Tree:
    """Leaves 0 to n - 1, inner nodes after their children, the root last; -1 stands for none."""

    parent: list[int]
    left: list[int]
    right: list[int]
    length: list[float]
    size: list[int]
    names: list[str]

    @property
    def leaves(self) -> int:
        return len(self.names)

    def children(self, node: int) -> tuple[int, int]:
        return self.left[node], self.right[node]

    def rows(self, tree_id) -> list[tuple]:
        name = lambda i: self.names[i] if i < self.leaves else None
        return [(tree_id, i, self.parent[i], self.left[i], self.right[i], self.length[i], self.size[i], name(i)) for i in range(len(self.parent))]

    def distances(self) -> np.ndarray:
        """Leaf to leaf path lengths."""
        n = self.leaves
        out, below = np.zeros((n, n)), {i: [(i, 0.0)] for i in range(n)}
        for node in range(n, len(self.parent)):
            a, b = ([(x, d + self.length[c]) for x, d in below.pop(c)] for c in self.children(node))
            for x, dx in a:
                for y, dy in b:
                    out[x, y] = out[y, x] = dx + dy
            below[node] = a + b
        return out

    def clades(self) -> dict[frozenset[str], float]:
        """Length above each set of leaf names."""
        sets: list[frozenset[str]] = [frozenset([x]) for x in self.names]
        for node in range(self.leaves, len(self.parent)):
            a, b = self.children(node)
            sets.append(sets[a] | sets[b])
        return dict(zip(sets, self.length))

    def same(self, other: Tree, tolerance: float) -> bool:
        a, b = self.clades(), other.clades()
        return a.keys() == b.keys() and all(abs(a[k] - b[k]) <= tolerance for k in a)

    def valid(self) -> bool:
        n = len(self.parent)
        for i in range(n):
            kids = [c for c in self.children(i) if c >= 0]
            if (i < self.leaves) == bool(kids) or any(self.parent[c] != i for c in kids):
                return False
            if i >= self.leaves and self.size[i] != sum(self.size[c] for c in kids):
                return False
        return n == 2 * self.leaves - 1 and [i for i in range(n) if self.parent[i] < 0] == [n - 1]


#: Leaves of the largest tree that is built: its distances fill 1,600 MB.
MOST_LEAVES = 20_000


def _starts(n: int) -> np.ndarray:
    """Where, less j, the distances of i to each j > i begin among those of every two."""
    i = np.arange(n)
    return i * n - i * (i + 1) // 2 - i - 1


def _few(n: int) -> int:
    if n > MOST_LEAVES:
        raise ValueError(f"{n} leaves: a tree of over {MOST_LEAVES} needs more memory than a task has")
    return n


def linkage(d: np.ndarray, method: str = "average", names: list[str] | None = None) -> Tree:
    """``average`` (weighted by size), ``weighted`` (plain mean of two), ``single`` or ``complete``. The pair of
    smallest distance is merged, the first such pair in order of node; a node's height is half the distance
    for the two averages and the distance itself for the others."""
    n = _few(len(d))
    return _linked(np.asarray(d, float)[np.triu_indices(n, 1)], n, method, names)


def linkage_of_rows(texts: list[str], abc: Alphabet, method: str, names: list[str] | None = None) -> Tree:
    """``linkage`` by 1 - identity of an alignment's rows. Only one distance of every two is held."""
    n = _few(len(texts))
    known, every, at = Identities(texts, abc), np.arange(n), _starts(n)
    dist = np.empty(n * (n - 1) // 2)
    for lo in range(0, n, 64):
        block = known.between(every[lo : lo + 64], every[lo:])
        for i in range(lo, min(lo + 64, n)):
            dist[at[i] + i + 1 : at[i] + n] = 1 - block[i - lo, i - lo + 1 :]
    return _linked(dist, n, method, names)


def _linked(dist: np.ndarray, n: int, method: str, names: list[str] | None) -> Tree:
    """``linkage`` of the distances of every two, i < j in order of i and j, which are overwritten."""
    names = names or [str(i) for i in range(n)]
    total = 2 * n - 1
    t = Tree([-1] * total, [-1] * total, [-1] * total, [0.0] * total, [1] * total, names)
    # A cluster keeps the place of one of its two parts; ``ids`` names the node that a place holds, -1 for none.
    starts = _starts(n)
    to = lambda r, x: np.where(x < r, starts[x] + r, starts[r] + x)
    ids, height = np.arange(n), np.zeros(total)
    near, least = np.zeros(n, np.int64), np.full(n, np.inf)
    live = np.arange(n)

    def look(r: int) -> None:
        """The nearest cluster with a larger node than that of place ``r``, the smallest node of equal ones."""
        later = live[ids[live] > ids[r]]
        least[r] = np.inf
        if len(later):
            d = dist[to(r, later)]
            least[r] = d.min()
            ties = later[d == least[r]]
            near[r] = ties[ids[ties].argmin()]

    for r in range(n):
        look(r)
    for node in range(n, total):
        own = least[live]
        ties = live[own == own.min()]
        p = int(ties[ids[ties].argmin()])
        if near[p] < 0:
            look(p)
        q = int(near[p])
        a, b = int(ids[p]), int(ids[q])
        gap = float(least[p])
        height[node] = gap / 2 if method in ("average", "weighted") else gap
        t.left[node], t.right[node] = a, b
        t.size[node] = t.size[a] + t.size[b]
        for c in (a, b):
            t.parent[c] = node
            t.length[c] = float(height[node] - height[c])
        live = live[live != q]
        others = live[live != p]
        da, db = dist[to(p, others)], dist[to(q, others)]
        merged = {"average": lambda: (t.size[a] * da + t.size[b] * db) / t.size[node], "weighted": lambda: (da + db) / 2, "single": lambda: np.minimum(da, db), "complete": lambda: np.maximum(da, db)}[method]()
        dist[to(p, others)] = merged
        ids[p], ids[q] = node, -1
        least[p] = least[q] = np.inf  # no node is later than the new one
        lost = (near[others] == p) | (near[others] == q)
        if method == "single":  # the least distance stays; which of those at it is first is looked up when it is needed
            near[others[lost]] = -1
            lost[:] = False
        closer = ~lost & (merged < least[others])  # the new node is the largest: it wins only if it is nearer
        near[others[closer]], least[others[closer]] = p, merged[closer]
        for r in others[lost]:
            look(r)
    return t


def newick(t: Tree) -> str:
    quote = lambda s: s if s and not set(s) & set(" ()[]':;,_") else "'" + s.replace("'", "''") + "'"
    text: dict[int, str] = {}
    for i in range(len(t.parent)):
        own = quote(t.names[i]) if i < t.leaves else "(" + ",".join(text.pop(c) for c in t.children(i)) + ")"
        text[i] = own if i == len(t.parent) - 1 else f"{own}:{t.length[i]!r}"
    return text[len(t.parent) - 1] + ";\n"


def parse_newick(text: str) -> Tree:
    """Binary trees; quoted names, [comments] and labels of inner nodes are read, the last are dropped."""
    tokens, at = [], 0
    while at < len(text):
        c = text[at]
        if c.isspace():
            at += 1
        elif c == "[":
            at = text.index("]", at) + 1
        elif c == "'":
            end = at + 1
            while text[end] != "'" or text[end : end + 2] == "''":
                end += 2 if text[end] == "'" else 1
            tokens.append(("name", text[at + 1 : end].replace("''", "'")))
            at = end + 1
        elif c in "(),:;":
            tokens.append((c, c))
            at += 1
        else:
            end = at
            while end < len(text) and text[end] not in "(),:;[" and not text[end].isspace():
                end += 1
            tokens.append(("name", text[at:end]))
            at = end
    leaves: list[tuple[str, float]] = []
    inner: list[tuple[tuple, tuple, float]] = []
    stack: list[list] = [[]]
    last: list | None = None
    expect_length = False
    for kind, value in tokens:
        if expect_length:
            last[1] = float(value)
            expect_length = False
        elif kind == "(":
            stack.append([])
            last = None
        elif kind == ")":
            kids = stack.pop()
            if len(kids) != 2:
                raise ValueError("only binary trees are read")
            inner.append(None)
            last = [("inner", kids, len(inner) - 1), 0.0]
            stack[-1].append(last)
        elif kind == "name":
            if last is None:
                last = [("leaf", value), 0.0]
                stack[-1].append(last)
        elif kind == ",":
            last = None
        elif kind == ":":
            expect_length = True
    if len(stack) != 1 or len(stack[0]) != 1:
        raise ValueError("unbalanced tree")
    order: list = []
    todo = [stack[0][0]]
    while todo:
        node = todo.pop()
        order.append(node)
        if node[0][0] == "inner":
            todo += node[0][1]
    leaves = [n for n in order[::-1] if n[0][0] == "leaf"]
    nodes = leaves + [n for n in order[::-1] if n[0][0] == "inner"]
    index = {id(n): i for i, n in enumerate(nodes)}
    total = len(nodes)
    t = Tree([-1] * total, [-1] * total, [-1] * total, [float(n[1]) for n in nodes], [1] * total, [n[0][1] for n in leaves])
    for i, n in enumerate(nodes):
        if n[0][0] == "inner":
            a, b = (index[id(k)] for k in n[0][1])
            t.left[i], t.right[i], t.parent[a], t.parent[b], t.size[i] = a, b, i, i, t.size[a] + t.size[b]
    return t


def simulate(leaves: int, seed: int) -> Tree:
    """Leaves joined at random, lengths uniform in [0.01, 1.01)."""
    rng = np.random.default_rng(seed)
    total = 2 * leaves - 1
    t = Tree([-1] * total, [-1] * total, [-1] * total, [0.0] * total, [1] * total, [f"leaf{i}" for i in range(leaves)])
    open_ = list(range(leaves))
    for node in range(leaves, total):
        a = open_.pop(int(rng.integers(len(open_))))
        b = open_.pop(int(rng.integers(len(open_))))
        t.left[node], t.right[node], t.size[node] = a, b, t.size[a] + t.size[b]
        for c in (a, b):
            t.parent[c], t.length[c] = node, float(rng.random() + 0.01)
        open_.append(node)
    return t


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Groups of ``key`` in as many partitions as the session names: their rows are few and small, so that Spark would
    put all into one task, but the work on each is not."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def grouped_trees(rows: DataFrame, abc: Alphabet, method: str = "average") -> DataFrame:
    """Node rows (see NODE) of a tree for each msa_id of (msa_id, idx, aln) with two rows or more, by 1 - identity;
    leaves are the ids in rising order, named by them. A tree is sequential: one task is sent its alignment's rows, and
    makes and holds their distances."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("idx")
        t = linkage_of_rows(f["aln"].tolist(), abc, method, [str(x) for x in f["idx"]])
        return pd.DataFrame(t.rows(key[0]) if len(f) > 1 else [], columns=[c.split()[0] for c in NODE.split(", ")])

    return dealt(rows.select("msa_id", "idx", "aln"), "msa_id").groupBy("msa_id").applyInPandas(run, NODE)


def heights(rows: DataFrame, nodes: DataFrame, abc: Alphabet, method: str) -> DataFrame:
    """(tree_id, node, height, wanted): of each inner node the height over its leaves, and the one that its linkage
    gives to the distances between the leaves under its two children. These are looked at in blocks."""

    def run(key, f: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        t = _of_rows(x)
        place = {str(i): k for k, i in enumerate(f["idx"])}
        known, out = Identities(f["aln"].tolist(), abc), []
        below = {i: np.array([place[name]]) for i, name in enumerate(t.names)}
        share, high = np.ones(len(f)), [0.0] * len(t.parent)
        for node in range(t.leaves, len(t.parent)):
            a, b = t.children(node)
            high[node] = high[a] + t.length[a]
            left, right = below.pop(a), below.pop(b)
            step = max(1, BLOCK // len(right))
            found = []
            for lo in range(0, len(left), step):
                part = left[lo : lo + step]
                d = 1 - known.between(part, right)
                found.append({"average": lambda: d.sum(), "weighted": lambda: share[part] @ d @ share[right], "single": lambda: d.min(), "complete": lambda: d.max()}[method]())  # noqa: B023
            wanted = {"average": lambda: sum(found) / (len(left) * len(right)) / 2, "weighted": lambda: sum(found) / 2, "single": lambda: min(found), "complete": lambda: max(found)}[method]()  # noqa: B023
            below[node] = np.concatenate([left, right])
            share[below[node]] /= 2
            out.append((key[0], node, high[node], float(wanted)))
        return pd.DataFrame(out, columns=["tree_id", "node", "height", "wanted"])

    own = dealt(rows.select(F.col("msa_id").alias("tree_id"), "idx", "aln").join(nodes.select("tree_id").distinct(), "tree_id", "left_semi"), "tree_id")
    return own.groupBy("tree_id").cogroup(dealt(nodes, "tree_id").groupBy("tree_id")).applyInPandas(run, "tree_id long, node long, height double, wanted double")


def _of_rows(f: pd.DataFrame) -> Tree:
    f = f.sort_values("node")
    lists = [f[c].tolist() for c in ("parent", "left", "right", "branch_length", "size")]
    return Tree(*lists, f["name"].dropna().tolist())


def _each(nodes: DataFrame, make, schema: str) -> DataFrame:
    """``make`` of each tree of NODE rows, one held at a time: rows after the tree's number."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in make(_of_rows(f))], columns=[c.split()[0] for c in schema.split(", ")])

    return nodes.groupBy("tree_id").applyInPandas(run, schema)


def newick_text(nodes: DataFrame) -> DataFrame:
    """(tree_id, value)."""
    return _each(nodes, lambda t: [(newick(t),)], "tree_id long, value string")


def read_newick(texts: DataFrame) -> DataFrame:
    """NODE rows of (tree_id, value)."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame([r for key, text in zip(f["tree_id"], f["value"]) for r in parse_newick(text).rows(key)], columns=[c.split()[0] for c in NODE.split(", ")])

    return texts.select("tree_id", "value").mapInPandas(run, NODE)


#: Pairs of leaves that are looked at, or given out, at a time.
BLOCK = 1 << 20


def path_lengths(nodes: DataFrame) -> DataFrame:
    """(tree_id, a, b, d): the path between every two leaves, a < b by name. A tree is a row; its pairs are given out
    in blocks, node by node."""
    fields = [c.split()[0] for c in NODE.split(", ")][1:]

    def parts(key, t: Tree):
        order = sorted(range(t.leaves), key=lambda i: t.names[i])
        names, rank, up = np.array(t.names, object)[order], np.argsort(order), np.zeros(t.leaves)
        below = {i: np.array([i]) for i in range(t.leaves)}
        for node in range(t.leaves, len(t.parent)):
            left, right = (below.pop(c) for c in t.children(node))
            for x, c in zip((left, right), t.children(node)):
                up[x] += t.length[c]
            step = max(1, BLOCK // len(right))
            for lo in range(0, len(left), step):
                part = left[lo : lo + step]
                x, y = np.repeat(rank[part], len(right)), np.tile(rank[right], len(part))
                yield key, names[np.minimum(x, y)], names[np.maximum(x, y)], (up[part][:, None] + up[right]).ravel()
            below[node] = np.concatenate([left, right])

    def run(frames):
        for f in frames:
            for key, packed in zip(f["tree_id"], f["nodes"]):
                rows, size = [], 0
                for part in parts(key, _of_rows(pd.DataFrame([tuple(n[c] for c in fields) for n in packed], columns=fields))):
                    rows.append(part)
                    size += len(part[3])
                    if size >= BLOCK:
                        yield _together(rows)
                        rows, size = [], 0
                if rows:
                    yield _together(rows)

    one = nodes.groupBy("tree_id").agg(F.collect_list(F.struct(*fields)).alias("nodes"))
    one = one.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # in turn: a row is a tree
    return one.mapInPandas(run, "tree_id long, a string, b string, d double")


def _together(parts: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"tree_id": parts[0][0], **{c: np.concatenate([p[i] for p in parts]) for i, c in ((1, "a"), (2, "b"), (3, "d"))}})


def all_valid(nodes: DataFrame) -> DataFrame:
    """(tree_id, is_valid)."""
    return _each(nodes, lambda t: [(t.valid(),)], "tree_id long, is_valid boolean")


def all_same(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """(tree_id, is_same): whether the trees of one number have the same clades, lengths within ``tolerance``."""

    def run(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], len(x) > 0 and len(y) > 0 and _of_rows(x).same(_of_rows(y), tolerance))], columns=["tree_id", "is_same"])

    return a.groupBy("tree_id").cogroup(b.groupBy("tree_id")).applyInPandas(run, "tree_id long, is_same boolean")


def simulated(spark, trees: int, leaves: int, seed: int) -> DataFrame:
    """NODE rows of ``trees`` random trees, each from a seed of its own."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame([r for i in f["id"] for r in simulate(leaves, seed * 1_000_003 + int(i)).rows(int(i))], columns=[c.split()[0] for c in NODE.split(", ")])

    return spark.range(trees).mapInPandas(run, NODE)


def merges(nodes: DataFrame) -> DataFrame:
    """(tree_id, node, height, left, right): of each inner node the height over its leaves, and the leaves under its
    two children as (name, share), a share being halved at each node between."""

    def make(t: Tree):
        below: list[list[tuple[str, float]]] = [[(x, 1.0)] for x in t.names]
        height = [0.0] * len(t.parent)
        for node in range(t.leaves, len(t.parent)):
            a, b = t.children(node)
            height[node] = height[a] + t.length[a]
            below.append([(x, s / 2) for x, s in below[a] + below[b]])
        side = lambda c: [{"name": x, "share": s} for x, s in below[c]]
        return [(node, height[node], side(t.left[node]), side(t.right[node])) for node in range(t.leaves, len(t.parent))]

    leaves = "array<struct<name:string,share:double>>"
    return _each(nodes, make, f"tree_id long, node long, height double, left {leaves}, right {leaves}")


def leaf_depths(nodes: DataFrame) -> DataFrame:
    """(tree_id, name, depth): length from the root to each leaf, by doublings of the parent links until no
    node has an ancestor left, each a join on (tree_id, node). Each doubling ends with a
    written table."""
    up = nodes.select("tree_id", "node", "name", F.col("parent").alias("at"), F.col("branch_length").alias("depth"))
    up = scratch.cut(up, "depths")
    for _ in range(64):
        if up.where("at >= 0").isEmpty():
            break
        above = up.select("tree_id", F.col("node").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        up = up.join(above, ["tree_id", "at"], "left").select("tree_id", "node", "name", F.coalesce("next", F.lit(-1)).alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0.0))).alias("depth"))
        up = scratch.cut(up, "depths")
    else:
        raise ValueError("parent links form a cycle")
    return up.where("name is not null").select("tree_id", "name", "depth")


def sizes_agree(nodes: DataFrame) -> DataFrame:
    """(tree_id, agree): whether every inner node's size is the sum of its children's."""
    kids = nodes.where("parent >= 0").groupBy("tree_id", F.col("parent").alias("node")).agg(F.sum("size").alias("s"))
    return nodes.join(kids, ["tree_id", "node"], "left").groupBy("tree_id").agg(F.min(F.col("size") == F.coalesce("s", F.lit(1))).alias("agree"))
