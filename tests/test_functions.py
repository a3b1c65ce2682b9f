"""Golden values of functions and of the drivers' own algorithms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.functions import codecs, codon, distributions, random, sequence, special, wuss
from strandflow.functions.alphabet import AMINO, DNA, RNA, guess_type
from strandflow.operators import clusters, codes, graphs, matrices, ordering, pairs, scores, statistics, tree


def one(spark, **columns):
    row = spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()
    return row if len(columns) > 1 else row[0]


def test_alphabet(spark):
    assert (DNA.kp, RNA.kp, AMINO.kp) == (18, 18, 29)
    assert one(spark, x=DNA.digitize(F.lit("ACGU-n_I*"))) == [0, 1, 2, 3, 4, 15, 4, 0, 16]
    assert one(spark, x=DNA.reverse_complement(F.lit("ACGTRN-"))) == "-NYACGT"
    assert one(spark, x=DNA.valid(F.lit("ACGE"))) is False
    with pytest.raises(Exception, match="not dna"):
        one(spark, x=DNA.digitize(F.lit("ACGE")))
    with pytest.raises(ValueError):
        AMINO.reverse_complement("x")
    assert one(spark, x=DNA.digitize(F.lit(""))) == []


@pytest.mark.parametrize("text,kind", [("ACGTACGTAC", None), ("ACGTACGTACG", "dna"), ("ACGUACGUACG", "rna"), ("ACGTACGTACGE", "amino"), ("N" * 2001, "dna"), ("ADHKMRSVWYCGTNADHKMRSVWY", None), ("AAAAAAAAAAAAAA", None)])
def test_guess(spark, text, kind):
    assert one(spark, x=guess_type(F.lit(text))) == kind


def jenkins(codes_):
    h = 0
    for c in codes_:
        h = (h + c) & 0xFFFFFFFF
        h = (h + (h << 10)) & 0xFFFFFFFF
        h ^= h >> 6
    h = (h + (h << 3)) & 0xFFFFFFFF
    h ^= h >> 11
    return (h + (h << 15)) & 0xFFFFFFFF


def test_checksum(spark):
    assert one(spark, x=sequence.checksum(F.array(*map(F.lit, [3, 0, 2, 17, 1])))) == jenkins([3, 0, 2, 17, 1])


def test_windows(spark):
    df = spark.createDataFrame([("ACGTACGTAC",)], "s string")
    got = [(r.window_start, r.window_end, r.complete) for r in sequence.windows(df, "s", 4, 2).orderBy("window_start").collect()]
    assert got == [(1, 6, False), (5, 10, True)]
    df = spark.createDataFrame([("AAAACCCC",)], "s string")
    r = sequence.reverse_windows(df, "s", DNA, 8, 2).first()
    assert (r.window, r.window_start, r.window_end) == ("GGGGTTTT", 8, 1)


def test_orfs(spark):
    df = spark.createDataFrame([(1, "ATGGCTTATTAA"), (2, "TTATAGGCCCAT"), (3, None), (4, "AT")], "id long, s string")
    got = {(r.id, r.start, r.end, r.frame, r.strand, r.protein) for r in codon.find_orfs(df, "id", "s", shortest=3).collect()}
    assert (1, 0, 12, 0, "forward", "MAY") in got and (2, 0, 12, 0, "reverse", "MGL") in got
    assert {g[0] for g in got} == {1, 2}


def test_translate(spark):
    assert one(spark, x=codon.translate(F.lit("ATGGCNTARNNN"))) == "MA*X"
    assert one(spark, x=codon.translate(F.lit("AT"))) == ""
    assert codon.CODES[1].translate("MGR") == "R" and codon.CODES[1].is_start("NTG") is False and codon.CODES[2].amino["TGA"] == "W"
    assert len(codon.CODES) == 18 and codon.by_id(7) is None


def pairs_of(n, *links):
    out = [-1] * n
    for a, b in links:
        out[a], out[b] = b, a
    return out


def test_wuss():
    assert wuss.full(pairs_of(9, (0, 8), (1, 7), (2, 6))) == "((<___>))"
    assert wuss.full(pairs_of(12, (0, 11), (1, 10), (3, 8), (4, 7))) == "((-(<__>)-))"
    assert wuss.full(pairs_of(20, (0, 19), (2, 8), (3, 7), (11, 17), (12, 16))) == "(,(<___>),,(<___>),)"
    assert wuss.full([-1] * 4) == "::::"
    assert wuss.pair_list("<<a>>A") == [4, 3, 5, 1, 0, 2] and wuss.pair_list("<(>)") == [2, 3, 0, 1]
    assert wuss.pair_list("<<>") is None
    assert wuss.drop_broken("<<..>>", [True, False, True, True, True, True]) == "<....>"
    assert wuss.lettered(wuss.pair_list("<<..aa..>>..AA")) == "<<..aa..>>..AA"


def test_gumbel_at_mode(spark):
    D = distributions.Gumbel
    r = one(spark, p=D.pdf(F.lit(0.0), 0.0, 1.0), c=D.cdf(F.lit(0.0), 0.0, 1.0), s=D.surv(F.lit(0.0), 0.0, 1.0))
    assert r == pytest.approx((math.exp(-1), math.exp(-1), 1 - math.exp(-1)))


@pytest.mark.parametrize("D,a", [(distributions.Gumbel, (3.0, 0.7)), (distributions.Exponential, (1.0, 0.4)), (distributions.Weibull, (0.0, 0.5, 1.7)), (distributions.Gev, (1.0, 0.5, 0.3)), (distributions.Gev, (1.0, 0.5, -0.3)), (distributions.Normal, (2.0, 3.0)), (distributions.Lognormal, (0.5, 0.9)), (distributions.Gamma, (0.0, 0.5, 2.2))])
def test_round_trips(spark, D, a):
    df = spark.createDataFrame([(p / 20,) for p in range(1, 20)], "p double").withColumn("x", D.invcdf("p", *a))
    for p, c, s in df.select("p", D.cdf("x", *a), D.surv("x", *a)).collect():
        assert c == pytest.approx(p, abs=1e-7) and c + s == pytest.approx(1, abs=1e-9)


def test_special():
    assert special.digamma(1) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert special.trigamma(1) == pytest.approx(math.pi**2 / 6, abs=1e-10)
    for a, x in ((0.5, 0.2), (3, 1), (3, 9), (40, 30)):
        p, q = special.gamma_p_q(a, x)
        assert p + q == pytest.approx(1)
    assert special.chi_squared_tail(1, 3.841458820694124) == pytest.approx(0.05)
    assert special.bisect(lambda x: x * x - 2, 0, 2) == pytest.approx(math.sqrt(2))
    assert special.newton(lambda x: x * x - 2, lambda x: 2 * x, 1.0) == pytest.approx(math.sqrt(2))
    x, value, done = special.minimize(lambda p: float((p[0] - 1) ** 2 + 10 * (p[1] + 2) ** 2), lambda p: [2 * (p[0] - 1), 20 * (p[1] + 2)], [0.0, 0.0])
    assert done and x == pytest.approx([1, -2], abs=1e-3)


def test_fits(spark):
    rng = np.random.default_rng(3)
    df = lambda x: spark.createDataFrame([("a", float(v)) for v in x], "grp string, x double")
    gumbel = df(10 - np.log(-np.log(rng.random(4000))) / 0.5)
    for fit in (statistics.fit_gumbel(gumbel), statistics.fit_gumbel_censored(gumbel, 10.0), statistics.fit_gumbel_truncated(gumbel, 9.0)):
        r = fit.first()
        assert abs(r.mu - 10) < 0.4 and abs(r.rate - 0.5) < 0.06
    r = statistics.fit_gev(df(10 + ((-np.log(rng.random(4000))) ** -0.2 - 1) / 0.2)).first()
    assert abs(r.mu - 10) < 0.15 and abs(r["shape"] - 0.2) < 0.06
    r = statistics.fit_gamma(df(rng.gamma(2.5, 2.0, 4000)), 0.0).first()
    assert abs(r["shape"] - 2.5) < 0.2 and abs(r.rate - 0.5) < 0.05
    r = statistics.fit_weibull(df(3 + rng.weibull(1.4, 4000) * 2)).first()
    assert abs(r["shape"] - 1.4) < 0.1 and abs(r.rate - 0.5) < 0.05


def rows(spark, *texts):
    return spark.createDataFrame([(1, i, f"s{i}", t) for i, t in enumerate(texts)], "msa_id long, idx long, name string, aln string")


def test_pairs(spark):
    def pid(a, b):
        return pairs.pairs(rows(spark, a, b), DNA, len(a)).select(pairs.identity()).first()[0]

    assert pid("AA-A", "AAA-") == pytest.approx(2 / 3) and pid("A-G-T", "A-C-T") == pytest.approx(2 / 3) and pid("---", "---") == 0
    long = "ACGTN" * 30
    assert pid(long, long) == 1
    r = one(spark, a=pairs.jukes_cantor(F.lit(0.7), 4), b=pairs.jukes_cantor(F.lit(0.2), 4), c=pairs.kimura(F.lit(0.0)))
    assert r[0] == pytest.approx(-0.75 * math.log(0.6)) and r[1] == math.inf and r[2] == math.inf
    d = {(r.i, r.j): r.d for r in pairs.distances(rows(spark, "AAAA", "AATT", "TTTT"), DNA, 4).collect()}
    assert d == {(0, 1): 0.5, (0, 2): 1.0, (1, 2): 0.5}


def weights(df):
    return [r.weight for r in df.orderBy("idx").collect()]


def test_weights(spark):
    r = rows(spark, "ACGT", "ACGT", "TTTT")
    assert weights(clusters.position_weights(r, DNA)) == pytest.approx([13 / 16, 13 / 16, 11 / 8])
    assert weights(clusters.blosum_weights(r, DNA, 4, 0.62)) == pytest.approx([0.75, 0.75, 1.5])
    w = weights(clusters.tree_weights(r, DNA))
    assert sum(w) == pytest.approx(3) and w[2] > w[0]
    assert weights(clusters.tree_weights(rows(spark, "AC", "AC"), DNA)) == [1, 1]
    assert [x.kept for x in clusters.filter_by_identity(r, DNA, 0.9).orderBy("idx").collect()] == [True, False, True]


def test_trees():
    d = np.array([[0, 0.4, 0.8], [0.4, 0, 0.8], [0.8, 0.8, 0]])
    t = tree.linkage(d, "average", ["A", "B", "C"])
    assert [t.length[i] for i in (0, 1, 3, 2)] == pytest.approx([0.2, 0.2, 0.2, 0.4])
    assert t.valid() and t.distances() == pytest.approx(d)
    back = tree.parse_newick(tree.newick(t))
    assert back.same(t, 1e-12) and back.valid()
    labelled = tree.parse_newick("(('a b':0.1,B:0.2)95:0.3,C:0.4)root; ")
    assert labelled.names and set(labelled.names) == {"a b", "B", "C"} and labelled.valid()
    with pytest.raises(ValueError):
        tree.parse_newick("(A,B,C);")
    s = tree.simulate(20, 1)
    assert s.valid() and tree.parse_newick(tree.newick(s)).same(s, 1e-12)


def test_matrices():
    rng = np.random.default_rng(0)
    a = rng.random((6, 6))
    order, l, u = matrices.lu(a)
    assert l @ u == pytest.approx(a[order]) and matrices.inverse(a) @ a == pytest.approx(np.eye(6))
    with pytest.raises(ValueError):
        matrices.inverse(np.ones((3, 3)))
    pi = np.array([0.1, 0.2, 0.3, 0.4])
    q = matrices.hky(2, 1, pi)
    assert matrices.is_rate_matrix(q) and -(pi * np.diag(q)).sum() == pytest.approx(1)
    p = matrices.exponential(q, 0.7)
    assert matrices.is_probability_matrix(p) and p == pytest.approx(matrices.exponential_from_eigen(matrices.eigen_reversible(q, pi), 0.7))
    assert matrices.relative_entropy(p, pi) > 0 > matrices.expected_score(p, pi)


def test_scores(spark):
    m = scores.identity_matrix(5, -4)
    f = np.full(20, 0.05)
    scale, p = m.scale_for(f, f)
    assert p.sum() == pytest.approx(1) and m.relative_entropy(f, scale) > 0
    assert (scores.read_scores(m.text()).canonical() == m.canonical()).all()
    assert one(spark, a=m.score_symbols(F.lit("W"), F.lit("w")), b=m.score_symbols(F.lit("W"), F.lit("!"))) == (5, None)
    assert (scores.from_pairs(p, f, f, scale).canonical() == m.canonical()).all()


def test_codes(spark):
    h = codes.Huffman.build({"a": 5, "b": 2, "c": 1, "d": 0})
    assert h.words == {"a": "0", "b": "10", "c": "11"} and codes.Huffman.build({"x": 3}).words == {"x": "0"}
    assert one(spark, x=h.encode(F.lit("abca"))) == "010110"
    assert one(spark, x=h.decode(F.lit("010110"))) == "abca"
    assert one(spark, x=codecs.varint_encode(F.lit(300))) == "AC02"
    big = (1 << 62) + 5
    assert one(spark, x=codecs.varint_decode(codecs.varint_encode(F.lit(big)))) == big
    assert one(spark, x=codecs.elias_delta(F.lit(17))) == "001010001"
    for c in ([], [0], [3] * 15, [0, 1, 2, 3] * 10, [0, 17, 2], [1] * 16 + [9]):
        assert codes.unpack(codes.pack5(c)) == c and codes.unpack(codes.pack2(c)) == c


def test_special_batches_and_columns(spark):
    x = np.concatenate([np.linspace(0.01, 30, 400), [100.0, 1e3]])
    assert special.erfc(np.array([-2.0, 0.0, 0.5, 6.0, np.inf])) == pytest.approx([math.erfc(v) for v in (-2, 0, 0.5, 6, math.inf)], rel=1e-12)
    assert special.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-13)
    for a in (0.5, 3.0, 40.0):
        assert special.gamma_p_q_all(a, x)[1] == pytest.approx([special.gamma_p_q(a, v)[1] for v in x], rel=1e-9, abs=1e-300)
    assert np.isnan(special.gamma_p_q_all(1.0, np.array([np.nan]))[0][0])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for r in df.select("x", special.log_gamma_column("x").alias("l"), special.digamma_column("x").alias("d"), special.trigamma_column("x").alias("t")).collect():
        assert (r.l, r.d, r.t) == (pytest.approx(math.lgamma(r.x), rel=1e-11, abs=1e-12), pytest.approx(special.digamma(r.x), rel=1e-11, abs=1e-12), pytest.approx(special.trigamma(r.x), rel=1e-10))


def test_solvers_of_columns(spark):
    r = one(spark, a=special.bisect_column(lambda y: y * y * y - 5.0, 0.0, 3.0), b=special.newton_column(lambda y: F.exp(y) - 3.0, lambda y: F.exp(y), F.lit(1.0)))
    assert r == (pytest.approx(5 ** (1 / 3)), pytest.approx(math.log(3)))


def test_random_columns(spark):
    df = spark.range(20000).select("id", random.uniform(1, "id").alias("u"), random.gaussian(1, "id").alias("g"), random.gamma(1, "id", 3.0).alias("m"), random.gamma(1, "id", 0.4).alias("s"), random.choose(1, "id", [0.1, 0.9]).alias("c"), random.integer(1, "id", 7).alias("i"))
    r = df.agg(F.avg("u"), F.avg("g"), F.stddev("g"), F.avg("m"), F.avg("s"), F.avg("c"), F.min("i"), F.max("i"), F.count_distinct("u")).first()
    assert r[:6] == pytest.approx((0.5, 0.0, 1.0, 3.0, 0.4, 0.9), abs=0.04) and r[6:] == (0, 6, 20000)
    assert [x.u for x in df.repartition(7).orderBy("id").limit(5).collect()] == [x.u for x in df.orderBy("id").limit(5).collect()]


def test_fits_of_groups_without_one(spark):
    """Constant groups, too few values and none over the cut are null beside a group that has a fit."""
    rng = np.random.default_rng(2)
    rows = [("ok", float(x)) for x in 5 + rng.gumbel(size=300)] + [("same", 2.0)] * 20 + [("one", 1.0), ("low", -50.0), ("low", -51.0), ("low", -52.5)]
    df = spark.createDataFrame(rows, "grp string, x double")
    for fit in (statistics.fit_gumbel(df), statistics.fit_gumbel_censored(df, 4.0), statistics.fit_gumbel_truncated(df, 4.0), statistics.fit_gamma(df, -100.0), statistics.fit_weibull(df), statistics.fit_gev(df)):
        got = {r.grp: r.rate for r in fit.collect()}
        assert set(got) == {"ok", "same", "one", "low"} and got["ok"] > 0 and got["same"] is None and got["one"] is None


def truncated_loss(x, cut, mu, rate):
    z = rate * (x - mu)
    return float((z + np.exp(-z)).mean()) - math.log(rate) + math.log(-math.expm1(-math.exp(min(rate * (mu - cut), 700.0))))


def test_truncated_fits_are_the_least_on_a_grid(spark):
    """Evenly spread values, exponential ones, heavier ones, two tops of which either is higher, and values far over the
    cut; with each, whether the likelihood is highest at a finite mu."""
    p = (np.arange(400) + 0.5) / 400
    values = {"even": (20 + 470 * p, True), "nearly": (20 - 50 * np.log1p(-0.99 * p), True), "heavy": (20 + 5 * (p**-0.4 - 1), False)}
    values |= {"inner": (20 + np.repeat([0.08, 0.1, 1.66], [150, 84, 7]), True), "outer": (20 + np.repeat([0.014, 0.022, 0.23], [166, 164, 18]), False), "far": (5000 - np.log(-np.log(p)), True)}
    df = spark.createDataFrame([(g, float(v)) for g, (x, _) in values.items() for v in x], "grp string, x double")
    got = {r.grp: r for r in statistics.fit_gumbel_truncated(df, 20.0).collect()}
    for g, (x, top) in values.items():
        mu, rate = got[g].mu, got[g].rate
        least = min(truncated_loss(x, 20.0, 20 + t / r, r) for r in np.geomspace(rate / 10, rate * 10, 61) for t in np.linspace(-36, 36, 73))
        steps = [truncated_loss(x, 20.0, mu * (1 + a), rate * (1 + b)) for a, b in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3))]
        assert truncated_loss(x, 20.0, mu, rate) <= min([least, *steps]) + 1e-11, g
        assert got[g].converged is top, g
        assert top or rate == pytest.approx(1 / (x - 20).mean(), rel=1e-12)
    assert got["far"].mu == pytest.approx(5000, abs=0.1) and got["far"].rate == pytest.approx(1, abs=0.05)


def test_largest_values_across_parts(spark):
    """Ranks and tails of uneven, constant and infinite groups against a sort."""
    rng = np.random.default_rng(9)
    values = {"wide": np.concatenate([rng.random(3000), [1e9, 1e9, 5e8]]), "same": np.full(50, 3.0), "few": np.array([2.0]), "far": np.array([1.0, math.inf, 2.0, 2.0])}
    df = spark.createDataFrame([(g, float(x)) for g, v in values.items() for x in v] + [("wide", None)], "grp string, x double").repartition(5)
    for rank in (0, 2, 40):
        assert {r.grp: r.x for r in statistics.ranked(df, rank).collect()} == {g: sorted(v)[::-1][rank] for g, v in values.items() if len(v) > rank}
    got = sorted((r.grp, r.place, r.x) for r in statistics.tail_by_mass(df, 0.3).collect())
    assert got == sorted((g, i, x) for g, v in values.items() for i, x in enumerate(sorted(v)[len(v) - math.ceil(len(v) * 0.3) :]))
    placed = sorted((r.grp, r.place, r.x) for r in statistics.sorted_data(df).collect())
    assert placed == sorted((g, i, float(x)) for g, v in values.items() for i, x in enumerate(sorted(v)))


def test_numbered_over_partitions(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, f"n{i}") for i in range(1000)], "k long, name string")
    assert {(r.k, r.place) for r in ordering.numbered(df, ["k"], "place").collect()} == {(k, k) for k in range(1000)}
    assert ordering.numbered(df.where("k < 0"), ["k"], "place").count() == 0
    same = sorted(r.place for r in ordering.numbered(df.withColumn("g", F.lit(None).cast("string")), ["g", "k"], "place", within="g").collect())
    assert same == list(range(1000))


def test_pairs_in_blocks(spark):
    texts = ["".join(np.random.default_rng(i).choice(list("ACG-"), 40)) for i in range(30)]
    df = rows(spark, *texts)
    whole, parts = (sorted(map(tuple, p.collect())) for p in (pairs.pairs(df, DNA, 40), pairs.pairs(df, DNA, 40, block_rows=4)))
    assert whole == parts and len(whole) == 30 * 29 // 2


def test_independent_pair(spark):
    rng = np.random.default_rng(3)
    links = sorted({(0, int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (150, 2)) if a != b}) + [(1, 0, 1)]
    v = spark.createDataFrame([(0, i) for i in range(60)] + [(1, i) for i in range(3)], "g long, i long")
    side = {(r.g, r.i): r.side for r in graphs.independent_pair(v, spark.createDataFrame(links, "g long, i long, j long")).collect()}
    assert len(side) == 63 and all({side[g, i], side[g, j]} != {1, 2} for g, i, j in links)
    near = {k: set() for k in side}
    for g, i, j in links:
        near[g, i].add(side[g, j])
        near[g, j].add(side[g, i])
    assert all(s or near[k] >= {1, 2} for k, s in side.items())
    assert sum(s == 1 for (g, _), s in side.items() if g == 0) >= sum(s == 2 for (g, _), s in side.items() if g == 0) > 0


def test_wag_rates():
    q, pi = matrices.wag(), np.array(scores.BACKGROUNDS["wag"])
    assert q.shape == (20, 20) and matrices.is_rate_matrix(q, 1e-9) and q[1, 0] / pi[0] * pi[1] / q[0, 1] == pytest.approx(1)
    order = "ACDEFGHIKLMNPQRSTVWY"
    s = q / pi[None, :]
    at = lambda a, b: s[order.index(a), order.index(b)] / s[order.index("C"), order.index("A")] * 1.02704
    assert (at("E", "D"), at("K", "R"), at("Y", "W")) == pytest.approx((6.17416, 5.35142, 2.48539))


def test_aliases_of_unknown_names(spark):
    index = spark.createDataFrame([("a", 3)], "name string, seq_len long")
    assert codes.with_aliases(index, spark.createDataFrame([("x", "a")], "alias string, name string")).count() == 2
    with pytest.raises(Exception, match="unknown name b"):
        codes.with_aliases(index, spark.createDataFrame([("x", "b")], "alias string, name string")).collect()


def test_packed_columns(spark):
    for c in ([], [0], [3] * 15, [0, 1, 2, 3] * 10, [0, 17, 2], [1] * 16 + [9]):
        a = F.array(*map(F.lit, c)).cast("array<int>")
        r = one(spark, five=codes.packed(a), back=codes.unpacked(codes.packed(a)), two=codes.unpacked(codes.packed(a, True)))
        assert (r.five, r.back, r.two) == (codes.pack5(c), c, c)
