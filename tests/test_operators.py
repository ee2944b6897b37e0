"""Hand-computed and numpy fixtures for the gene-program operators."""

import math

import numpy as np
import pytest

from tissueloom.functions import special
from tissueloom.operators import counts as C
from tissueloom.operators import network as N
from tissueloom.operators import otnmf
from tissueloom.operators import programs as P
from tissueloom.operators import spatial as S
from tissueloom.sources import readers, writers


def test_distribution_functions():
    assert special.f_survival(3, 2, 2) == pytest.approx(0.25)
    assert special.chi2_quantile(0.5, 2) == pytest.approx(1.386294, abs=1e-6)
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert special.hypergeometric_tail(1, 10, 5, 2) == pytest.approx(1 - 10 / 45)
    assert special.f_survival(0, 3, 3) == 1 and special.chi2_quantile(0, 3) == 0


def test_adjusted_p_values(spark):
    rows = C.adjust_p_values(spark.createDataFrame([(p,) for p in (0.01, 0.02, 0.03, 0.5)], "p_value double")).orderBy("p_value").collect()
    assert [r.p_value_adj for r in rows] == pytest.approx([0.04, 0.04, 0.04, 0.5])


def test_marker_score_and_overlap(spark):
    sets = spark.createDataFrame([("s", g) for g in "abc"], "set_name string, gene string")
    ranked = spark.createDataFrame([("p", g, i + 1) for i, g in enumerate("bxa")], "program string, gene string, rank int")
    assert P.mean_rank_score(sets, ranked).first().score == pytest.approx(4 / 3)
    lists = spark.createDataFrame([("l", g, i + 1) for i, g in enumerate("abc")] + [("m", g, i + 1) for i, g in enumerate("acb")] + [("z", g, i + 1) for i, g in enumerate("xyz")], "name string, item string, rank int")
    plain = {(r.a, r.b): r.score for r in P.rank_biased_overlap(lists, lists, p=1).collect()}
    assert plain["l", "m"] == pytest.approx((1 + 0.5 + 1) / 3) and ("l", "z") not in plain
    assert {(r.a, r.b): r.score for r in P.rank_biased_overlap(lists, lists).collect()}["l", "l"] == pytest.approx(1)


def test_greedy_match(spark):
    s = spark.createDataFrame([("A", "x", 0.9), ("A", "y", 0.8), ("B", "x", 0.85), ("B", "y", 0.1)], "a string, b string, score double")
    assert {(r.a, r.b) for r in P.greedy_match(s).collect()} == {("A", "x"), ("B", "y")}


def test_quantile_threshold(spark):
    u = spark.createDataFrame([(f"s{i}", "p", float(i)) for i in range(12)], "spot string, program string, usage double")
    assert sorted(r.usage for r in P.quantile_threshold(u).collect())[-3:] == [0.0, 10.0, 11.0]


def test_gene_scores_match_numpy(spark):
    draw = np.random.default_rng(1)
    x, u = draw.poisson(1.0, (40, 6)).astype(float), draw.random((40, 3))
    counts = spark.createDataFrame([(f"s{i}", f"g{j}", float(x[i, j])) for i in range(40) for j in range(6) if x[i, j]], "spot string, gene string, count double")
    usage = spark.createDataFrame([(f"s{i}", f"p{j}", float(u[i, j])) for i in range(40) for j in range(3)], "spot string, program string, usage double")
    z = (x - x.mean(0)) / x.std(0)
    want = (np.linalg.pinv(u) @ z).T
    got = {(r.gene, r.program): r.score for r in P.gene_scores(counts, usage).collect()}
    assert all(got[f"g{j}", f"p{k}"] == pytest.approx(want[j, k], abs=1e-9) for j in range(6) for k in range(3))


def test_zero_variance_gene_is_not_selected(spark):
    rows = [(f"s{i}", "flat", 2.0) for i in range(30)] + [(f"s{i}", f"g{j}", float(1 + (i * j) % 7)) for i in range(30) for j in range(1, 9)]
    out = {r.gene: r for r in C.overdispersed_genes(spark.createDataFrame(rows, "spot string, gene string, count double")).collect()}
    assert out["flat"].p_value == 1 and not out["flat"].is_odg and out["flat"].gene_scale_factor == 0 and out["flat"].v == -math.inf


def test_pair_stats_and_groups(spark):
    u = spark.createDataFrame([("1", "a", 1.0), ("1", "b", 1.0), ("2", "a", 1.0), ("3", "a", 1.0), ("3", "b", 1.0), ("4", "a", 1.0), ("4", "b", 1.0)], "spot string, program string, usage double")
    s = {(r.one, r.two): r for r in N.pair_stats(u).collect()}
    assert s["a", "b"].val == pytest.approx(4 / 6) and s["a", "a"].neg == 0
    links = spark.createDataFrame([("A", "B", 1.0), ("B", "A", 1.0), ("A", "C", 1.0)], "source string, target string, weight double")
    clusters = spark.createDataFrame([("A", 0), ("B", 0), ("C", 1)], "program string, cluster int")
    g = {(r.program, r.cluster): (r.n_in, r.n_out) for r in N.group_connections(links, clusters).collect()}
    assert g["A", 0] == (1, 1) and g["A", 1] == (0, 1) and g["C", 0] == (1, 0)
    two = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "xy" for i in range(4) for j in range(4) if i != j] + [("x0", "y0", 0.05)]
    nodes = spark.createDataFrame([(f"{c}{i}",) for c in "xy" for i in range(4)] + [("lone",)], "program string")
    found = {r.program: r.cluster for r in N.communities(spark.createDataFrame(two, links.schema), nodes).collect()}
    assert found["lone"] == -1 and len({found[f"x{i}"] for i in range(4)}) == 1 and found["x1"] != found["y1"]


def test_bins(spark):
    p = spark.createDataFrame([(500.0, 10.0, 1.0)], "x double, y double, value double")
    assert S.grid_bins(p, 500).first().bx == 1 and S.grid_bins(p, 500, open_=True).count() == 0
    d = spark.createDataFrame([(0.05,), (0.0500001,), (0.0,)], "x double")
    assert [r[0] for r in d.select(S.density_bin("x")).collect()] == ["D0", "D1", "D0"]


def test_factorisation_invariants(spark):
    draw = np.random.default_rng(0)
    a, g = draw.random((6, 5)), draw.standard_normal((6, 5)) * 0.1
    a /= a.sum(0)
    k = otnmf.kernel(a + 1e-6, 0.5)
    _, gradient = otnmf.transport(a, g, k, 0.5)
    step = 1e-6
    for i, j in ((0, 0), (3, 2), (5, 4)):
        e = np.zeros_like(g)
        e[i, j] = step
        assert (otnmf.transport(a, g + e, k, 0.5)[0] - otnmf.transport(a, g - e, k, 0.5)[0]) / (2 * step) == pytest.approx(gradient[i, j], abs=1e-6)
    rows = [(f"s{i}", f"g{j}", float(draw.poisson(5 if (i % 2) == (j % 2) else 0.2))) for i in range(12) for j in range(6)]
    usage, spectra, losses = otnmf.factorise(spark.createDataFrame(rows, "spot string, gene string, count double"), otnmf.Settings(k=2, inner=20, outer=2))
    assert all(abs(r[1] - 1) < 1e-9 for r in usage.groupBy("spot").sum("usage").collect())
    assert all(abs(r[1] - 1) < 1e-9 for r in spectra.groupBy("program").sum("weight").collect())
    assert np.isfinite(losses).all()
    with pytest.raises(ValueError):
        otnmf.Settings(k=1)


def test_factorisation_alternates_both_half_steps(spark):
    draw = np.random.default_rng(3)
    x = draw.poisson(2.0, (6, 15)).astype(float) + np.eye(6, 15)
    x[0] += 1
    s = otnmf.Settings(k=2, inner=15, outer=2)
    rows = [(f"s{j:02}", f"g{i}", float(x[i, j])) for i in range(6) for j in range(15) if x[i, j]]
    usage, spectra, losses = otnmf.factorise(spark.createDataFrame(rows, "spot string, gene string, count double"), s)
    # the whole matrix at once, as the formulas stand
    a = x + 1e-6
    a /= a.sum(0)
    n, spots = a.shape
    kern = otnmf.kernel(a + 1e-6, s.eps)
    h = np.random.default_rng(s.seed).random((n, s.k))
    h /= h.sum(0)
    c_h, c_w = s.h / (s.k * math.log(n)), s.w / (spots * math.log(s.k))
    g, want = np.zeros_like(a), []

    def minimise(g, pull):
        m = v = np.zeros_like(g)
        for t in range(1, s.inner + 1):
            d = otnmf.transport(a, g, kern, s.eps)[1] - pull(g)
            m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
            g = g - s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return g

    def total():
        return -otnmf.transport(a, g, kern, s.eps)[0] / spots + (h @ w * g).sum() / spots + c_h * (h * (np.log(h) - 1)).sum() + c_w * (w * (np.log(w) - 1)).sum()

    for _ in range(s.outer):
        g = minimise(g, lambda g: h @ otnmf.softmin(h.T @ g / (c_w * spots)))
        w = otnmf.softmin(h.T @ g / (c_w * spots))
        want.append(total())
        g = minimise(g, lambda g: otnmf.softmin(g @ w.T / (c_h * spots)) @ w)
        h = otnmf.softmin(g @ w.T / (c_h * spots))
        want.append(total())
    assert losses == pytest.approx(want, abs=1e-8)
    assert all(r.weight == pytest.approx(h[int(r.gene[1:]), int(r.program[3:]) - 1], abs=1e-7) for r in spectra.collect())
    assert all(r.usage == pytest.approx(w[int(r.program[3:]) - 1, int(r.spot[1:])], abs=1e-7) for r in usage.collect())


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "sets.gmt").write_text("one\tdesc\ta\t b\ntwo\tdesc\tc\n")
    got = [(r.collection, r.set_name, r["rank"], r.gene) for r in readers.gene_sets(spark, str(tmp_path / "sets.gmt")).orderBy("set_name", "rank").collect()]
    assert got == [("sets", "one", 1, "a"), ("sets", "one", 2, "b"), ("sets", "two", 1, "c")]
    m = tmp_path / "m"
    m.mkdir()
    (m / "matrix.mtx").write_text("%%MatrixMarket\n% c\n2 3 2\n1 1 5\n2 3 7\n")
    (m / "features.tsv").write_text("ga\tx\ngb\tx\n")
    (m / "barcodes.tsv").write_text("A-1\nB-1\nC-2\n")
    cells = readers.matrix_market(spark, str(m))
    assert {(r.spot, r.gene, r["count"]) for r in cells.collect()} == {("A-1", "ga", 5.0), ("C-2", "gb", 7.0)}
    (tmp_path / "gem.csv").write_text("barcode,GRCh38,mm10\nA,3,1\n")
    assert readers.species(spark, str(tmp_path / "gem.csv")).first().admix == 0.25
    ranked = spark.createDataFrame([("p", "a", 1), ("p", "b", 2)], "program string, gene string, rank int")
    writers.gene_sets(ranked, "made", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "p\tmade\ta\tb"


def test_boxes_of_equal_corners_meet_as_one_and_are_dealt(spark):
    """Many boxes of one place in a single partition: all pairs, null ids too, from several tasks."""
    rows = [(i if i else None, float(i % 3) * 7, 10.0 * (i % 2), float(i % 3) * 7 + 1.5, 10.0 * (i % 2) + 1.5) for i in range(60)]
    boxes = spark.createDataFrame(rows, "box_id long, x0 double, y0 double, x1 double, y1 double").coalesce(1)
    found = S.boxes_over_squares(boxes, boxes.withColumnRenamed("box_id", "square_id"), 5.0)
    want = sorted((str(a[0]), str(b[0])) for a in rows for b in rows if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    assert sorted((str(r.box_id), str(r.square_id)) for r in found.collect()) == want
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_factorisation_in_one_task_equals_that_over_many(spark, monkeypatch):
    """Where the spots fit a task, few jobs run however many steps; the result is that of a job for each step."""
    draw = np.random.default_rng(7)
    rows = [(f"s{j:02}", f"g{i}", float(x)) for i, line in enumerate(draw.poisson(2.0, (6, 70)) + 1) for j, x in enumerate(line)]
    frame = spark.createDataFrame(rows, "spot string, gene string, count double")
    s = otnmf.Settings(k=2, inner=25, outer=2)
    spark.sparkContext.setJobGroup("lone", "")
    usage, spectra, losses = otnmf.factorise(frame, s)
    usage = {(r.spot, r.program): r.usage for r in usage.collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("lone"))
    spark.sparkContext.setJobGroup("many", "")
    monkeypatch.setattr(otnmf, "CELLS", 100)
    many, other, noted = otnmf.factorise(frame, s)
    assert jobs < 30 and losses == pytest.approx(noted, abs=1e-9)
    assert usage == pytest.approx({(r.spot, r.program): r.usage for r in many.collect()}, abs=1e-7)
    assert {(r.gene, r.program): r.weight for r in spectra.collect()} == pytest.approx({(r.gene, r.program): r.weight for r in other.collect()}, abs=1e-7)


def test_usage_step_stops_each_spot_at_the_tolerance(monkeypatch):
    """The W half-step ends at the inner tolerance as the H half-step does, spot by spot, at the minimum."""
    draw = np.random.default_rng(5)
    a = draw.random((8, 30)) + 0.05
    a /= a.sum(0)
    kern, h = otnmf.kernel(a + 1e-6, 0.05), draw.random((8, 3))
    h /= h.sum(0)
    s = otnmf.Settings(k=3, inner=1000)
    stepped = []
    monkeypatch.setattr(otnmf, "descend", lambda *x, step=otnmf.descend: stepped.append(x[0].shape[1]) or step(*x))
    g, w = otnmf.usage_step(a, np.zeros_like(a), kern, h, s)
    assert len(stepped) < s.inner and stepped[-1] < 30
    alone, own = otnmf.usage_step(a[:, 4:5], np.zeros((8, 1)), kern, h, s)
    assert g[:, 4:5] == pytest.approx(alone, abs=1e-6) and w[:, 4:5] == pytest.approx(own, abs=1e-6)
    assert np.abs(otnmf.transport(a, g, kern, s.eps)[1] - h @ w).sum(0).max() < 1e-4


def test_steps_of_a_few_tasks_cells_need_no_jobs(spark, monkeypatch):
    draw = np.random.default_rng(11)
    rows = [(f"s{j:02}", f"g{i}", float(x)) for i, line in enumerate(draw.poisson(2.0, (6, 70)) + 1) for j, x in enumerate(line)]
    monkeypatch.setattr(otnmf, "CELLS", 150)
    spark.sparkContext.setJobGroup("cells", "")
    usage, _, _ = otnmf.factorise(spark.createDataFrame(rows, "spot string, gene string, count double"), otnmf.Settings(k=2, inner=25, outer=2))
    assert usage.count() == 140 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("cells")) < 30
