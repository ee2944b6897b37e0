"""Operators beyond SQL: p-values, loaders, the command line, shipping, down-sampling, samples."""

import math
import subprocess
import sys
import textwrap
from pathlib import Path

import numpy as np
import pytest

from tissueloom import cli
from tissueloom.functions import special
from tissueloom.operators import annotation as A
from tissueloom.operators import counts as C
from tissueloom.operators import network as N
from tissueloom.operators import otnmf
from tissueloom.operators import simulation as M
from tissueloom.operators import statistics as T
from tissueloom.sources import loaders, readers, writers


def test_p_values(spark):
    rows = [("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("b", float(x)) for x in (3, 4, 5, 6, 9)]
    values = spark.createDataFrame(rows, "category string, value double")
    w = T.welch_p_values(values).first()
    assert w.t == pytest.approx(-2.4 / math.sqrt(1.56)) and w.df == pytest.approx(1.56**2 / (0.5**2 / 4 + 1.06**2 / 4)) and 0.09 < w.p_value < 0.10
    m = T.mann_whitney(values, "a", "b").first()
    assert (m.n1, m.n2, m.u) == (5, 5, 4.5) and m.p_value == pytest.approx(math.erfc(abs(m.z) / math.sqrt(2)))
    f = T.fisher_exact(spark.createDataFrame([(8, 2, 1, 5)], "a long, b long, c long, d long")).first()
    assert f.odds_ratio == 20 and f.p_greater == pytest.approx(0.0244755, abs=1e-6)


def test_tails_converge_for_many_spots():
    assert special.f_survival(1.0, 1e6, 1e6) == pytest.approx(0.5, abs=1e-3)
    assert special.gamma_cdf(5e5, 5e5) == pytest.approx(0.5, abs=1e-3)


def test_variance_of_large_counts(spark):
    base = 1e9
    counts = spark.createDataFrame([(f"s{i}", "g", base + i) for i in range(5)], "spot string, gene string, count double")
    assert C.gene_moments(counts).first()["var"] == pytest.approx(2.0)


def test_methods_and_front(spark):
    profiles = spark.createDataFrame([(f"k{i}", n, float((i * m) % 7)) for i in range(20) for n, m in (("x", 1), ("y", 3))], "key string, name string, value double")
    for method in A.PROFILE_METHODS + A.LIST_METHODS:
        assert {(r.a, r.b) for r in A.annotate(profiles, profiles, method).collect()} >= {("x", "x"), ("y", "y")}
    with pytest.raises(ValueError):
        A.annotate(profiles, profiles, "other")
    trials = spark.createDataFrame([(1, 0.5, 0.2), (2, 0.6, 0.2), (3, 0.6, 0.3), (4, 0.9, 0.5), (5, 0.1, 0.1)], "trial long, score double, loss double")
    assert sorted(r.trial for r in A.pareto_front(trials).collect()) == [2, 4, 5]


def test_network_tables(spark):
    usage = spark.createDataFrame([(f"s{i}", p, 1.0) for i in range(150) for p in (("a", "b") if i % 2 else ("c", "d"))], "spot string, program string, usage double")
    found = N.network(usage, 0.0, 10, 0.2, 50)
    clusters = {r.program: r.cluster for r in found["clusters"].collect()}
    assert clusters["a"] == clusters["b"] != clusters["c"] == clusters["d"] and found["connections"].count() == 4


def test_downsampling(spark):
    counts = spark.createDataFrame([(f"s{i}", f"g{j}", 100.0) for i in range(40) for j in range(10)], "spot string, gene string, count double")
    one, two = (sorted(map(tuple, M.downsampled(counts.repartition(k), 0.1, 3).collect())) for k in (1, 5))
    assert one == two and 8 < np.mean([r[2] for r in one]) < 12


def test_selection_by_sample(spark):
    rng = np.random.default_rng(0)
    rows = [(s, f"{s}{i}", f"g{j}", float(10 * (i % 2) if j == 0 and s == "x" else rng.poisson(4 + j % 3))) for s in ("x", "y") for i in range(60) for j in range(12)]
    counts = spark.createDataFrame([r for r in rows if r[3]], "sample_id string, spot string, gene string, count double")
    assert {r.gene: r.n_samples for r in C.selected_in_samples(counts, ["x", "y"]).collect()} == {"g0": 1}


def matrix(folder: Path, n_spots=30, n_genes=8):
    rng = np.random.default_rng(1)
    folder.mkdir(parents=True)
    (folder / "features.tsv").write_text("".join(f"g{j}\tname{j}\tGene Expression\n" for j in range(n_genes)))
    (folder / "barcodes.tsv").write_text("".join(f"b{i}-1\n" for i in range(n_spots)))
    cells = [(j + 1, i + 1, int(rng.poisson(4) + 20 * (j % 2 == i % 2))) for i in range(n_spots) for j in range(n_genes)]
    cells = [c for c in cells if c[2]]
    (folder / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n" + f"{n_genes} {n_spots} {len(cells)}\n" + "".join(f"{a} {b} {c}\n" for a, b, c in cells))
    return cells


def test_readers_and_loaders(spark, tmp_path):
    cells = matrix(tmp_path / "m")
    got = {(r.spot, r.gene): r["count"] for r in readers.matrix_market(spark, str(tmp_path / "m")).collect()}
    assert got == {(f"b{j - 1}-1", f"g{i - 1}"): float(c) for i, j, c in cells}
    (tmp_path / "pos.csv").write_text("".join(f"b{i}-1,{i % 2},{i},{i},{i * 1.5},{i * 2.5}\n" for i in range(20)))
    (tmp_path / "agg.csv").write_text("x,library_id\n1,lib1\n2,lib2\n")
    (tmp_path / "species.csv").write_text("barcode,GRCh38,mm10\nb1-1,3,1\nb2-1,0,0\n")
    counts, spots = loaders.sample(spark, str(tmp_path / "m"), str(tmp_path / "pos.csv"), "one", str(tmp_path / "species.csv"), str(tmp_path / "agg.csv"))
    found = {r.spot: r for r in spots.collect()}
    assert len(found) == 30 and found["b1-1"].admix == 0.25 and found["b2-1"].admix is None and found["b25-1"].array_row is None and found["b1-1"].library_id == "lib1"
    both, placed = loaders.samples([(counts, spots), (counts, spots)])
    assert both.count() == 2 * len(cells) and placed.count() == 60
    for k, text in enumerate(("1\t2\n3\t4\n", "0.5\t1.5\n2\t3\n", "T\nB\n")):
        (tmp_path / f"c{k}.tsv").write_text(text)
    sc = loaders.single_cells(spark, *[str(tmp_path / f"c{k}.tsv") for k in range(3)])
    assert [(r.cell, r.x, r.celltype) for r in sc.orderBy("cell").collect()] == [(1, 0.5, "T"), (2, 2.0, "B")]
    (tmp_path / "sets").mkdir()
    (tmp_path / "sets" / "human_a.gmt").write_text("s1\td\tg0\tg1\n")
    (tmp_path / "sets" / "mouse_b.gmt").write_text("s2\td\tg2\n")
    assert [r.stem for r in loaders.bundled_sets(spark, str(tmp_path / "sets"), "GRCh38").collect()] == ["human_a"]


def test_command_line(spark, tmp_path):
    matrix(tmp_path / "m")
    (tmp_path / "pos.csv").write_text("".join(f"b{i}-1,1,{i},{i},{i * 1.5},{i * 2.5}\n" for i in range(30)))
    (tmp_path / "genes.csv").write_text("".join(f"g{j}\n" for j in range(8)))
    (tmp_path / "s.gmt").write_text("odd\td\tg1\tg3\tg5\neven\td\tg0\tg2\tg4\n")
    out = str(tmp_path / "out")
    cli.main(["deconvolve", "--matrix", str(tmp_path / "m"), "--positions", str(tmp_path / "pos.csv"), "--genes", str(tmp_path / "genes.csv"), "--k", "2", "--inner", "5", "--outer", "2", "--out", out], spark)
    assert loaders.result(spark, out, "", "spots").count() == 60 and loaders.result(spark, out, "", "r_genes").count() == 16
    cli.main(["annotate", "--sets", str(tmp_path / "s.gmt"), "--out", out], spark)
    cli.main(["network", "--n-bins", "5", "--out", out], spark)
    assert loaders.tsv_table(spark, f"{out}/marker_scores").count() == 4 and loaders.tsv_table(spark, f"{out}/network/nodes").count() == 2


def test_factorisation_options(spark):
    rng = np.random.default_rng(2)
    counts = spark.createDataFrame([(f"s{i}", f"g{j}", float(rng.poisson(3) + 30 * (j % 2 == i % 2))) for i in range(20) for j in range(6)], "spot string, gene string, count double")
    usage, _, losses = otnmf.factorise(counts, otnmf.Settings(k=2, inner=30, outer=2, cost="ones", normalise_rows=True))
    best = {r.spot: r.program for r in usage.groupBy("spot").agg({"usage": "max"}).join(usage, "spot").filter("usage = `max(usage)`").collect()}
    assert len(set(best[f"s{i}"] for i in range(0, 20, 2))) == 1 and np.isfinite(losses).all()
    with pytest.raises(ValueError):
        otnmf.Settings(k=2, cost="other")


def test_writers(spark, tmp_path):
    scores = spark.createDataFrame([("d", "m1", "rmse", 0.1), ("d", "m2", "rmse", 0.2), ("d", "m1", "pcc", 0.1), ("d", "m2", "pcc", 0.2)], "dataset string, method string, metric string, value double")
    writers.best_values(scores, "dataset", ["rmse"], "metric", "value", str(tmp_path / "best"))
    got = {(r.metric, r.method) for r in loaders.tsv_table(spark, str(tmp_path / "best")).filter("is_best").collect()}
    assert got == {("rmse", "m1"), ("pcc", "m2")}


def test_workers_get_the_package(tmp_path):
    """A driver that has the package only on its own path, outside the repository."""
    root = str(Path(__file__).resolve().parent.parent)
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {root!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        from tissueloom.operators import counts as C
        rows = [(f"s{{i}}", f"g{{j}}", float((i * j) % 7 + 1)) for i in range(20) for j in range(5)]
        print("rows", C.overdispersed_genes(spark.createDataFrame(rows, "spot string, gene string, count double")).count())
    """))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert "rows 5" in done.stdout, done.stderr[-2000:]
