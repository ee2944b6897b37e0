"""More registered queries: joins and filters of tables, statistics, annotation, evaluation, simulation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tissueloom.operators import annotation as A
from tissueloom.operators import network as N
from tissueloom.operators import programs as P
from tissueloom.operators import simulation as M
from tissueloom.operators import statistics as T
from tissueloom.operators import tables as J

from .queries import _CHOOSE, _PAIRS, _PROFILES, _SETS, _TAIL, _profiles, _table, counts, gene_sets, points, register, rounded, scores, types, usage


def _spots(spark, d):
    return usage(spark, d).select("spot").distinct()


def _positions(spark, d):
    part = _table(spark, d, "part").filter("p_size > 10")
    return part.select(F.concat(F.lit("s"), "p_partkey").alias("spot"), (F.col("p_size") > 20).cast("int").alias("in_tissue"), F.col("p_retailprice").alias("x"), (F.col("p_size") * 10.0).alias("y"))


def _classes(spark, d):
    return _table(spark, d, "part").select(F.concat(F.lit("s"), "p_partkey").alias("spot"), F.col("p_size").cast("long").alias("GRCh38"), (F.col("p_partkey") % 7).alias("mm10"))


_ADMIX = ", ax AS (SELECT 's' || p_partkey AS spot, p_size AS h, p_partkey % 7 AS m, (p_partkey % 7) / CAST(p_partkey % 7 + p_size AS DOUBLE) AS admix FROM part)"


@register(""", sp AS (SELECT DISTINCT spot FROM usage), po AS (SELECT 's' || p_partkey AS spot, CAST(p_size > 20 AS INTEGER) AS in_tissue, p_retailprice AS x, p_size * 10.0 AS y FROM part WHERE p_size > 10)
SELECT sp.spot, coalesce(in_tissue, -1) AS in_tissue, x, CAST(y AS DOUBLE) AS y FROM sp LEFT JOIN po ON sp.spot = po.spot""")
def spots_with_positions(spark, d):
    return J.with_positions(_spots(spark, d), _positions(spark, d)).withColumn("in_tissue", F.coalesce("in_tissue", F.lit(-1)))


@register(_ADMIX + ", sp AS (SELECT DISTINCT spot FROM usage) SELECT sp.spot, round(admix, 6) AS admix, CASE WHEN admix > 0.9 THEN 'high' WHEN admix > 0.1 THEN 'mixed' ELSE 'low' END AS class FROM sp LEFT JOIN ax ON sp.spot = ax.spot")
def spot_admixture(spark, d):
    from tissueloom.operators.spatial import admix_class

    found = J.with_admixture(_spots(spark, d), _classes(spark, d))
    return rounded(found.withColumn("class", admix_class("admix")).select("spot", "admix", "class"), "admix")


@register(_ADMIX + " SELECT program, round(sum(usage * (1 - admix)), 4) AS human, round(sum(usage * admix), 4) AS mouse FROM usage JOIN ax USING (spot) GROUP BY program")
def admixture_weighted_usage(spark, d):
    u, ax = usage(spark, d), J.with_admixture(_spots(spark, d), _classes(spark, d))
    one, two = (J.weight_by_admixture(u, ax, g).groupBy("program").agg(F.round(F.sum("usage"), 4).alias(n)) for g, n in (("GRCh38", "human"), ("mm10", "mouse")))
    return one.join(two, "program")


_STATS = ", st AS (SELECT gene, sum(count) > 5000 AS is_odg, sum(count) AS total FROM counts WHERE gene < 'g5' GROUP BY gene)"


def _statistics(spark, d):
    return counts(spark, d).filter("gene < 'g5'").groupBy("gene").agg((F.sum("count") > 5000).alias("is_odg"), F.sum("count").alias("total"))


@register(_STATS + ", ge AS (SELECT DISTINCT gene FROM counts) SELECT ge.gene, total, coalesce(is_odg, false) AS is_odg FROM ge LEFT JOIN st ON ge.gene = st.gene")
def genes_with_statistics(spark, d):
    return J.with_gene_statistics(counts(spark, d).select("gene").distinct(), _statistics(spark, d)).select("gene", "total", "is_odg")


@register(_STATS + " SELECT spot, count(*) AS genes, sum(count) AS total FROM counts WHERE gene IN (SELECT gene FROM st WHERE is_odg) GROUP BY spot")
def selected_gene_counts(spark, d):
    chosen = J.select_genes(counts(spark, d), _statistics(spark, d).filter("is_odg"))
    return chosen.groupBy("spot").agg(F.count("*").alias("genes"), F.sum("count").alias("total"))


@register(" SELECT spot, program, usage FROM usage WHERE starts_with(spot, 's1')")
def sample_usage(spark, d):
    return J.of_sample(usage(spark, d), "s1")


@register(" SELECT sp.spot, " + ", ".join(f"coalesce(sum(usage) FILTER (WHERE program = 'ot_{k}'), 0) AS ot_{k}" for k in range(1, 8)) + " FROM (SELECT DISTINCT spot FROM counts) sp LEFT JOIN usage u ON sp.spot = u.spot GROUP BY sp.spot")
def wide_usage(spark, d):
    return J.wide_usage(counts(spark, d).select("spot").distinct(), usage(spark, d), [f"ot_{k}" for k in range(1, 8)])


@register(_PAIRS + """, e AS (SELECT one, two FROM st WHERE abs(val) > 0.45 AND n >= 10 AND one <> two), ends AS (SELECT one AS p FROM e UNION SELECT two FROM e)
SELECT program, program IN (SELECT p FROM ends) AS linked FROM (SELECT DISTINCT program FROM usage)""")
def linked_programs(spark, d):
    u = usage(spark, d)
    return J.nodes_with_links(N.edges(N.pair_stats(u, 30), 10, 0.45), u)


@register(" SELECT spot, program, usage FROM usage WHERE spot IN (SELECT spot FROM usage GROUP BY spot HAVING sum(usage) >= 800)")
def spots_with_sum(spark, d):
    return J.sets_with_sum(usage(spark, d), "spot", "usage", 800.0)


@register(" SELECT program, gene, score FROM scores WHERE program IN (SELECT program FROM scores GROUP BY program HAVING avg(score) >= 2200)")
def programs_with_mean(spark, d):
    m = scores(spark, d)
    return J.sets_with_sum(m, "program", "score", 2200.0, "mean")


@register(" SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'warm' WHEN contains(p_name, 'blue') THEN 'cold' ELSE 'none' END AS class FROM part")
def conditional_classes(spark, d):
    return J.conditional_class(_table(spark, d, "part"), "p_name", {"red": "warm", "blue": "cold"}, "none").select("p_partkey", "class")


@register(" SELECT c_nationkey, round(avg(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') - avg(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY'), 6) AS difference FROM customer GROUP BY c_nationkey")
def method_difference(spark, d):
    return rounded(J.difference(_table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY"), "difference")


@register(" SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL AND NOT isnan(c_acctbal) AND abs(c_acctbal) <= 5000")
def usable_values(spark, d):
    return J.usable(_table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 5000.0)


@register(" SELECT DISTINCT p_name, regexp_replace(translate(p_name, '()', ''), '[^A-Za-z0-9]+', '_', 'g') AS label FROM part")
def clean_labels(spark, d):
    return _table(spark, d, "part").select("p_name", J.clean_label("p_name").alias("label")).distinct()


@register(" SELECT p_partkey, p_name FROM part WHERE p_name <> 'Not_specific' AND p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) >= 30)")
def frequent_types(spark, d):
    return J.frequent_types(_table(spark, d, "part").select("p_partkey", "p_name"), "p_name", 30)


@register(", k AS (SELECT gene FROM scores WHERE score > 2000 INTERSECT SELECT gene FROM counts WHERE count > 50) SELECT gene, sum(score) AS score FROM scores WHERE score > 2000 AND gene IN (SELECT gene FROM k) GROUP BY gene")
def shared_genes(spark, d):
    one, _ = J.shared_rows(scores(spark, d).filter("score > 2000"), counts(spark, d).filter("count > 50"), "gene")
    return one.groupBy("gene").agg(F.sum("score").alias("score"))


@register(""", bn AS (SELECT CAST(floor(p_retailprice / 100) AS BIGINT) AS bx, list(p_partkey) AS ids FROM part GROUP BY 1), ex AS (SELECT bx, unnest(ids) AS cell_id FROM bn)
SELECT bx, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM ex JOIN part ON cell_id = p_partkey GROUP BY bx""")
def bin_members(spark, d):
    part = _table(spark, d, "part")
    bins = part.groupBy(F.floor(F.col("p_retailprice") / 100).alias("bx")).agg(F.collect_list("p_partkey").alias("ids"))
    cells = part.select(F.col("p_partkey").alias("cell_id"), "p_size")
    return J.members_with(bins, cells).groupBy("bx").agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("total"))


@register(", mp AS (SELECT * FROM (VALUES ('BUILDING', 'b'), ('NA', 'missing')) v(k, mapped)) SELECT c_custkey, mapped FROM (SELECT c_custkey, coalesce(CASE WHEN c_nationkey > 3 THEN c_mktsegment END, 'NA') AS k FROM customer) c LEFT JOIN mp ON c.k = mp.k")
def mapped_types(spark, d):
    rows = _table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") > 3, F.col("c_mktsegment")).alias("celltype"))
    mapper = spark.createDataFrame([("BUILDING", "b"), ("NA", "missing")], "celltype string, mapped string")
    return J.mapped(rows, mapper, "celltype").select("c_custkey", "mapped")


@register(" SELECT CASE program WHEN 'ot_1' THEN 'tumour' WHEN 'ot_2' THEN 'stroma' ELSE program END AS program, sum(usage) AS total FROM usage GROUP BY 1")
def renamed_programs(spark, d):
    names = spark.createDataFrame([("ot_1", "tumour"), ("ot_2", "stroma")], "name string, new_name string")
    return J.renamed(usage(spark, d), names).groupBy("program").agg(F.sum("usage").alias("total"))


@register(" SELECT c_custkey, c_custkey || '-' || CASE c_mktsegment WHEN 'BUILDING' THEN '1' WHEN 'MACHINERY' THEN '2' ELSE '0' END AS spot FROM customer")
def aligned_spots(spark, d):
    rows = _table(spark, d, "customer").withColumn("foreign", F.concat(F.lit("x_"), "c_mktsegment", F.lit("_"), "c_custkey"))
    return rows.select("c_custkey", J.aligned_spot("foreign", "x_", {"BUILDING": "1", "MACHINERY": "2"}).alias("spot"))


@register(" SELECT 'a' AS name, count(*) AS n FROM part UNION ALL SELECT 'b', count(*) FROM customer")
def stacked_results(spark, d):
    one = lambda t: _table(spark, d, t).agg(F.count("*").alias("n"))
    return J.stacked({"a": one("part"), "b": one("customer")}).select("name", "n")


@register(""", one AS (SELECT DISTINCT gene FROM scores WHERE score > 2100 AND program = 'ot_1'), two AS (SELECT DISTINCT gene FROM scores WHERE score > 2100 AND program = 'ot_2')
SELECT (SELECT count(*) FROM (SELECT * FROM one EXCEPT SELECT * FROM two)) AS only_one, (SELECT count(*) FROM (SELECT * FROM two EXCEPT SELECT * FROM one)) AS only_two, (SELECT count(*) FROM (SELECT * FROM one INTERSECT SELECT * FROM two)) AS shared""")
def venn_sizes(spark, d):
    of = lambda p: scores(spark, d).filter((F.col("score") > 2100) & (F.col("program") == p))
    return J.venn(of("ot_1"), of("ot_2"), "gene")


@register(" SELECT program, CASE program WHEN 'ot_3' THEN 1 WHEN 'ot_1' THEN 2 ELSE 3 END AS place, CAST(regexp_extract(program, '_(\\d+)', 1) AS INTEGER) AS number FROM (SELECT DISTINCT program FROM usage)")
def ordered_programs(spark, d):
    rows = usage(spark, d).select("program").distinct()
    return rows.select("program", J.in_given_order("program", ["ot_3", "ot_1"]).cast("int").alias("place"), J.number_in("program", r"_(\d+)").alias("number"))


# --- statistics

@register(""", v AS (SELECT c_acctbal AS x, c_mktsegment = 'BUILDING' AS one FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM v), t AS (SELECT sum(k * k * k - k) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM v GROUP BY x)),
s AS (SELECT sum(r) FILTER (WHERE one) AS r1, CAST(count(*) FILTER (WHERE one) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE NOT one) AS DOUBLE) AS n2 FROM r)
SELECT round(r1 - n1 * (n1 + 1) / 2, 4) AS u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM s, t""")
def mann_whitney_u(spark, d):
    values = _table(spark, d, "customer").select(F.col("c_mktsegment").alias("category"), F.col("c_acctbal").alias("value"))
    found = T.mann_whitney(values, "BUILDING", "MACHINERY").select(F.round("u", 4).alias("u"), "z")
    return rounded(found, "z")


_TABLES = ", ct AS (SELECT p_type, count(*) FILTER (WHERE p_size > 25 AND p_retailprice > 1200) AS a, count(*) FILTER (WHERE p_size > 25 AND NOT p_retailprice > 1200) AS b, count(*) FILTER (WHERE NOT p_size > 25 AND p_retailprice > 1200) AS c, count(*) FILTER (WHERE NOT p_size > 25 AND NOT p_retailprice > 1200) AS d FROM part GROUP BY p_type)"


def _contingency(spark, d):
    return T.contingency(_table(spark, d, "part"), ["p_type"], F.col("p_size") > 25, F.col("p_retailprice") > 1200)


@register(_TABLES + " SELECT p_type, a, b, c, d FROM ct")
def contingency_tables(spark, d):
    return _contingency(spark, d)


@register(_TABLES + f""", q AS (SELECT *, unnest(range(a, least(a + b, a + c) + 1)) AS k FROM ct)
SELECT p_type, round(max(CAST(a * d AS DOUBLE) / (b * c)), 6) AS odds_ratio, round(least(1.0, sum(CASE WHEN a + c - k <= c + d THEN exp({_CHOOSE.format("(a + b)", "k")} + {_CHOOSE.format("(c + d)", "(a + c - k)")} - {_CHOOSE.format("(a + b + c + d)", "(a + c)")}) ELSE 0 END)), 6) AS p_greater FROM q GROUP BY p_type""")
def fisher_exact(spark, d):
    return rounded(T.fisher_exact(_contingency(spark, d)).select("p_type", "odds_ratio", "p_greater"), "odds_ratio", "p_greater")


@register(""", sp AS (SELECT spot, celltype FROM types), de AS (SELECT g.gene, sp.spot, celltype, coalesce(count, 0) AS x FROM (SELECT DISTINCT gene FROM counts) g CROSS JOIN sp LEFT JOIN counts c ON c.gene = g.gene AND c.spot = sp.spot),
r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY x) + (count(*) OVER (PARTITION BY gene, x) - 1) / 2.0 AS r FROM de),
t AS (SELECT gene, sum(k * k * k - k) AS ties, sum(k) AS n FROM (SELECT gene, x, CAST(count(*) AS DOUBLE) AS k FROM de GROUP BY 1, 2) GROUP BY gene),
s AS (SELECT gene, celltype, sum(r) AS r1, CAST(count(*) AS DOUBLE) AS n1, max(x) AS most FROM r GROUP BY 1, 2)
SELECT gene, celltype, round((r1 - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM s JOIN t USING (gene) WHERE most > 0""")
def rank_sum_markers(spark, d):
    return rounded(T.rank_sum_markers(counts(spark, d), types(spark, d)), "z")


@register(" SELECT p_partkey, CASE WHEN p <= 1e-4 THEN '****' WHEN p <= 1e-3 THEN '***' WHEN p <= 1e-2 THEN '**' WHEN p <= 0.05 THEN '*' ELSE 'ns' END AS stars FROM (SELECT p_partkey, 1.0 / (p_partkey + 1) AS p FROM part)")
def significance_stars(spark, d):
    return _table(spark, d, "part").withColumn("p", 1.0 / (F.col("p_partkey") + 1)).select("p_partkey", T.stars("p").alias("stars"))


@register(" SELECT program, count(*) FILTER (WHERE usage <> 0) AS n, sum(usage) AS total, round(100.0 * count(*) FILTER (WHERE usage <> 0) / sum(count(*) FILTER (WHERE usage <> 0)) OVER (), 6) AS n_share, round(100.0 * sum(usage) / sum(sum(usage)) OVER (), 6) AS total_share FROM usage GROUP BY program")
def nonzero_shares(spark, d):
    return rounded(T.nonzero_shares(usage(spark, d), "program", "usage"), "n_share", "total_share")


@register(""", u AS (SELECT program, usage / max(usage) OVER () AS x FROM usage), b AS (SELECT program, CASE WHEN x <= 0.05 THEN 'D0' WHEN x <= 0.2 THEN 'D1' WHEN x <= 0.5 THEN 'D2' WHEN x <= 0.8 THEN 'D3' ELSE 'D4' END AS bin, count(*) AS n FROM u GROUP BY 1, 2)
SELECT program, bin, round(n / CAST(sum(n) OVER (PARTITION BY program) AS DOUBLE), 6) AS share, round(CASE WHEN bin <> 'D0' THEN n / CAST(sum(CASE WHEN bin <> 'D0' THEN n END) OVER (PARTITION BY program) AS DOUBLE) END, 6) AS share_without_d0 FROM b""")
def density_bin_shares(spark, d):
    from .queries import density_bins

    rows, w = density_bins(spark, d), Window.partitionBy("program")
    some = F.when(F.col("bin") != "D0", F.col("n"))
    return rounded(rows.select("program", "bin", (F.col("n") / F.sum("n").over(w)).alias("share"), (some / F.sum(some).over(w)).alias("share_without_d0")), "share", "share_without_d0")


@register(" SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal), 6) AS mean, round(var_samp(c_acctbal), 4) AS var FROM customer GROUP BY 1, 2")
def category_means(spark, d):
    return _table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.avg("c_acctbal"), 6).alias("mean"), F.round(F.var_samp("c_acctbal"), 4).alias("var"))


@register(_PAIRS + ", m AS (SELECT one AS a, CASE WHEN one = two THEN 0 ELSE val END AS x, one <> two AS other FROM st) SELECT a, round(min(x), 6) AS low, round(sum(x) / count(*) FILTER (WHERE other), 6) AS mean, round(max(x), 6) AS high FROM m GROUP BY a")
def off_diagonal_statistics(spark, d):
    m = N.pair_stats(usage(spark, d), 30).select(F.col("one").alias("a"), F.col("two").alias("b"), F.col("val").alias("score"))
    return rounded(T.off_diagonal(m), "low", "mean", "high")


@register(" SELECT CAST(floor(x / 100) AS BIGINT) AS bx, CAST(floor(y / 50) AS BIGINT) AS by, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) / 5000, 12) AS density FROM points GROUP BY 1, 2")
def density_histogram(spark, d):
    return rounded(T.histogram_2d(points(spark, d), "x", "y", 100.0, 50.0), "density", digits=12)


@register(" SELECT spot, count(*) FILTER (WHERE usage > 30) AS n_active FROM usage GROUP BY spot")
def active_programs(spark, d):
    return usage(spark, d).groupBy("spot").agg(F.count_if(F.col("usage") > 30).alias("n_active"))


@register(" SELECT round(avg(CASE WHEN a > b THEN 1.0 ELSE 0 END), 6) AS greater, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END), 6) AS equal, round(avg(CASE WHEN a < b THEN 1.0 ELSE 0 END), 6) AS less, round(avg(CASE WHEN b = 0 AND a > 0 THEN 1.0 ELSE 0 END), 6) AS alone FROM (SELECT p_size AS a, p_partkey % 50 AS b FROM part)")
def comparison_shares(spark, d):
    rows = _table(spark, d, "part").select(F.col("p_size").alias("a"), (F.col("p_partkey") % 50).alias("b"))
    return rounded(T.comparison_shares(rows, "a", "b"), "greater", "equal", "less", "alone")


@register(" SELECT l_quantity, n FROM (SELECT l_quantity, count(*) AS n, sum(count(*)) OVER (ORDER BY l_quantity) AS upto, sum(count(*)) OVER () AS total FROM lineitem GROUP BY 1) WHERE upto <= 0.99 * total")
def trimmed_quantities(spark, d):
    return T.trimmed(_table(spark, d, "lineitem"), "l_quantity")


_XY = _PROFILES + ", pr AS (SELECT fx.name AS a, fy.name AS b, fx.key, fx.value AS x, fy.value AS y FROM fx JOIN fy ON fx.key = fy.key)"


def _xy(spark, d):
    one, two = _profiles(spark, d)
    keys = two.select("key").distinct()
    full = lambda df, n, v: df.select(F.col("name").alias(n)).distinct().join(F.broadcast(keys)).join(df.select("key", F.col("name").alias(n), F.col("value").alias(v)), ["key", n], "left").na.fill(0.0, [v])
    return full(one, "a", "x").join(full(two, "b", "y"), "key")


@register(_XY + """, q AS (SELECT *, x / sum(x) OVER (PARTITION BY a, b) AS p, y / sum(y) OVER (PARTITION BY a, b) AS q FROM pr)
SELECT a, b, round(sqrt(avg((x - y) * (x - y))), 4) AS rmse, round(sqrt(greatest(0, (sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)) / 2)), 6) AS js FROM q GROUP BY a, b""")
def profile_errors(spark, d):
    found = T.errors(_xy(spark, d), ["a", "b"])
    return rounded(rounded(found, "rmse", digits=4), "js")


@register(_XY + """, o AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY y DESC, key) AS i, row_number() OVER (PARTITION BY a, b ORDER BY x DESC, key) AS j FROM pr)
SELECT a, b, round(sum(x / log2(i + 1)) / sum(x / log2(j + 1)), 6) AS ndcg FROM o GROUP BY a, b""")
def profile_ndcg(spark, d):
    return rounded(T.ndcg(_xy(spark, d), ["a", "b"], "key"), "ndcg")


@register(" SELECT program, round(exp(avg(ln(usage))), 6) AS geometric_mean FROM usage WHERE usage > 0 GROUP BY program")
def geometric_means(spark, d):
    return rounded(T.geometric_mean(usage(spark, d), "program", "usage"), "geometric_mean")


@register(" SELECT spot, program, round((usage - avg(usage) OVER w) / nullif(stddev_pop(usage) OVER w, 0), 6) AS z, round(usage / sum(usage) OVER w * 1e6, 4) AS per_million FROM usage WINDOW w AS (PARTITION BY program)")
def scaled_usage(spark, d):
    per = F.col("usage") / F.sum("usage").over(Window.partitionBy("program")) * 1e6
    u = usage(spark, d)
    return rounded(u.select("spot", "program", T.z_scores(u, "program", "usage").alias("z"), F.round(per, 4).alias("per_million")), "z")


# --- annotation and evaluation

@register(_SETS + ", al AS (SELECT set_name, program FROM (SELECT DISTINCT set_name FROM gs) CROSS JOIN (SELECT DISTINCT program FROM rk)), sc AS (SELECT set_name, program, sum(1.0 / rank) AS score FROM gs JOIN rk USING (gene) GROUP BY 1, 2) SELECT al.set_name, al.program, round(coalesce(score, 0), 6) AS score FROM al LEFT JOIN sc ON al.set_name = sc.set_name AND al.program = sc.program")
def marker_annotation(spark, d):
    return rounded(A.marker_annotation(gene_sets(spark, d), P.rank_genes(scores(spark, d))), "score")


@register(_SETS + ", sz AS (SELECT set_name, least(2 * count(DISTINCT gene), 25) AS upto FROM gs GROUP BY 1) SELECT set_name, program, gene, CAST(rank AS INTEGER) AS rank FROM sz JOIN rk ON rank <= upto")
def genes_by_set_size(spark, d):
    return A.top_by_set_size(gene_sets(spark, d), P.rank_genes(scores(spark, d)), 25)


@register(" SELECT spot, CASE WHEN min(usage) = 0 THEN 0.0001 ELSE min(usage) END AS usage FROM (SELECT *, row_number() OVER (PARTITION BY spot ORDER BY usage DESC) AS k FROM usage) WHERE k <= 3 GROUP BY spot")
def third_largest_usage(spark, d):
    return A.nth_largest(usage(spark, d), "spot", "usage")


_PEARSON = _PROFILES + ", sc AS (SELECT fx.name AS a, fy.name AS b, round(corr(fx.value, fy.value), 9) AS score FROM fx JOIN fy ON fx.key = fy.key GROUP BY 1, 2)"


def _pearson(spark, d):
    return rounded(P.similarity(*_profiles(spark, d)), "score", digits=9)


@register(_PEARSON + ", t AS (SELECT a, max_by(b, (score, b)) AS best, max(score) AS top FROM sc GROUP BY a) SELECT a, best, round(top, 6) AS top, CAST(row_number() OVER (ORDER BY best, top DESC, a) AS INTEGER) AS place FROM t")
def argmax_order(spark, d):
    return rounded(A.argmax_order(_pearson(spark, d)), "top")


@register(_PEARSON + " SELECT a, b, round(score, 6) AS score, score = max(score) OVER (PARTITION BY a) AS is_best FROM sc")
def best_references(spark, d):
    return rounded(A.best_per_row(_pearson(spark, d)), "score")


@register(""", pg AS (SELECT program, gene, score FROM scores WHERE program IN ('ot_1', 'ot_2')), ks AS (SELECT DISTINCT gene FROM pg), de AS (SELECT s.spot, ks.gene, coalesce(count, 0) AS x FROM (SELECT DISTINCT spot FROM counts WHERE gene IN (SELECT gene FROM ks)) s CROSS JOIN ks LEFT JOIN counts c ON c.spot = s.spot AND c.gene = ks.gene),
co AS (SELECT spot, program, corr(x, score) AS r FROM de JOIN pg USING (gene) GROUP BY 1, 2) SELECT celltype, program, round(avg(r), 6) AS score FROM co JOIN types USING (spot) WHERE NOT isnan(r) GROUP BY 1, 2""")
def cell_correlations(spark, d):
    cells = counts(spark, d).select(F.col("gene").alias("key"), F.col("spot").alias("name"), F.col("count").alias("value"))
    progs = scores(spark, d).filter("program IN ('ot_1', 'ot_2')").select(F.col("gene").alias("key"), F.col("program").alias("name"), F.col("score").alias("value"))
    return rounded(A.cell_correlations(cells, progs, types(spark, d).withColumnRenamed("spot", "cell")), "score")


def _greedy(source: str, rounds: int) -> str:
    """SQL of greedy one-to-one matching: the best pair is taken ``rounds`` times."""
    parts = [f"m0 AS (SELECT a, b, score FROM {source} WHERE false)"]
    for k in range(rounds):
        parts.append(f"m{k + 1} AS (SELECT * FROM m{k} UNION ALL SELECT * FROM (SELECT a, b, score FROM {source} WHERE a NOT IN (SELECT a FROM m{k}) AND b NOT IN (SELECT b FROM m{k}) ORDER BY score DESC, a, b LIMIT 1))")
    return ", " + ", ".join(parts)


_MATCHED = _PEARSON + _greedy("sc", 6)


def _matched(spark, d):
    return P.greedy_match(_pearson(spark, d))


@register(_MATCHED + " SELECT a, b, round(score, 6) AS score FROM m6")
def matched_profiles(spark, d):
    return rounded(_matched(spark, d), "score")


@register(_MATCHED + " SELECT count(*) AS n, round(avg(score), 6) AS mean FROM m6")
def mean_match(spark, d):
    return rounded(A.mean_match(_matched(spark, d)), "mean")


@register(_MATCHED + " SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE score > t) AS n FROM m6, (VALUES (0.0), (0.2), (0.5)) v(t) GROUP BY 1")
def matches_above(spark, d):
    return A.matches_above(_matched(spark, d), [0.0, 0.2, 0.5])


@register(_MATCHED + " SELECT a, b, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, a) AS INTEGER) AS place FROM m6")
def matched_against_standard(spark, d):
    one, two = _profiles(spark, d)
    left, right = J.shared_rows(one, two, "key")
    found = P.greedy_match(rounded(A.annotate(left, right), "score", digits=9))
    return rounded(found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "a"))), "score")


@register(""", x AS (SELECT gene AS key, program AS name, score AS value FROM scores), ks AS (SELECT DISTINCT key FROM x), f AS (SELECT n.name, ks.key, coalesce(value, 0) AS value FROM (SELECT DISTINCT name FROM x) n CROSS JOIN ks LEFT JOIN x ON x.name = n.name AND x.key = ks.key)
SELECT p.name AS a, q.name AS b, round(corr(p.value, q.value), 6) AS score FROM f p JOIN f q ON p.key = q.key GROUP BY 1, 2""")
def self_similarity(spark, d):
    return rounded(A.self_similarity(_profiles(spark, d)[0]), "score")


_TRIALS = ", tr AS (SELECT c_custkey AS trial, round(c_acctbal / 10000, 2) AS score, (c_custkey * 37 % 101) / 200.0 AS loss FROM customer)"


def _trials(spark, d):
    return _table(spark, d, "customer").select(F.col("c_custkey").alias("trial"), F.round(F.col("c_acctbal") / 10000, 2).alias("score"), (F.col("c_custkey") * 37 % 101 / 200.0).alias("loss"))


@register(_TRIALS + " SELECT trial, score, loss FROM (SELECT * FROM tr ORDER BY score DESC, loss, trial LIMIT 3) ORDER BY CASE WHEN loss < 0.1 THEN 0 ELSE 1 END, score DESC, loss, trial LIMIT 1")
def best_trial(spark, d):
    return A.best_trial(_trials(spark, d))


@register(_TRIALS + " SELECT trial, score, loss FROM tr t WHERE NOT EXISTS (SELECT 1 FROM tr o WHERE (o.score > t.score AND o.loss <= t.loss) OR (o.score >= t.score AND o.loss < t.loss))")
def pareto_trials(spark, d):
    return A.pareto_front(_trials(spark, d))


@register(f""", rk AS (SELECT program, gene, row_number() OVER (PARTITION BY program ORDER BY score DESC, gene) AS rank FROM scores), gs AS (SELECT DISTINCT 'set' || (p_partkey % 13) AS set_name, 'g' || (p_partkey * p_size % 97) AS gene FROM part WHERE p_size > 40),
li AS (SELECT program, gene FROM rk WHERE rank <= 30), z AS (SELECT set_name, count(*) AS s FROM gs GROUP BY 1 HAVING count(*) BETWEEN 10 AND 2000),
ov AS (SELECT set_name, program, s, 30 AS l, count(*) AS x FROM gs JOIN li USING (gene) JOIN z USING (set_name) GROUP BY 1, 2, 3),
q AS (SELECT *, unnest(range(x, least(s, l) + 1)) AS k FROM ov), p AS (SELECT set_name, program, any_value(x) AS overlap, any_value(s) AS set_size, any_value(l) AS list_size, {_TAIL} AS p FROM q GROUP BY 1, 2)
SELECT set_name, program, overlap, set_size, CAST(list_size AS BIGINT) AS list_size, round(p, 6) AS p_value, round(-log10(greatest(p, 1e-300)), 4) AS minus_log10_p FROM p""")
def gene_set_enrichment(spark, d):
    part = _table(spark, d, "part").filter("p_size > 40")
    sets = part.select(F.concat(F.lit("set"), F.col("p_partkey") % 13).alias("set_name"), F.concat(F.lit("g"), F.col("p_partkey") * F.col("p_size") % 97).alias("gene")).distinct()
    found = A.enrichment(P.rank_genes(scores(spark, d)), sets, 97, top=30)
    return rounded(found, "p_value").select("set_name", "program", "overlap", "set_size", "list_size", "p_value", F.round("minus_log10_p", 4).alias("minus_log10_p"))


@register(_PAIRS + ", e AS (SELECT one, two, val FROM st WHERE n >= 10 AND one <> two) SELECT one AS source, two AS target, " + ", ".join(f"abs(val) > {t} AS gt{i}" for i, t in enumerate((0.099, 0.199, 0.299, 0.399, 0.499), 1)) + " FROM e WHERE abs(val) > 0.099")
def edge_flags(spark, d):
    return N.edge_flags(N.edges(N.pair_stats(usage(spark, d), 30), 10, 0.099))


@register(_PAIRS + """, e AS (SELECT one, two FROM st WHERE abs(val) > 0.3 AND n >= 10 AND one <> two), cl AS (SELECT DISTINCT program, CAST(right(program, 1) AS INTEGER) % 2 AS cluster FROM usage)
SELECT p.program, """ + ", ".join(f"round(log2(1 + (SELECT count(*) FROM e JOIN cl ON cl.program = e.{other} WHERE e.{own} = p.program AND cluster = {c})), 6) AS {way}_Cluster{c}" for c in (0, 1) for way, own, other in (("in", "two", "one"), ("out", "one", "two"))) + " FROM (SELECT DISTINCT program FROM usage) p")
def connection_matrix(spark, d):
    u = usage(spark, d)
    clusters = u.select("program").distinct().withColumn("cluster", (F.substring("program", -1, 1).cast("int") % 2).cast("int"))
    found = N.connection_matrix(N.edges(N.pair_stats(u, 30), 10, 0.3), clusters, [0, 1])
    return rounded(found, *[c for c in found.columns if c != "program"])


# --- samples and simulation

@register(""", c AS (SELECT CASE WHEN starts_with(spot, 's1') THEN 'one' ELSE 'rest' END AS sample_id, spot, gene, count FROM counts), n AS (SELECT sample_id, count(DISTINCT spot) AS n FROM c GROUP BY 1),
m AS (SELECT sample_id, gene, n, sum(count) / n AS mean, sum(count * count) / n - (sum(count) / n) * (sum(count) / n) AS var FROM c JOIN n USING (sample_id) GROUP BY 1, 2, 3), f AS (SELECT sample_id, regr_slope(ln(var), ln(mean)) AS s, regr_intercept(ln(var), ln(mean)) AS i FROM m WHERE var > 0 GROUP BY 1)
SELECT sample_id, gene, round(mean, 6) AS mean, round(var, 5) AS var, round(ln(var) - s * ln(mean) - i, 5) AS res FROM m JOIN f USING (sample_id) WHERE var > 0""")
def sample_residuals(spark, d):
    from tissueloom.operators import counts as C

    rows = counts(spark, d).withColumn("sample_id", F.when(F.col("spot").startswith("s1"), "one").otherwise("rest"))
    found = C.linear_residuals(C.gene_moments(rows, by=["sample_id"]), by=["sample_id"]).filter("var > 0")
    return rounded(rounded(found, "mean"), "var", "res", digits=5).select("sample_id", "gene", "mean", "var", "res")


@register(" SELECT range AS spot, range % 37 AS x, CAST(floor(range / 37) AS BIGINT) AS y FROM range(1000)")
def grid_locations(spark, d):
    return M.grid_locations(spark, 1000, 37)


@register(", n AS (SELECT celltype, count(*) AS n FROM types GROUP BY 1) SELECT celltype, n, round(sqrt(n) / sum(sqrt(n)) OVER (), 6) AS probability, round(1.0 / (count(*) OVER () * n), 9) AS weight FROM n")
def class_probabilities(spark, d):
    return rounded(rounded(M.class_probabilities(types(spark, d), "sqrt"), "probability"), "weight", digits=9)


_DRAW = "CAST(CAST('0x' || substr(md5(concat_ws(':', {})), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"


@register(f""", cp AS (SELECT celltype, n, sum(n) OVER (ORDER BY celltype) / CAST(sum(n) OVER () AS DOUBLE) AS upto FROM (SELECT celltype, count(*) AS n FROM types GROUP BY 1)),
s AS (SELECT range AS spot, CAST(ceil(greatest(4.0, least(16.0, 5 + 10 * {_DRAW.format("'7', 'cells', CAST(range AS VARCHAR)")}))) AS INTEGER) AS n_cells, {_DRAW.format("'7', 'types', CAST(range AS VARCHAR)")} AS v FROM range(200)),
k AS (SELECT spot, n_cells, CAST(ceil(greatest(1.0, least(CAST(n_cells AS DOUBLE), 2 + 4 * v))) AS INTEGER) AS n_types FROM s),
o AS (SELECT spot, j, (SELECT min(celltype) FROM cp WHERE upto > {_DRAW.format("'7', 'type', CAST(spot AS VARCHAR), CAST(j AS VARCHAR)")}) AS celltype FROM (SELECT spot, unnest(range(1, n_types + 1)) AS j FROM k)),
dr AS (SELECT spot, n_types, unnest(range(1, n_cells + 1)) AS draw FROM k),
dd AS (SELECT spot, draw, least(CAST(floor({_DRAW.format("'7', 'of', CAST(spot AS VARCHAR), CAST(draw AS VARCHAR)")} * n_types) AS INTEGER), n_types - 1) + 1 AS j, {_DRAW.format("'7', 'cell', CAST(spot AS VARCHAR), CAST(draw AS VARCHAR)")} AS u FROM dr),
nu AS (SELECT spot AS cell, celltype, row_number() OVER (PARTITION BY celltype ORDER BY spot) - 1 AS num FROM types)
SELECT dd.spot, CAST(dd.draw AS INTEGER) AS draw, o.celltype, nu.cell FROM dd JOIN o ON o.spot = dd.spot AND o.j = dd.j JOIN cp ON cp.celltype = o.celltype JOIN nu ON nu.celltype = o.celltype AND nu.num = least(floor(u * n), n - 1)""")
def mixture_draws(spark, d):
    spots = spark.range(200).withColumnRenamed("id", "spot")
    return M.mixture(spots, types(spark, d).withColumnRenamed("spot", "cell"), seed=7)


@register(" SELECT round(min(x) - 5, 4) AS x0, CAST(min(y) - 5 AS DOUBLE) AS y0, round(max(x) + 5, 4) AS x1, CAST(max(y) + 5 AS DOUBLE) AS y1 FROM points")
def bounding_box(spark, d):
    return rounded(M.bounding_box(points(spark, d), 5.0), "x0", "x1", digits=4)


@register(" SELECT count(*) AS n, round(sum(x1 - x0), 4) AS widths, round(sum(x0 + y0), 3) AS corners FROM (SELECT x - 8 / 0.27369 / 2 AS x0, x + 8 / 0.27369 / 2 AS x1, y - 8 / 0.27369 / 2 AS y0 FROM points)")
def bin_squares(spark, d):
    squares = M.bin_squares(points(spark, d), 8.0, 0.27369)
    return squares.agg(F.count("*").alias("n"), F.round(F.sum(F.col("x1") - F.col("x0")), 4).alias("widths"), F.round(F.sum(F.col("x0") + F.col("y0")), 3).alias("corners"))


@register()
def downsampled_counts(spark, d):
    return M.downsampled(counts(spark, d), 0.1, seed=3)
