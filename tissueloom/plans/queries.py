"""Registered queries over the star-schema tables, with the SQL that must agree.

Stand-ins: a spot is a part of lineitem, a gene an order's last two digits, a program a supplier's group,
a cell type a part's type; counts and usages are sums of quantities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissueloom.operators import counts as C
from tissueloom.operators import network as N
from tissueloom.operators import otnmf, programs as P
from tissueloom.operators import spatial as S

Query = DataFrame


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def counts(spark: SparkSession, d: str) -> DataFrame:
    li = _table(spark, d, "lineitem")
    return li.groupBy(F.concat(F.lit("s"), "l_partkey").alias("spot"), F.concat(F.lit("g"), F.col("l_orderkey") % 97).alias("gene")).agg(F.sum("l_quantity").alias("count"))


def usage(spark: SparkSession, d: str) -> DataFrame:
    li = _table(spark, d, "lineitem")
    return li.groupBy(F.concat(F.lit("s"), "l_partkey").alias("spot"), F.concat(F.lit("ot_"), F.col("l_suppkey") % 7 + 1).alias("program")).agg(F.sum("l_quantity").alias("usage"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    li = _table(spark, d, "lineitem")
    return li.groupBy(F.concat(F.lit("ot_"), F.col("l_suppkey") % 7 + 1).alias("program"), F.concat(F.lit("g"), F.col("l_orderkey") % 97).alias("gene")).agg(F.sum("l_quantity").alias("score"))


def types(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select(F.concat(F.lit("s"), "p_partkey").alias("spot"), F.col("p_type").alias("celltype"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select(F.col("p_retailprice").alias("x"), (F.col("p_size") * 10.0).alias("y"), F.col("p_type").alias("type"), F.col("p_size").cast("double").alias("value"))


BASE = """
counts AS (SELECT 's' || l_partkey AS spot, 'g' || (l_orderkey % 97) AS gene, sum(l_quantity) AS count FROM lineitem GROUP BY 1, 2),
usage AS (SELECT 's' || l_partkey AS spot, 'ot_' || (l_suppkey % 7 + 1) AS program, sum(l_quantity) AS usage FROM lineitem GROUP BY 1, 2),
scores AS (SELECT 'ot_' || (l_suppkey % 7 + 1) AS program, 'g' || (l_orderkey % 97) AS gene, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2),
types AS (SELECT 's' || p_partkey AS spot, p_type AS celltype FROM part),
points AS (SELECT p_retailprice AS x, p_size * 10.0 AS y, p_type AS type, CAST(p_size AS DOUBLE) AS value FROM part)"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {BASE}{sql}"
        return f

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


@register(""" SELECT program, gene, score, CAST(row_number() OVER (PARTITION BY program ORDER BY score DESC, gene) AS INTEGER) AS rank
FROM scores QUALIFY rank <= 20""")
def ranked_genes(spark, d):
    return P.rank_genes(scores(spark, d), 20)


FLAGSHIP = "ranked_genes"

_FILTERED = """,
good AS (SELECT spot FROM counts GROUP BY spot HAVING sum(count) >= 100 AND count(*) >= 3),
f1 AS (SELECT * FROM counts WHERE spot IN (SELECT spot FROM good)),
ns AS (SELECT count(DISTINCT spot) AS n FROM f1),
gg AS (SELECT gene FROM f1, ns GROUP BY gene, n HAVING count(DISTINCT spot) >= floor(0.2 * n) AND count(DISTINCT spot) <= floor(0.3 * n)),
f2 AS (SELECT * FROM f1 WHERE gene IN (SELECT gene FROM gg))"""


@register(_FILTERED + " SELECT gene, count(*) AS spots, sum(count) AS total FROM f2 GROUP BY gene")
def filtered_counts(spark, d):
    kept = C.filter_genes(C.filter_spots(counts(spark, d), 100, 3), 0.2, 0.3)
    return kept.groupBy("gene").agg(F.count("*").alias("spots"), F.sum("count").alias("total"))


_MOMENTS = """,
n AS (SELECT count(DISTINCT spot) AS n FROM counts),
mo AS (SELECT gene, n, sum(count) / n AS mean, sum(count * count) / n - (sum(count) / n) * (sum(count) / n) AS var FROM counts, n GROUP BY gene, n),
lm AS (SELECT *, ln(mean) AS m, ln(var) AS v FROM mo)"""


@register(_MOMENTS + " SELECT gene, n AS n_spots, round(mean, 6) AS mean, round(var, 6) AS var, round(m, 6) AS m, round(v, 6) AS v FROM lm")
def gene_moments(spark, d):
    return rounded(C.log_moments(C.gene_moments(counts(spark, d))), "mean", "var", "m", "v")


@register(_MOMENTS + """, fit AS (SELECT regr_slope(v, m) AS s, regr_intercept(v, m) AS i FROM lm)
SELECT gene, round(v - s * m - i, 6) AS res FROM lm, fit""")
def dispersion_residuals(spark, d):
    return rounded(C.linear_residuals(C.gene_moments(counts(spark, d))), "res").select("gene", "res")


@register()
def overdispersed_genes(spark, d):
    return C.overdispersed_genes(counts(spark, d))


@register()
def overdispersed_genes_spline(spark, d):
    return C.overdispersed_genes(counts(spark, d), spline=True)


@register(""", p AS (SELECT p_partkey AS id, (p_partkey * 7919 % 9973 + 1) / 10000.0 AS p_value FROM part),
r AS (SELECT *, count(*) OVER () AS n, count(*) OVER (ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank FROM p)
SELECT id, CAST(p_value AS DOUBLE) AS p_value, round(least(1.0, min(CAST(p_value AS DOUBLE) * n / rank) OVER (ORDER BY p_value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_value_adj FROM r""")
def adjusted_p_values(spark, d):
    p = _table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7919 % 9973 + 1) / 10000.0).alias("p_value"))
    return rounded(C.adjust_p_values(p), "p_value_adj")


@register(""", c AS (SELECT program, quantile_cont(usage, 0.9) AS cut FROM usage GROUP BY program)
SELECT spot, u.program, CASE WHEN usage >= cut THEN usage ELSE 0 END AS usage FROM usage u JOIN c ON u.program = c.program""")
def quantile_threshold(spark, d):
    return P.quantile_threshold(usage(spark, d))


@register(""", c AS (SELECT program, quantile_cont(usage, 0.9) AS cut FROM usage GROUP BY program)
SELECT u.program, count(*) FILTER (WHERE usage > cut) AS active, round(sum(greatest(usage - cut, 0)), 6) AS excess FROM usage u JOIN c ON u.program = c.program GROUP BY u.program""")
def quantile_excess(spark, d):
    strict = P.quantile_threshold(usage(spark, d), mode="strict").groupBy("program").agg(F.count_if(F.col("usage") > 0).alias("active"))
    excess = P.quantile_threshold(usage(spark, d), mode="excess").groupBy("program").agg(F.round(F.sum("usage"), 6).alias("excess"))
    return strict.join(excess, "program")


@register(" SELECT spot, program, round(usage / sum(usage) OVER (PARTITION BY spot), 6) AS usage FROM usage")
def normalised_usage(spark, d):
    return rounded(P.normalise_rows(usage(spark, d)), "usage")


_PAIRS = """,
a AS (SELECT spot, program FROM usage WHERE usage > 30),
k AS (SELECT program, count(*) AS n FROM a GROUP BY program),
q AS (SELECT x.program AS one, y.program AS two, count(*) AS pos FROM a x JOIN a y ON x.spot = y.spot GROUP BY 1, 2),
st AS (SELECT k.program AS one, l.program AS two, k.n, coalesce(pos, 0) AS pos, k.n - coalesce(pos, 0) AS neg, (coalesce(pos, 0) + 1) / CAST(k.n + 2 AS DOUBLE) AS val
  FROM k CROSS JOIN k l LEFT JOIN q ON q.one = k.program AND q.two = l.program)"""


@register(_PAIRS + " SELECT one, two, n, pos, neg, round(val, 6) AS val FROM st")
def pair_statistics(spark, d):
    return rounded(N.pair_stats(usage(spark, d), 30), "val")


@register(_PAIRS + """, e AS (SELECT one, two FROM st WHERE abs(val) > 0.3 AND n >= 10 AND one <> two),
cl AS (SELECT DISTINCT program, CAST(right(program, 1) AS INTEGER) % 2 AS cluster FROM usage),
o AS (SELECT one AS program, cluster, count(*) AS n FROM e JOIN cl ON cl.program = two GROUP BY 1, 2),
i AS (SELECT two AS program, cluster, count(*) AS n FROM e JOIN cl ON cl.program = one GROUP BY 1, 2)
SELECT coalesce(o.program, i.program) AS program, coalesce(o.cluster, i.cluster) AS cluster, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out
FROM o FULL JOIN i ON o.program = i.program AND o.cluster = i.cluster""")
def group_connections(spark, d):
    u = usage(spark, d)
    clusters = u.select("program").distinct().withColumn("cluster", (F.substring("program", -1, 1).cast("int") % 2).cast("int"))
    return N.group_connections(N.edges(N.pair_stats(u, 30), 10, 0.3), clusters)


@register()
def program_communities(spark, d):
    u = usage(spark, d)
    return N.communities(N.edges(N.pair_stats(u, 30), 10, 0.1), u.select("program").distinct())


@register(""", t AS (SELECT count(DISTINCT spot) AS n FROM usage)
SELECT program, count(*) FILTER (WHERE usage > 30) AS cpp, round(count(*) FILTER (WHERE usage > 30) / CAST(n AS DOUBLE), 6) AS proportion, count(*) FILTER (WHERE usage > 30) >= 100 AS is_prevalent FROM usage, t GROUP BY program, n""")
def node_attributes(spark, d):
    return rounded(N.node_attributes(usage(spark, d), 30), "proportion")


_SETS = """, rk AS (SELECT program, gene, row_number() OVER (PARTITION BY program ORDER BY score DESC, gene) AS rank FROM scores),
gs AS (SELECT DISTINCT 'set' || (p_size % 5) AS set_name, 'g' || (p_partkey % 97) AS gene FROM part)"""


def gene_sets(spark, d):
    return _table(spark, d, "part").select(F.concat(F.lit("set"), F.col("p_size") % 5).alias("set_name"), F.concat(F.lit("g"), F.col("p_partkey") % 97).alias("gene")).distinct()


@register(_SETS + " SELECT set_name, program, round(sum(1.0 / rank), 6) AS score FROM gs JOIN rk USING (gene) GROUP BY 1, 2")
def marker_scores(spark, d):
    return rounded(P.mean_rank_score(gene_sets(spark, d), P.rank_genes(scores(spark, d))), "score")


@register(_SETS + """, l AS (SELECT program AS name, gene AS item, rank FROM rk WHERE rank <= 50),
pr AS (SELECT x.name AS a, y.name AS b, greatest(x.rank, y.rank) AS depth FROM l x JOIN l y ON x.item = y.item),
dp AS (SELECT a, b, k, count(*) FILTER (WHERE depth <= k) AS x FROM pr, range(1, 51) t(k) GROUP BY a, b, k)
SELECT a, b, round(0.02 / 0.98 * sum(x / CAST(k AS DOUBLE) * pow(0.98, k)) + max(x) / 50.0 * pow(0.98, 50), 6) AS score FROM dp GROUP BY a, b""")
def rank_overlap(spark, d):
    lists = P.rank_genes(scores(spark, d), 50).select(F.col("program").alias("name"), F.col("gene").alias("item"), "rank")
    return rounded(P.rank_biased_overlap(lists, lists), "score")


_CHOOSE = "(lgamma({0} + 1.0) - lgamma({1} + 1.0) - lgamma({0} - ({1}) + 1.0))"
_TAIL = f"least(1.0, sum(CASE WHEN l - k <= 97 - s THEN exp({_CHOOSE.format('s', 'k')} + {_CHOOSE.format('(97 - s)', '(l - k)')} - {_CHOOSE.format('97', 'l')}) ELSE 0 END))"


@register(_SETS + f""", li AS (SELECT program, gene FROM rk WHERE rank <= 30), z AS (SELECT set_name, count(*) AS s FROM gs GROUP BY 1),
ov AS (SELECT set_name, program, s, 30 AS l, count(*) AS x FROM gs JOIN li USING (gene) JOIN z USING (set_name) GROUP BY 1, 2, 3),
q AS (SELECT *, unnest(range(x, least(s, l) + 1)) AS k FROM ov), p AS (SELECT set_name, program, any_value(x) AS overlap, any_value(s) AS set_size, CAST(any_value(l) AS BIGINT) AS list_size, {_TAIL} AS p FROM q GROUP BY 1, 2),
r AS (SELECT *, count(*) OVER (PARTITION BY program) AS n, count(*) OVER (PARTITION BY program ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM p)
SELECT set_name, program, overlap, set_size, list_size, round(p, 6) AS p_value, round(least(1.0, min(p * n / place) OVER (PARTITION BY program ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_value_adj FROM r""")
def set_enrichment(spark, d):
    return rounded(P.over_representation(gene_sets(spark, d), P.rank_genes(scores(spark, d), 30), 97), "p_value", "p_value_adj")


_PROFILES = """, x AS (SELECT gene AS key, program AS name, score AS value FROM scores),
y AS (SELECT gene AS key, celltype AS name, sum(count) AS value FROM counts JOIN types USING (spot) GROUP BY 1, 2),
ks AS (SELECT DISTINCT key FROM y),
fx AS (SELECT n.name, ks.key, coalesce(value, 0) AS value FROM (SELECT DISTINCT name FROM x) n CROSS JOIN ks LEFT JOIN x ON x.name = n.name AND x.key = ks.key),
fy AS (SELECT n.name, ks.key, coalesce(value, 0) AS value FROM (SELECT DISTINCT name FROM y) n CROSS JOIN ks LEFT JOIN y ON y.name = n.name AND y.key = ks.key)"""


def _profiles(spark, d):
    one = scores(spark, d).select(F.col("gene").alias("key"), F.col("program").alias("name"), F.col("score").alias("value"))
    two = C.aggregate_by_type(counts(spark, d), types(spark, d)).select(F.col("gene").alias("key"), F.col("celltype").alias("name"), "value")
    return one, two


@register(_PROFILES + " SELECT fx.name AS a, fy.name AS b, round(corr(fx.value, fy.value), 6) AS score FROM fx JOIN fy ON fx.key = fy.key GROUP BY 1, 2")
def profile_pearson(spark, d):
    return rounded(P.similarity(*_profiles(spark, d)), "score")


@register(_PROFILES + """, rx AS (SELECT name, key, rank() OVER (PARTITION BY name ORDER BY value) + (count(*) OVER (PARTITION BY name, value) - 1) / 2.0 AS r FROM fx),
ry AS (SELECT name, key, rank() OVER (PARTITION BY name ORDER BY value) + (count(*) OVER (PARTITION BY name, value) - 1) / 2.0 AS r FROM fy)
SELECT rx.name AS a, ry.name AS b, round(corr(rx.r, ry.r), 6) AS score FROM rx JOIN ry ON rx.key = ry.key GROUP BY 1, 2""")
def profile_spearman(spark, d):
    return rounded(P.similarity(*_profiles(spark, d), "spearman"), "score")


@register(_PROFILES + " SELECT fx.name AS a, fy.name AS b, round(sum(fx.value * fy.value) / sqrt(sum(fx.value * fx.value) * sum(fy.value * fy.value)), 6) AS score FROM fx JOIN fy ON fx.key = fy.key GROUP BY 1, 2")
def profile_cosine(spark, d):
    return rounded(P.similarity(*_profiles(spark, d), "cosine"), "score")


@register()
def program_gene_scores(spark, d):
    return P.gene_scores(counts(spark, d), usage(spark, d))


@register(""", t AS (SELECT celltype, count(*) AS n FROM types GROUP BY 1)
SELECT gene, celltype, round(sum(count) / n, 6) AS value FROM counts JOIN types USING (spot) JOIN t USING (celltype) GROUP BY gene, celltype, n""")
def type_means(spark, d):
    return rounded(C.aggregate_by_type(counts(spark, d), types(spark, d), mean=True), "value")


@register(""", t AS (SELECT spot, sum(count) AS t FROM counts GROUP BY 1) SELECT gene, round(avg(ln(1 + count / t * 10000)), 6) AS value FROM counts JOIN t USING (spot) GROUP BY gene""")
def log_normalised(spark, d):
    return rounded(C.log_normalise(counts(spark, d)).groupBy("gene").agg(F.avg("value").alias("value")), "value")


@register(" SELECT round(count(*) / CAST(count(DISTINCT spot) * count(DISTINCT gene) AS DOUBLE), 6) AS density FROM counts")
def matrix_density(spark, d):
    return rounded(C.density(counts(spark, d)), "density")


@register(" SELECT CAST(floor(x / 100) AS BIGINT) AS bx, CAST(floor(y / 100) AS BIGINT) AS by, count(*) AS n_cells, sum(value) AS total FROM points GROUP BY 1, 2")
def bin_sums(spark, d):
    return S.bin_sums(points(spark, d), 100)


@register(" SELECT CAST(floor(x / 100) AS BIGINT) AS bx, CAST(floor(y / 100) AS BIGINT) AS by, count(*) AS n FROM points WHERE floor(x / 100) * 100 < x AND floor(y / 100) * 100 < y GROUP BY 1, 2")
def open_bins(spark, d):
    return S.grid_bins(points(spark, d), 100, open_=True).groupBy("bx", "by").agg(F.count("*").alias("n"))


@register(""", b AS (SELECT p_partkey AS box_id, p_retailprice AS x0, p_size * 10.0 AS y0, p_retailprice + 1.5 AS x1, p_size * 10.0 + 1.5 AS y1 FROM part),
q AS (SELECT p_partkey AS square_id, p_retailprice AS x0, p_size * 10.0 AS y0, p_retailprice + 2 AS x1, p_size * 10.0 + 2 AS y1 FROM part)
SELECT box_id, square_id FROM b JOIN q ON b.x0 <= q.x1 AND q.x0 <= b.x1 AND b.y0 <= q.y1 AND q.y0 <= b.y1""")
def box_overlaps(spark, d):
    part = _table(spark, d, "part")
    side = lambda name, w: part.select(F.col("p_partkey").alias(name), F.col("p_retailprice").alias("x0"), (F.col("p_size") * 10.0).alias("y0"), (F.col("p_retailprice") + w).alias("x1"), (F.col("p_size") * 10.0 + w).alias("y1"))
    return S.boxes_over_squares(side("box_id", 1.5), side("square_id", 2.0), 5.0)


@register(" SELECT event_type, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM events GROUP BY event_type")
def event_shares(spark, d):
    return rounded(S.shares(_table(spark, d, "events"), "event_type"), "share")


@register(""", u AS (SELECT program, usage / max(usage) OVER () AS x FROM usage)
SELECT program, CASE WHEN x <= 0.05 THEN 'D0' WHEN x <= 0.2 THEN 'D1' WHEN x <= 0.5 THEN 'D2' WHEN x <= 0.8 THEN 'D3' ELSE 'D4' END AS bin, count(*) AS n FROM u GROUP BY 1, 2""")
def density_bins(spark, d):
    u = usage(spark, d)
    top = u.agg(F.max("usage").alias("top"))
    return u.join(F.broadcast(top)).withColumn("x", F.col("usage") / F.col("top")).groupBy("program", S.density_bin("x").alias("bin")).agg(F.count("*").alias("n"))


@register(" SELECT program, CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE usage > t) AS n FROM usage, (VALUES (10), (50), (100)) v(t) GROUP BY 1, 2")
def threshold_counts(spark, d):
    return S.counts_above(usage(spark, d), "usage", "program", [10, 50, 100])


@register(" SELECT CAST(floor(usage / 25) AS BIGINT) AS bin, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) / 25, 9) AS density FROM usage GROUP BY 1")
def usage_histogram(spark, d):
    return rounded(S.histogram(usage(spark, d), "usage", 25.0), "density", digits=9)


_TOP = ", tp AS (SELECT program, gene FROM scores QUALIFY row_number() OVER (PARTITION BY program ORDER BY score DESC, gene) <= 20)"


def _top(spark, d):
    return P.rank_genes(scores(spark, d), 20).select(F.col("program").alias("set_name"), F.col("gene").alias("item"))


@register(_TOP + ", c AS (SELECT gene, string_agg(program, '+' ORDER BY program) AS combination FROM tp GROUP BY gene) SELECT combination, count(*) AS n FROM c GROUP BY 1")
def marker_memberships(spark, d):
    return S.memberships(_top(spark, d))


@register(_TOP + " SELECT x.program AS a, y.program AS b, round(count(*) / CAST(40 - count(*) AS DOUBLE), 6) AS jaccard FROM tp x JOIN tp y ON x.gene = y.gene AND x.program < y.program GROUP BY 1, 2")
def marker_jaccard(spark, d):
    return rounded(S.jaccard_of_sets(_top(spark, d)), "jaccard")


@register(""", m AS (SELECT c_mktsegment AS c, count(*) AS n, avg(c_acctbal) AS mean, var_samp(c_acctbal) AS var FROM customer GROUP BY 1)
SELECT x.c AS one, y.c AS two, round((x.mean - y.mean) / sqrt(x.var / x.n + y.var / y.n), 6) AS t,
  round(pow(x.var / x.n + y.var / y.n, 2) / (pow(x.var / x.n, 2) / (x.n - 1) + pow(y.var / y.n, 2) / (y.n - 1)), 4) AS df FROM m x JOIN m y ON x.c < y.c""")
def welch_tests(spark, d):
    values = _table(spark, d, "customer").select(F.col("c_mktsegment").alias("category"), F.col("c_acctbal").alias("value"))
    return rounded(rounded(P.pairwise_welch(values), "t"), "df", digits=4)


@register(" SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_events(spark, d):
    return S.last_by(_table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@register(" SELECT p_partkey, CASE WHEN k > 0 THEN p_name || '-' || k ELSE p_name END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part)")
def unique_names(spark, d):
    return S.unique_names(_table(spark, d, "part"), "p_name", "p_partkey").select("p_partkey", "unique_name")


@register()
def transport_factorisation(spark, d):
    return otnmf.factorise(counts(spark, d), otnmf.Settings(k=3, inner=1000, outer=100))[0]
