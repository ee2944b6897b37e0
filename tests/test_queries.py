"""Every registered query with SQL agrees with it on the small tables."""

import os

import pytest

from tissueloom.plans import more  # noqa: F401  registers its queries as well
from tissueloom.plans import queries as q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("None" if v is None or v != v else repr(round(v, 5)) if isinstance(v, float) else str(v) for v in row) for row in frame.itertuples(index=False))


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and q.FLAGSHIP in entry.queries()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert normal(q.QUERIES[name](spark, DATA).toPandas()) == normal(con.execute(q.ORACLE_SQL[name]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")
def test_factorisation_gets_every_gene_and_the_runner_s_limits(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(q.otnmf, "factorise", lambda counts, settings: seen.append((counts, settings)) or (counts,))
    q.QUERIES["transport_factorisation"](spark, DATA)
    (given, settings), whole = seen[0], q.counts(spark, DATA)
    assert given.exceptAll(whole).isEmpty() and whole.exceptAll(given).isEmpty()
    assert (settings.k, settings.inner, settings.outer) == (3, 1000, 100)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")
def test_enrichment_takes_the_sets_of_all_parts(spark):
    import duckdb

    want = dict(duckdb.sql(f"SELECT 'set' || (p_size % 5), count(DISTINCT p_partkey % 97) FROM '{DATA}/part.parquet' GROUP BY 1").fetchall())
    assert {r.set_name: r.set_size for r in q.QUERIES["set_enrichment"](spark, DATA).collect()} == want
