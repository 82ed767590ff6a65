"""Every query of the core library against its SQL at sf0.001, and each other one for a stable schema."""

import duckdb
import pytest

from lexigrid import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"lda_topics", "lda_corpus_topics", "svm_predict", "word2vec_neighbours"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, columns):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(round(r[k], 9) if isinstance(r[k], float) else r[k] for k in at) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF)
    theirs = duck.sql(catalog.SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain([tuple(r) for r in ours.collect()], ours.columns) == plain(theirs.fetchall(), theirs.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - SLOW))
def test_others_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
