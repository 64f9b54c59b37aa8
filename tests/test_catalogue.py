"""Every catalogue query against its SQL in DuckDB, and the driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from crownlake.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        cur = duck.execute(SQL[name])
        assert got == rows([c[0] for c in cur.description], cur.fetchall())
    else:
        assert got[1] or name in ("occupied_union",)


def test_entry(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(entry, "SMOKE_DIR", sf_dir)
    df = entry.entry(spark)
    assert df.columns == ["folder", "n", "med_diameter", "med_compactness", "mean_coverage"] and df.count() > 0
    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partitioning_does_not_matter(spark, sf_dir):
    found = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append([sorted(map(repr, catalogue.queries()[q](spark, sf_dir).collect())) for q in ("adjacency_saddles", "match_greedy", "pooled_ap", "iou_pairs", "merge_round")])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]
