"""Every registered query of the subpackage on empty tables and on tables with nulls, repeated rows, long texts and clashing names."""

import duckdb
import pytest
from pyspark.sql import functions as F

from mailloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "labels", "conversations")
CLASH = "n_words score component_id spans kept uid word part data fp th x links n key vec salt h held_out rank n_turns k a b t y grp blk length".split()


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for name in ("empty", "awkward"):
        out[name] = str(tmp_path_factory.mktemp(name))
        for t in TABLES:
            df = spark.read.parquet(f"{SF}/{t}.parquet")
            more = [F.lit("zz").alias(c) for c in CLASH if c not in df.columns]
            wide = df.select("*", *more)
            if name == "empty":
                wide = df.limit(0)
            else:
                nulls = wide.limit(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in wide.schema))
                wide = wide.unionByName(nulls).unionByName(wide.limit(5))
                if t == "documents":
                    wide = wide.unionByName(wide.limit(2).withColumn("text", F.repeat(F.lit("long wörd "), 20_000)))
            wide.coalesce(1).write.parquet(f"{out[name]}/{t}.parquet")
    return out


@pytest.mark.parametrize("query", sorted(SQL))
def test_sql(spark, query):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, cur = QUERIES[query](spark, SF), con.execute(SQL[query])
    names = [c[0] for c in cur.description]
    assert set(names) <= set(df.columns) | {"text"}
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, cur.fetchall()))


@pytest.mark.parametrize("query", sorted(QUERIES))
def test_empty_tables(spark, folders, query):
    assert QUERIES[query](spark, folders["empty"]).count() == 0


@pytest.mark.parametrize("query", sorted(QUERIES))
def test_awkward_tables(spark, folders, query):
    got = QUERIES[query](spark, folders["awkward"])
    n = spark.read.parquet(f"{folders['awkward']}/documents.parquet").count()
    assert len(got.collect()) == n if query.split("_")[0] in ("op1", "op4", "op5", "op6", "op9", "op10", "secret", "quality") else got.count() > 0
    assert len(set(got.columns)) == len(got.columns)
