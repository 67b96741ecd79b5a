"""Every registered query against its SQL in DuckDB, on the small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from vetta import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def told(x):
    if pd.isna(x):
        return ""
    return repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(df):
    return sorted(tuple(map(told, r)) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    found = catalog.QUERIES[name](spark, FOLDER).toPandas()
    if name in catalog.ORACLE:
        wanted = tables.execute(catalog.ORACLE[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)


def test_logs_and_descriptions_are_whole_texts(spark):
    from vetta.plans.fixtures import view

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id is not null").selectExpr("doc_id", "text")
    assert docs.where("length(text) > 2000").count()
    for name, column in (("findings", "description"), ("logs", "log")):
        both = view(spark, FOLDER, name).select("doc_id", column).join(docs, "doc_id")
        assert both.where(f"not endswith({column}, text)").count() == 0
