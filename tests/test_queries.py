"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import importlib.util
import math
import os

import duckdb
import pandas as pd
import pytest

from costlens.plans import catalogue, catalogue_scan, catalogue_sites, catalogue_text  # noqa: F401

DATA = os.environ.get("COSTLENS_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    if v is None or v is pd.NA or v != v:
        return None
    return round(v, 9) if isinstance(v, float) and not math.isinf(v) else v


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def test_each_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_is_its_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_event_is_numbered(spark):
    assert catalogue.QUERIES["renumber_every_case"](spark, DATA).count() == spark.read.parquet(f"{DATA}/events.parquet").count()


def test_every_line_and_conversation_is_a_site(spark):
    rows = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    assert catalogue.QUERIES["site_numbering_every"](spark, DATA).count() == rows("lineitem").count()
    for name in ("prompt_estimate_every", "estimate_every_site"):
        assert catalogue.QUERIES[name](spark, DATA).count() == rows("conversations").select("conv_id").distinct().count()


def test_entry_imports_without_the_corpus_operators(tmp_path, monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "costlens.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    spec = importlib.util.spec_from_file_location("entry_alone", os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) == set(catalogue.SQL)
