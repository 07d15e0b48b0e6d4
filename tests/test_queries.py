"""Every core query with a SQL form against DuckDB over the smallest tables; the others run."""

import glob
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lorekiln.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    none = lambda x: x is None or (not isinstance(x, str) and pd.api.types.is_scalar(x) and pd.isna(x))
    value = lambda x: "-" if none(x) else f"{float(x):.6f}" if isinstance(x, numbers.Real) and not isinstance(x, (bool, np.bool_)) else str(x)
    return sorted(tuple(value(x) for x in row) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(DATA + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    if name in catalogue.oracle_sql():
        want = duck.execute(catalogue.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_files_of_every_entity(spark, duck):
    got = catalogue.queries()["docs_for_entity"](spark, DATA).count()
    assert got == duck.execute("select count(distinct entity_id) from entity_document_mentions m semi join document_registry using (file_path) where entity_id in (select id from entities)").fetchone()[0]
