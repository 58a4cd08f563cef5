"""Driver contract and a DuckDB parity sample at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from sigwin.sources.fixtures import TABLES
from tests.conftest import SF001


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["contig", "position"] and "label" in df.columns
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 40


@pytest.mark.parametrize("name", ["clean_events", "m6a_train", "structure_train", "roc_auc",
                                  "exact_split", "profile_dedup", "metric_report", "predicted_class"])
def test_parity_sf0001(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    want = con.execute(E.oracle_sql()[name]).df()
    got = E.queries()[name](spark, SF001).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    def norm(df):
        rows = [tuple(None if v != v else v for v in r) for r in df[cols].itertuples(index=False)]
        return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert norm(got) == norm(want)
