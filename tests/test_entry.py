"""Driver contract: names match, every query runs, samples agree with their SQL."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["token_count", "evidence_fuse", "impact_report", "co_change", "budget_fit", "live_telemetry", "live_traces", "alert_stream", "resolve_targets"])
def test_sample_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    want = connection.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def plain(frame):
        return sorted(map(repr, frame[columns].astype(object).itertuples(index=False, name=None)))

    assert plain(got) == plain(want)
