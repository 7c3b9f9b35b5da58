"""Every registered query of the log against its SQL, on the smallest tables."""

import duckdb
import pytest

from tests.conftest import SF
from tidelog.plans.oracle import ORACLE
from tidelog.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE)))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    rel = duck.sql(ORACLE[name])
    assert cols == sorted(rel.columns)
    assert got == sorted(map(repr, rel.select(*(f'"{c}"' for c in cols)).fetchall()))


def test_all_queries_but_the_crc_have_sql():
    assert set(QUERIES) - set(ORACLE) == {"segment_crc"}


def test_latency_quantiles_of_many_rows_nulls_and_ties(spark, duck, tmp_path):
    """Ranks next to each other differ, in groups of more rows than a sketch keeps."""
    n = 400_000
    kind = "CASE WHEN id % 1000 = 7 THEN NULL WHEN id % 1000 = 8 THEN 'none' WHEN id < 9 THEN 'few' WHEN id % 2 = 0 THEN 'ties' ELSE 'many' END"
    value = "CASE WHEN id % 1000 = 8 OR id % 11 = 3 THEN NULL WHEN id % 2 = 0 THEN id % 5 WHEN id = 101 THEN double('nan') ELSE (id * 48271 % 1000003) / 4.0 - 9 END"
    spark.range(n).selectExpr("id AS event_id", f"{kind} AS event_type", f"CAST({value} AS double) AS value").write.parquet(f"{tmp_path}/events.parquet")
    con = duck.cursor()
    con.sql(f"CREATE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cols = ["event_type", "n", "p50", "p99", "p999"]
    got = QUERIES["latency_quantiles"](spark, str(tmp_path)).select(*cols).collect()
    want = con.sql(ORACLE["latency_quantiles"]).select(*cols).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert len(want) == 5


def test_segment_crc(spark):
    import zlib

    from tidelog.plans.logmodel import LogModel

    want = {(r["topic_id"], r["offset"]): zlib.crc32(r["value"].encode()) for r in LogModel(spark, SF).records.collect()}
    got = QUERIES["segment_crc"](spark, SF).collect()
    assert got and all(want[r["topic_id"], r["offset"]] == r["crc"] for r in got)


def test_segment_crc_covers_every_record(spark):
    import zlib
    from collections import defaultdict

    from tidelog.plans.logmodel import LogModel
    from tidelog.sources import seglog

    segs = defaultdict(list)
    for r in LogModel(spark, SF).records.collect():
        segs[r["topic_id"], r["flush_id"], r["schema_id"]].append((r["offset"], r["key"].encode(), r["value"].encode()))
    want = {(k[0], min(x)[0]): zlib.crc32(seglog.encode_records([y[1:] for y in sorted(x)])) for k, x in segs.items()}
    assert {(r["topic_id"], r["offset"]): r["segment_crc"] for r in QUERIES["segment_crc"](spark, SF).collect()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
