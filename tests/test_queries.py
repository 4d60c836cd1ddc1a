"""Every query against its SQL, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from maieutic.plans import catalogue


def plain(v):
    if isinstance(v, float):
        return "%.9g" % v
    if isinstance(v, decimal.Decimal):
        return "%.9g" % float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def rows_of(rows, columns):
    return sorted(str([plain(r[c]) for c in sorted(columns)]) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    got = [r.asDict() for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    k = duck.execute(sql)
    columns = [d[0] for d in k.description]
    want = [dict(zip(columns, r)) for r in k.fetchall()]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["batch_id", "episode_id", "topic", "reward"]
    assert df.count() > 0


def test_entry_without_the_training_data_package(monkeypatch):
    monkeypatch.setattr(entry, "_llm", lambda: None)
    assert set(entry.queries()) == set(catalogue.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_grading_item_has_all_fields(spark):
    kind = "topic string, task struct<statement:string,buggy_solution:string,failing_asserts:array<string>,metadata:string>, hint struct<text:string,raw_text:string>"
    rows = [("t", ("s" * 700, "x = 1" + "1" * 3000, [], '{"observed_failure": "E", "execution_status": "passed"}'), ("short", "raw")), (None, (None, None, None, None), ("short", ""))]
    full, bare = (r.x for r in spark.createDataFrame(rows, kind).select(catalogue.grading_item().alias("x")).collect())
    assert (full.topic, full.statement, full.execution_status, full.assistant_response) == ("t", "s" * 600, "passed", "raw")
    assert len(full.buggy_code) == 2200 and full.buggy_code.startswith("x = 11") and "E" in full.observed_failure
    assert (bare.topic, bare.statement, bare.execution_status, bare.assistant_response) == ("", "", "failed", "short")
