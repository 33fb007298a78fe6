"""Every query with SQL against DuckDB on the smallest tables, and properties of those without."""

import math
import os

import duckdb
import pytest

from rulespan import plans
from tests.conftest import SF


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return sorted((tuple(plain(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    got, want = plans.QUERIES[name](spark, sf).toPandas(), duck.sql(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_cascade_finds_loose_quotes(spark, sf):
    r = plans.QUERIES["quote_locate_cascade"](spark, sf).toPandas()
    assert (r.confidence > 0).mean() > 0.95


def test_greedy_match_is_one_to_one(spark, sf):
    r = plans.QUERIES["greedy_span_match"](spark, sf).toPandas()
    assert not r.duplicated(["sample", "gt"]).any() and not r.duplicated(["sample", "pred"]).any() and len(r)


def test_faulty_check_is_inconclusive(spark, sf):
    r = plans.QUERIES["experience_checks"](spark, sf).toPandas()
    assert set(r[r.rule_id == "faulty"].result) == {"inconclusive"}


def test_stream_agrees_with_batch(spark, sf, tmp_path):
    from rulespan.streaming.events import read, windowed

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    q = windowed(read(spark, str(tmp_path / "in"), events)).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("hours").toPandas()) == rows(windowed(events).toPandas())


def test_texts_are_read_once_for_all_primitives(spark, sf):
    plan = plans.QUERIES["primitive_checks"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    before, _, after = plan.partition("Generate")
    assert "text#" not in before and after.count("AS norm") == 1


def test_lines_are_read_once_for_symbols(spark, sf):
    """One pass over all lines, and two over those with a relation: of what is used, and of heads."""
    plan = plans.QUERIES["symbol_graph"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") == 3
