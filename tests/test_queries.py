import importlib

import pytest
from helpers import oracle, rows_of

from spanloom import queries

NAMES = sorted(queries.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf, name):
    got = queries.queries()[name](spark, sf).toPandas()
    want = oracle(queries.oracle_sql()[name], sf)
    assert rows_of(got) == rows_of(want)


def test_window_holds_the_whole_table(spark, sf):
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    run = {x: queries.queries()[x](spark, sf) for x in ("count_global", "heatmap", "count_over_time", "exemplars_attached", "match_eq")}
    total = {x: run[x].selectExpr(f"sum({c})").first()[0] for x, c in (("count_global", "value"), ("heatmap", "count"), ("count_over_time", "value"), ("exemplars_attached", "value"))}
    assert set(total.values()) == {n}
    assert run["match_eq"].count() == queries.tables(spark, sf)[0].where("tags['k'] = '7'").count()


def test_entry(spark):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).columns == ["series", "time_ns", "value"]
    assert set(NAMES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_scan_prunes_and_pushes(spark, sf, tmp_path):
    s, _ = queries.tables(spark, sf)
    s.write.parquet(str(tmp_path / "s"))
    from spanloom.operators.matchers import Matcher, select

    d = select(spark.read.parquet(str(tmp_path / "s")), [Matcher("service_name", "=", "svc-1")], 5, 9).groupBy("name").count()
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "tags" not in plan.split("PushedFilters")[-1].split("ReadSchema")[-1] and "GreaterThanOrEqual(end_time,5)" in plan
