"""Shape of the plans: what reaches the scan, what is shuffled, what never appears."""

import pytest
from conftest import DAY, person, session_row

from boardpulse import ReportParams, UsageReport
from boardpulse.registry import QUERIES, report
from boardpulse.sources import testbed

BATCH = sorted(name for name in QUERIES if not name.endswith("_stream"))


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small enough to be broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("name", BATCH)
def test_no_plan_pairs_everything_or_runs_python(spark, sf_dir, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert operator not in plan


def test_nothing_is_broadcast_by_hint(spark, sf_dir, no_broadcast):
    assert not [name for name in BATCH if "BroadcastHashJoin" in plan_of(QUERIES[name](spark, sf_dir))]


def test_period_reaches_the_scan_of_the_raw_feed(spark, sf_dir):
    plan = plan_of(report(spark, sf_dir).base_kpis())
    assert "GreaterThanOrEqual(ts,2024-01-27T03:00)" in plan
    assert "LessThan(ts,2024-01-30T03:00)" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_raw_pings_combine_before_the_shuffle(spark, sf_dir):
    plan = plan_of(testbed.tables(spark, sf_dir).sessions())
    below = plan.split("Exchange", 1)[1]
    assert "partial_count" in below and "HashAggregate" in below


def test_shared_report_reads_the_facts_twice(make_tables):
    tables = make_tables(users=[person(1)], sessions=[session_row(1, 1, "https://a", DAY)])
    asked = []
    counting = tables.with_sessions(tables.sessions())
    source = counting.session_source
    object.__setattr__(counting, "session_source", lambda ranges: asked.append(ranges) or source(ranges))
    usage = UsageReport(counting, ReportParams(), DAY)
    usage.document().collect()
    usage.cards().collect()
    assert len(asked) == 2


def test_one_user_with_a_third_of_everything(spark):
    """A hot user's pings leave the map side as one row per page and day."""
    pings = spark.range(0, 300_000, 1, 8).selectExpr(
        "IF(id % 3 = 0, 7L, id % 1000) AS user_id",
        "IF(id % 2 = 0, 'https://hot', concat('https://p', id % 5)) AS dashboard_url",
        "timestamp_seconds(1710072000 + id % 86400) AS ts",
    )
    from boardpulse.streaming.engagement import engaged_ticks
    from boardpulse.streaming.rollup import roll_up

    sessions = roll_up(pings)
    assert sessions.agg({"duration_minutes": "sum"}).first()[0] == 300_000
    hot = sessions.where("user_id = 7").agg({"duration_minutes": "sum"}).first()[0]
    assert hot == pings.where("user_id = 7").count()
    # A user active all day earns at most every tick of the day, plus the last five minutes.
    assert engaged_ticks(pings).where("user_id = 7").count() == 86_400 // 30 + 9
