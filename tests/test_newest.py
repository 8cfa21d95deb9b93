"""The backward day scan: same rows as a sort of everything, few days opened."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import DAY, person, session_row
from pyspark.sql import functions as F

from boardpulse.operators.newest import as_ranges, newest_rows
from boardpulse.plans.audit import _newest_first, audit_log
from boardpulse.session import run_dir
from boardpulse.sources import schemas
from boardpulse.sources.feeds import seed_rows
from boardpulse.sources.tables import from_frame
from boardpulse.sources.zones import Zone, read_zones, write_zoned_sessions

NOON = datetime(2024, 3, 10, 12, tzinfo=timezone.utc)


def facts_of(spark, seed, days=25, rows=250, null_days=(), stray=False):
    """Sessions whose last ping may lie days after their own day, tie, or be missing."""
    dice, found = random.Random(seed), []
    for number in range(rows):
        day = dice.randrange(days)
        ping = NOON + timedelta(days=day, minutes=dice.randrange(0, 600, 60))
        if stray and dice.random() < 0.1:
            ping += timedelta(days=dice.randrange(days))
        if day in null_days and dice.random() < 0.2:
            ping = None
        found.append(session_row(number, dice.randrange(5), "https://a", DAY + timedelta(days=day), last=ping))
    return seed_rows(spark, found, schemas.SESSIONS)


def store(spark, facts):
    folder = run_dir(spark, "zoned")
    write_zoned_sessions(facts, f"{folder}/f", f"{folder}/z")
    stored = spark.read.schema(facts.schema).parquet(f"{folder}/f")

    return from_frame(stored), f"{folder}/f", f"{folder}/z"


def ids(frame):
    return [row["id"] for row in frame.orderBy(*_newest_first()).collect()]


@pytest.mark.parametrize("limit", [1, 60])
@pytest.mark.parametrize("shape", ["plain", "nulls", "stray"])
def test_same_rows_as_a_sort_of_everything(spark, limit, shape):
    facts = facts_of(spark, limit, null_days=(3, 11) if shape == "nulls" else (), stray=shape == "stray")
    read, path, zones = store(spark, facts)
    some = (DAY + timedelta(days=4), DAY + timedelta(days=20))
    known = read_zones(spark, path, zones)
    for keep, bounds in ((None, (None, None)), (F.col("user_id") == 2, some), (F.col("user_id") == 99, (None, None))):
        inside = facts if bounds[0] is None else facts.where(F.col("session_date").between(*bounds))
        expected = inside if keep is None else inside.where(keep)
        found, _ = newest_rows(read, known, limit, _newest_first(), bounds, keep)
        assert ids(found) == ids(expected.orderBy(*_newest_first()).limit(limit))


def test_only_the_newest_days_are_opened(spark):
    facts = facts_of(spark, 1, days=60, rows=1200)
    read, path, zones = store(spark, facts)
    found, opened = newest_rows(read, read_zones(spark, path, zones), 30, _newest_first())
    assert len(found.collect()) == 30
    assert 2 <= len(opened) <= 6 and min(opened) >= DAY + timedelta(days=54)


def test_days_with_missing_pings_are_opened_for_these(spark):
    facts = facts_of(spark, 2, days=60, rows=1200, null_days=(5,))
    read, path, zones = store(spark, facts)
    _, opened = newest_rows(read, read_zones(spark, path, zones), 30, _newest_first())
    assert DAY + timedelta(days=5) in opened and len(opened) <= 7


def test_days_without_a_zone_are_opened(spark):
    facts = facts_of(spark, 3)
    read, path, zones = store(spark, facts)
    known = [zone if zone.day != DAY + timedelta(days=2) else Zone(zone.day) for zone in read_zones(spark, path, zones)]
    found, opened = newest_rows(read, known, 20, _newest_first())
    assert DAY + timedelta(days=2) in opened
    assert ids(found) == ids(facts.orderBy(*_newest_first()).limit(20))


def test_writer_that_dies_leaves_unknown_days(spark, monkeypatch):
    from boardpulse.sources import zones as module

    facts = facts_of(spark, 4, days=5)
    read, path, zones = store(spark, facts)
    monkeypatch.setattr(module, "day_zones", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    newer = facts_of(spark, 5, days=3)
    with pytest.raises(KeyboardInterrupt):
        write_zoned_sessions(newer, path, zones)
    known = read_zones(spark, path, zones)
    assert [zone.day for zone in known if zone.facts is None] == [DAY + timedelta(days=n) for n in range(3)]
    stored = spark.read.schema(facts.schema).parquet(path)
    found, _ = newest_rows(from_frame(stored), known, 10, _newest_first())
    assert ids(found) == ids(stored.orderBy(*_newest_first()).limit(10))


def test_facts_without_a_day_have_no_order(spark):
    facts = facts_of(spark, 6, days=3).withColumn("session_date", F.when(F.col("id") % 7 > 0, F.col("session_date")))
    folder = run_dir(spark, "dayless")
    write_zoned_sessions(facts, f"{folder}/f", f"{folder}/z", days=[DAY, DAY + timedelta(days=1), DAY + timedelta(days=2)])
    assert read_zones(spark, f"{folder}/f", f"{folder}/z") is None


def test_empty_store(spark):
    folder = run_dir(spark, "nothing")
    assert read_zones(spark, f"{folder}/f", f"{folder}/z") == []
    facts = facts_of(spark, 7, rows=0)
    found, opened = newest_rows(lambda ranges: facts, [], 5, _newest_first())
    assert found.count() == 0 and opened == []


def test_neighbouring_days_are_one_range():
    days = [DAY + timedelta(days=n) for n in (0, 1, 2, 5, 7, 8)]
    assert as_ranges(days[::-1]) == [(days[0], days[2]), (days[3], days[3]), (days[4], days[5])]


def test_log_with_and_without_zones(spark, make_tables):
    facts = facts_of(spark, 8, null_days=(1,))
    read, path, zones = store(spark, facts)
    tables = make_tables(users=[person(number) for number in range(4)]).with_sessions(spark.read.schema(facts.schema).parquet(path))
    for options in ({}, {"user_id": 3, "limit": 9}):
        plain = audit_log(tables, **options).collect()
        assert audit_log(tables, zones=read_zones(spark, path, zones), **options).collect() == plain
