"""Users taken out of stored facts: only their days change, nothing of them is left."""

import os
from datetime import timedelta

import pytest
from conftest import DAY, person, session_row
from pyspark.sql import functions as F

from boardpulse.operators import stored_purge
from boardpulse.operators.presence import Presence, write_presence
from boardpulse.operators.stored_purge import purge_stored_facts
from boardpulse.session import run_dir
from boardpulse.sources import schemas
from boardpulse.sources.feeds import seed_rows
from boardpulse.sources.tables import write_sessions

# Users by day; day 3 is only user 2's, day 4 has nobody known.
VISITS = {0: [1, 2, 3], 1: [1, 3], 2: [2, 40_000], 3: [2], 4: [None], 5: [40_000, 3]}


@pytest.fixture
def store(spark):
    rows = [(user, page, DAY + timedelta(days=day)) for day, users in VISITS.items() for user in users for page in ("a", "b")]
    facts = seed_rows(spark, [session_row(n, *row) for n, row in enumerate(rows)], schemas.SESSIONS)
    folder = run_dir(spark, "purge")
    write_sessions(facts, f"{folder}/f")
    write_presence(facts, f"{folder}/p")
    return facts, f"{folder}/f", f"{folder}/p"


def files(path):
    return {name: sorted(os.listdir(f"{path}/{name}")) for name in os.listdir(path) if "=" in name}


def visits(spark, path):
    found = spark.read.schema(schemas.SESSIONS).parquet(path)
    return sorted({(str(r["user_id"]), str(r["session_date"])) for r in found.collect()})


def expected(gone):
    return sorted({(str(u), str(DAY + timedelta(days=d))) for d, users in VISITS.items() for u in users if u not in gone})


def ids(spark, *users):
    return seed_rows(spark, [person(user) for user in users], schemas.USERS).select("id")


@pytest.mark.parametrize("gone", [(2,), (1, 40_000), (99,), (1, 2, 3, 40_000)])
def test_only_their_days_are_written_again(spark, store, make_tables, gone):
    _, facts, presence = store
    before = files(facts)
    days = purge_stored_facts(spark, facts, presence, schemas.SESSIONS, ids(spark, *gone))
    assert days == [DAY + timedelta(days=d) for d, users in VISITS.items() if set(users) & set(gone)]
    assert visits(spark, facts) == expected(gone)
    touched = {f"session_date={day}" for day in days}
    after = files(facts)
    assert {name: names for name, names in after.items() if name not in touched} == {name: names for name, names in before.items() if name not in touched}
    left = {f"session_date={DAY + timedelta(days=d)}" for d, users in VISITS.items() if set(users) - set(gone)}
    assert set(after) == left
    periods = spark.createDataFrame([("all", None, None)], "name string, start date, end date")
    if {1, 2, 3, 40_000} - set(gone):
        users = Presence.stored(spark, make_tables(), presence).users_of(periods).first()["unique_users"]
        assert users == len({1, 2, 3, 40_000} - set(gone))
    # Nobody is left to be found a second time.
    if set(after) - {f"session_date={DAY + timedelta(days=4)}"}:
        assert purge_stored_facts(spark, facts, presence, schemas.SESSIONS, ids(spark, *gone)) == []


def test_a_purge_that_dies_is_finished_by_the_next(spark, store, monkeypatch):
    _, facts, presence = store
    with monkeypatch.context() as patched:
        patched.setattr(stored_purge, "write_presence", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            purge_stored_facts(spark, facts, presence, schemas.SESSIONS, ids(spark, 2))
    assert purge_stored_facts(spark, facts, presence, schemas.SESSIONS, ids(spark, 2))
    assert visits(spark, facts) == expected({2})
    assert purge_stored_facts(spark, facts, presence, schemas.SESSIONS, ids(spark, 2)) == []


def test_days_of_nobody_are_not_opened(spark, store):
    _, facts, presence = store
    doomed = ids(spark, 1).where(F.lit(False))
    assert purge_stored_facts(spark, facts, presence, schemas.SESSIONS, doomed) == []
