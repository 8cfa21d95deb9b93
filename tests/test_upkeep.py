import json
import random
from dataclasses import replace
from datetime import timedelta

import pytest
from conftest import DAY, person, session_row
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boardpulse import UsageReport
from boardpulse.operators import changes, integrity, removal
from boardpulse.operators.numbering import number_rows
from boardpulse.plans import directory
from boardpulse.session import run_dir
from boardpulse.sources import schemas
from boardpulse.sources.feeds import seed_rows
from boardpulse.sources.sinks import write_document, write_rows
from boardpulse.sources.tables import drop_legacy_columns, read_tables, write_sessions, write_tables

A = "https://a"


def rows(frame, *order):
    return [tuple(row) for row in frame.orderBy(*order).collect()]


def test_upsert_updates_supplied_columns_and_numbers_new_rows(spark):
    users = seed_rows(spark, [(1, "a", "A", "a@x", "user"), (5, "b", "B", None, "user")], schemas.USERS)
    wanted = spark.createDataFrame(
        [("b", "B2", 1), ("b", "B3", 2), ("z", "Z", 1), ("c", "C", 1), ("c", "C2", 3)],
        "username string, name string, seq long",
    )
    result = changes.upsert(users, wanted, ["username"], ["seq"], "id")
    assert rows(result, "id") == [
        (1, "a", "A", "a@x", "user"),
        (5, "b", "B3", None, "user"),
        (6, "c", "C2", None, None),
        (7, "z", "Z", None, None),
    ]
    assert result.columns == users.columns


def test_upsert_is_idempotent(spark):
    positions = seed_rows(spark, [(1, "P1", True)], schemas.POSITIONS)
    wanted = spark.createDataFrame([("P1", False), ("P2", True)], "name string, can_view_metrics boolean")
    once = changes.upsert(positions, wanted, ["name"], id_column="id")
    twice = changes.upsert(once, wanted, ["name"], id_column="id")
    assert rows(once, "id") == rows(twice, "id") == [(1, "P1", False), (2, "P2", True)]


def test_upsert_can_set_a_value_to_null(spark):
    users = seed_rows(spark, [person(1, email="x@y")], schemas.USERS)
    wanted = spark.createDataFrame([("user1", None)], "username string, email string")
    assert changes.upsert(users, wanted, ["username"]).first()["email"] is None


def test_upsert_of_bare_pairs_and_of_session_keys(spark):
    pairs = seed_rows(spark, [(1, 1)], schemas.USER_POSITIONS)
    wanted = seed_rows(spark, [(1, 1), (1, 2), (1, 2)], schemas.USER_POSITIONS)
    assert rows(changes.upsert(pairs, wanted, ["user_id", "position_id"]), "position_id") == [(1, 1), (1, 2)]
    facts = seed_rows(spark, [session_row(1, 1, "LOGIN_PORTAL", DAY, 1)], schemas.SESSIONS)
    login = facts.select("user_id", "dashboard_url", "session_date", F.lit(1).cast("long").alias("duration_minutes"))
    key = ["user_id", "dashboard_url", "session_date"]
    assert rows(changes.upsert(facts, login, key, id_column="id"), "id") == rows(facts, "id")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 50)), max_size=25), st.sets(st.integers(0, 6)))
def test_upsert_equals_a_dictionary(spark, wanted, known):
    snapshot = spark.createDataFrame([(n, f"k{n}", -1) for n in known], "id long, key string, value long")
    asked = spark.createDataFrame(
        [(f"k{key}", value, seq) for seq, (key, value) in enumerate(wanted)], "key string, value long, seq long"
    )
    expected = {f"k{n}": -1 for n in known} | {f"k{key}": value for key, value in wanted}
    result = changes.upsert(snapshot, asked, ["key"], ["seq"], "id").collect()
    assert {row["key"]: row["value"] for row in result} == expected
    assert len({row["id"] for row in result}) == len(expected) == len(result)


def test_numbers_are_dense_and_in_order(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    numbered = number_rows(frame.repartition(7), ["k"], "n", F.lit(10)).orderBy("k").collect()
    assert [row["n"] for row in numbered] == list(range(11, 1011))


def test_update_only_adds_nothing(spark):
    users = seed_rows(spark, [person(1)], schemas.USERS)
    latest = spark.createDataFrame([("user1", "New"), ("ghost", "G")], "username string, name string")
    assert rows(changes.update_by_key(users, latest, ["username"]), "id") == [(1, "user1", "New", None, "user")]


def test_assignment_by_name(make_tables, spark):
    tables = make_tables(
        users=[person(1), person(2)], positions=[(1, "P1", True), (2, "P2", False)], user_positions=[(1, 1)]
    )
    asked = spark.createDataFrame(
        [("user1", "P1"), ("user2", "P2"), ("user2", "P2"), ("user2", None), ("user2", ""), ("user2", "P9"), ("x", "P1")],
        "username string, position_name string",
    )
    done = changes.assign_by_name(tables.user_positions, tables.users, tables.positions, asked)
    assert rows(done.user_positions, "user_id") == [(1, 1), (2, 2)]
    assert rows(done.unresolved, "username") == [("user2", "P9", 2, None), ("x", "P1", None, 1)]


def test_replacement(spark):
    held = seed_rows(spark, [(1, 1), (1, 2), (2, 1), (3, 1)], schemas.USER_POSITIONS)
    wanted = spark.createDataFrame([(1, 2), (1, 3), (1, 3), (2, None)], "user_id long, position_id long")
    assert rows(changes.replace_assignments(held, wanted), "user_id", "position_id") == [(1, 2), (1, 3), (3, 1)]


@pytest.fixture
def tables(make_tables):
    return make_tables(
        users=[person(1), person(2)],
        positions=[(1, "P1", True), (2, "P2", False), (3, "P3", None)],
        user_positions=[(1, 1), (2, 1), (2, 2)],
        types=[(1, "T1", None), (2, "T2", None)],
        links=[(1, 1, 1, A), (2, 1, 2, A)],
        sessions=[session_row(1, 1, A, DAY), session_row(2, 2, A, DAY), session_row(3, None, A, DAY - timedelta(days=1))],
    )


def test_purging_users_leaves_no_orphans(spark, tables):
    left = removal.purge_users(tables, spark.createDataFrame([(2,), (2,)], "id long"))
    assert rows(left.users.select("id"), "id") == [(1,)]
    assert rows(left.user_positions, "user_id") == [(1, 1)]
    assert rows(left.sessions().select("id"), "id") == [(1,), (3,)]
    assert rows(left.sessions((DAY, DAY)).select("id"), "id") == [(1,)]
    assert integrity.audit(left).collect() == []


def test_purging_types(spark, tables):
    left = removal.purge_types(tables, spark.createDataFrame([(1,)], "id long"))
    assert rows(left.dashboard_types.select("id"), "id") == [(2,)]
    assert rows(left.dashboard_links.select("id"), "id") == [(2,)]


def test_positions_in_use_are_blocked(spark, tables):
    asked = spark.createDataFrame([(1,), (3,), (3,)], "id long")
    assert rows(removal.guard_positions(tables, asked), "position_id") == [(1, 2, "blocked"), (3, 0, "deleted")]
    assert rows(removal.delete_positions(tables, asked).positions.select("id"), "id") == [(1,), (2,)]


def test_audit_finds_every_kind(make_tables):
    broken = make_tables(
        users=[(1, "same", "A", None, "user"), (2, "same", "B", None, "user")],
        positions=[(1, "P", True), (2, "P", True)],
        user_positions=[(1, 1), (1, 1), (9, 1), (1, 8)],
        types=[(1, "T", None)],
        links=[(1, 7, 1, A), (2, 1, 6, A)],
        sessions=[session_row(1, 1, A, DAY), session_row(2, 1, A, DAY), session_row(3, 5, A, DAY), session_row(4, None, A, DAY)],
    )
    assert rows(integrity.audit(broken), "check") == [
        ("dashboard_links.dashboard_type_id", "6", 1),
        ("dashboard_links.position_id", "7", 1),
        ("positions.name", "P", 2),
        ("sessions.key", f"1|{A}|{DAY}", 2),
        ("sessions.user_id", "5", 1),
        ("user_positions.pair", "1|1", 2),
        ("user_positions.position_id", "8", 1),
        ("user_positions.user_id", "9", 1),
        ("users.username", "same", 2),
    ]


def test_legacy_columns(spark):
    old = spark.createDataFrame([(1, "P", "n", "u")], "id long, name string, dashboard_name string, dashboard_url string")
    assert drop_legacy_columns(old, "positions").columns == ["id", "name"]
    assert drop_legacy_columns(old.select("id", "name"), "positions").columns == ["id", "name"]


def test_stored_tables_round_trip_and_prune_days(spark, tables):
    root = run_dir(spark, "store")
    write_tables(tables, root)
    stored = read_tables(spark, root)
    for name in ("users", "positions", "user_positions", "dashboard_types", "dashboard_links"):
        frame = getattr(tables, name)
        assert rows(getattr(stored, name), *frame.columns) == rows(frame, *frame.columns)
    order = tables.sessions().columns
    assert rows(stored.sessions().select(order), "id") == rows(tables.sessions(), "id")
    plan = stored.sessions((DAY, DAY))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session_date" in plan
    assert rows(stored.sessions((DAY, DAY)).select("id"), "id") == [(1,), (2,)]


def test_tables_read_purged_and_written_to_the_same_root(spark, tables):
    root = run_dir(spark, "same-root")
    write_tables(tables, root)
    stored = read_tables(spark, root)
    gone = stored.users.select("id").orderBy("id").limit(1)
    number = gone.first()[0]
    before = {name: getattr(stored, name).count() for name in ("positions", "dashboard_types", "dashboard_links")}
    write_tables(removal.purge_users(stored, gone), root)
    again = read_tables(spark, root)
    assert {name: getattr(again, name).count() for name in before} == before
    assert again.users.where(f"id = {number}").isEmpty() and again.sessions().where(f"user_id = {number}").isEmpty()
    assert stored.users.where(f"id = {number}").count() == 1  # the old version is whole


def test_unfinished_version_does_not_count(spark, tables):
    root = run_dir(spark, "unfinished")
    write_tables(tables, root)
    spark.range(1).write.parquet(f"{root}/version-99999999999999999999-broken/users")
    assert read_tables(spark, root).users.count() == tables.users.count()


def test_writing_a_day_keeps_the_others(spark, tables):
    folder = run_dir(spark, "days")
    sessions = tables.sessions()
    write_sessions(sessions, folder)
    days = sorted(row[0] for row in sessions.select("session_date").distinct().collect())
    write_sessions(sessions.where(F.col("session_date") == F.lit(days[0])).limit(1), folder)
    stored = spark.read.schema(sessions.schema).parquet(folder)
    assert stored.where(F.col("session_date") == F.lit(days[0])).count() == 1
    assert sorted(row[0] for row in stored.select("session_date").distinct().collect()) == days


@pytest.mark.parametrize("fmt", ["csv", "json", "orc"])
def test_other_formats(spark, tables, fmt):
    root = run_dir(spark, fmt)
    for name in schemas.DOMAIN:
        frame = tables.sessions() if name == "activity_sessions" else getattr(tables, name)
        frame.write.format(fmt).option("header", True).save(f"{root}/{name}")
    again = read_tables(spark, root, fmt)
    assert rows(again.users, "id") == rows(tables.users, "id")
    assert rows(again.sessions(), "id") == rows(tables.sessions(), "id")


def test_insertion_refuses_taken_keys_and_copies(spark):
    users = seed_rows(spark, [person(1)], schemas.USERS)
    asked = spark.createDataFrame(
        [("user1", "X"), ("new", "A"), ("new", "B"), ("new", "B"), ("other", None)], "username string, name string"
    )
    done = changes.insert_new(users, asked, ["username"], "id")
    assert rows(done.added.select("id", "username", "name"), "id") == [(2, "new", "B"), (3, "other", None)]
    assert rows(done.rejected, "username", "name") == [("new", "A", 1), ("new", "B", 1), ("user1", "X", 1)]


ENROLMENT = "username string, name string, email string, role string, position_ids array<long>"


def test_enrolment(spark, tables):
    asked = spark.createDataFrame(
        [
            ("new", "N", "", "user", [1, 3, 3]),
            ("user1", "Again", None, "user", [3]),
            ("", "Nameless", None, "user", None),
            ("norole", "N", None, None, None),
            ("bare", "B", "b@x", "admin", None),
        ],
        ENROLMENT,
    )
    done = directory.enroll_users(tables, asked)
    assert rows(done.tables.users.where("id > 2"), "id") == [
        (3, "bare", "B", "b@x", "admin"),
        (4, "new", "N", None, "user"),
    ]
    assert rows(done.tables.user_positions.where("user_id > 2"), "position_id") == [(4, 1), (4, 3)]
    assert rows(done.rejected, "username") == [
        ("", "Missing required fields: username"),
        ("norole", "Missing required fields: role"),
        ("user1", "Username already exists"),
    ]


def test_revision_replaces_positions(spark, tables):
    asked = spark.createDataFrame(
        [(1, "user1", "One", "", "admin", [2, 3]), (2, "user2", "Two", "t@x", "user", []), (9, "u9", "N", None, "user", [1])],
        "id long, " + ENROLMENT,
    )
    done = directory.revise_users(tables, asked)
    assert rows(done.tables.users, "id") == [(1, "user1", "One", None, "admin"), (2, "user2", "Two", "t@x", "user")]
    assert rows(done.tables.user_positions, "position_id") == [(1, 2), (1, 3)]
    assert [row["id"] for row in done.rejected.collect()] == [9]


def test_directory_load_twice_is_once(spark, tables):
    positions = spark.createDataFrame([("P1",), ("P9",)], "name string")
    people = seed_rows(
        spark, [("user1", "One", "user", "P9"), ("fresh", "F", "user", "P1"), ("boss", "B", "admin", None)], schemas.SEED_USERS
    )
    once = directory.load_directory(tables, positions, people)
    twice = directory.load_directory(once.tables, positions, people)
    for name in ("users", "positions", "user_positions"):
        frame = getattr(once.tables, name)
        assert rows(frame, *frame.columns) == rows(getattr(twice.tables, name), *frame.columns)
    assert rows(once.tables.positions, "id")[-1] == (4, "P9", None)
    assert rows(once.tables.user_positions, "user_id", "position_id") == [(1, 1), (1, 4), (2, 1), (2, 2), (4, 1)]
    assert once.rejected.collect() == []


def test_position_flag_is_off_unless_on(spark):
    asked = spark.createDataFrame([("A", None), ("B", True), ("", True)], "name string, can_view_metrics boolean")
    assert rows(directory.clean_positions(asked), "name") == [("A", False), ("B", True)]


def test_nobody_purges_themselves(spark, tables):
    left = removal.purge_users(tables, spark.createDataFrame([(1,), (2,)], "id long"), acting_user=1)
    assert rows(left.users.select("id"), "id") == [(1,)]


def test_sinks_keep_nulls(spark, tables):
    root = run_dir(spark, "sinks")
    write_rows(tables.users, f"{root}/users", "json")
    assert '"email":null' in spark.read.text(f"{root}/users").first()[0]
    write_document(UsageReport(tables, as_of=DAY).document(), f"{root}/document")
    assert json.loads(spark.read.text(f"{root}/document").first()[0])["kpis"]["total_sessions"] == 6


def test_only_changed_days_are_audited_again(spark, monkeypatch):
    dice = random.Random(4)
    rows = [session_row(n, dice.randrange(6), f"p{dice.randrange(3)}", DAY + timedelta(days=dice.randrange(4))) for n in range(60)]
    facts = seed_rows(spark, rows, schemas.SESSIONS)
    users = seed_rows(spark, [person(number) for number in (1, 2, 4)], schemas.USERS)
    folder = run_dir(spark, "audited")
    kept = integrity.FactAudit(spark, f"{folder}/f", f"{folder}/a", facts.schema)

    def expected(frame):
        whole = integrity.fact_findings(integrity.day_users(frame), users)
        again = integrity.duplicates(frame, ["user_id", "dashboard_url", "session_date"]).count()
        lost = integrity.orphans(frame, "user_id", users).count()
        assert (whole[0].count(), whole[1].count()) == (again, lost)
        return rows_of(whole[0].unionByName(whole[1]))

    def rows_of(frame):
        return sorted(map(tuple, frame.select("check", "key", "rows").collect()))

    write_sessions(facts, f"{folder}/f")
    assert len(kept.refresh()) == 4
    assert rows_of(kept.findings(users)) == expected(facts)
    assert kept.refresh() == []
    # One day is written again: that day alone is read.
    day = facts.where(F.col("session_date") == F.lit(DAY))
    write_sessions(day.limit(3).unionByName(day.limit(3)), f"{folder}/f")
    # A run that dies before the fingerprint leaves the day to be done.
    with monkeypatch.context() as patched:
        write = kept._write
        patched.setattr(kept, "_write", lambda frame, name: write(frame, name) if name == "days" else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            kept.refresh()
    assert kept.refresh() == [DAY]
    stored = spark.read.schema(facts.schema).parquet(f"{folder}/f")
    assert rows_of(kept.findings(users)) == expected(stored)
    # A day that is gone does not count any more.
    fewer = facts.where(F.col("session_date") > F.lit(DAY))
    write_sessions(fewer, f"{folder}/f", replace_all=True)
    assert DAY not in kept.refresh()
    assert rows_of(kept.findings(users)) == expected(fewer)


def test_audit_reads_the_facts_once(spark, tables):
    reads = []

    def source(ranges):
        reads.append(ranges)
        return tables.session_source(ranges)

    integrity.audit(replace(tables, session_source=source)).collect()
    assert len(reads) == 1
