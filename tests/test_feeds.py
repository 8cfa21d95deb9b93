"""Feed jobs against brute force, and streams against the batch jobs."""

import os
import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from boardpulse.functions.calendar import local_day
from boardpulse.session import run_dir
from boardpulse.sources import schemas
from boardpulse.sources.feeds import accepted_pings, event_time, read_ping_stream, seed_rows, split_by_required
from boardpulse.streaming import engagement, ratewatch, rollup
from boardpulse.streaming.runner import drain, drain_partials, drain_parts, finish

ZONE = "America/Argentina/Buenos_Aires"
START = datetime(2024, 3, 9, 22, 0, tzinfo=timezone.utc)
PAGES = ["https://a", "https://b", None]


def activity_rows(seed, users=4, rows=400, spread=12_000, grid=False):
    """Dense activity with repeated instants; ``grid`` puts much of it on tick borders."""
    dice = random.Random(seed)
    found = []
    for _ in range(rows):
        second = dice.randrange(spread)
        if grid and dice.random() < 0.5:
            second -= second % 30
        found.append((dice.randrange(users), dice.choice(PAGES), START + timedelta(seconds=second)))
    return found


def brute_ticks(rows, idle=300, tick=30):
    """Walk the clock: at each tick look up every user's latest activity before it."""
    by_user = defaultdict(list)
    for user, page, ts in rows:
        by_user[user].append((ts.timestamp(), page or "", page))
    found = Counter()
    for user, acts in by_user.items():
        acts.sort(key=lambda act: act[:2])
        first, last = acts[0][0], acts[-1][0]
        g = (int(first) // tick) * tick
        while g <= last + idle + tick:
            seen = [act for act in acts if act[0] < g]
            if seen and g - seen[-1][0] <= idle and seen[-1][2] is not None:
                found[(user, seen[-1][2], int(g))] += 1
            g += tick
    return found


def brute_stays(rows, gap):
    by_user = defaultdict(list)
    for user, _, ts in rows:
        by_user[user].append(ts.timestamp())
    found = Counter()
    for user, times in by_user.items():
        times.sort()
        stay = [times[0]]
        for now in times[1:]:
            if now - stay[-1] > gap:
                found[(user, stay[0], stay[-1], len(stay))] += 1
                stay = []
            stay.append(now)
        found[(user, stay[0], stay[-1], len(stay))] += 1
    return found


def as_ticks(frame):
    return Counter((row[0], row[1], int(row[2].timestamp())) for row in frame.select("user_id", "dashboard_url", F.col("ts")).collect())


def as_stays(frame):
    return Counter(
        (row["user_id"], row["session_start"].timestamp(), row["last_activity"].timestamp(), row["activities"])
        for row in frame.collect()
    )


def store_chunks(spark, frame, count, purpose):
    """The rows as ``count`` json files, one per micro-batch."""
    folder = run_dir(spark, purpose)
    frame.repartition(count).write.json(folder)
    return folder


@pytest.mark.parametrize("seed,grid", [(1, False), (2, True), (3, True)])
def test_ticks_equal_brute_force(spark, seed, grid):
    rows = activity_rows(seed, grid=grid)
    frame = seed_rows(spark, rows, schemas.PINGS)
    assert as_ticks(engagement.engaged_ticks(frame)) == brute_ticks(rows)


@pytest.mark.parametrize("zone,tick", [(ZONE, 30), ("Europe/Madrid", 10)])
def test_engaged_sessions_add_up_the_ticks(spark, zone, tick):
    # Starts at 22:00 UTC and runs past local midnight in both zones' terms.
    rows = activity_rows(10, rows=900, spread=30_000, grid=True)
    frame = seed_rows(spark, rows, schemas.PINGS)
    listed = rollup.roll_up(engagement.engaged_ticks(frame, tick_seconds=tick), zone)
    summed = engagement.engaged_sessions(frame, zone, tick_seconds=tick)
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, summed.select(listed.columns).collect()))
    assert listed.select("session_date").distinct().count() > 1


def test_exactly_five_minutes_still_counts(spark):
    on_border = seed_rows(spark, [(1, "u", datetime(2024, 3, 9, 12, 0, 0, tzinfo=timezone.utc))], schemas.PINGS)
    assert engagement.engaged_ticks(on_border).count() == 10
    rows = [(1, "u", START), (1, "u", START + timedelta(seconds=300)), (1, "u", START + timedelta(seconds=601))]
    stays = engagement.idle_sessions(seed_rows(spark, rows, schemas.PINGS))
    assert sorted(row["activities"] for row in stays.collect()) == [1, 2]


def test_idle_limit_must_be_whole_ticks(spark):
    with pytest.raises(ValueError):
        engagement.engaged_ticks(seed_rows(spark, [], schemas.PINGS), 100, 30)


@pytest.mark.parametrize("seed,gap", [(4, 300), (5, 60)])
def test_idle_sessions_equal_brute_force(spark, seed, gap):
    rows = activity_rows(seed, grid=True)
    frame = seed_rows(spark, rows, schemas.PINGS)
    assert as_stays(engagement.idle_sessions(frame, gap)) == brute_stays(rows, gap)


def flushed(rows):
    """One far-off activity of another user pushes the watermark past all others."""
    return rows + [(99, "https://flush", START + timedelta(days=30))]


def test_stream_ticks_equal_batch(spark):
    rows = activity_rows(6, grid=True)
    folder = store_chunks(spark, seed_rows(spark, flushed(rows), schemas.PINGS).coalesce(1), 1, "act")
    streamed = drain(engagement.engaged_ticks_stream(read_ping_stream(spark, folder), lateness="1 hour"), "ticks")
    assert as_ticks(streamed.where("user_id <> 99")) == brute_ticks(rows)


def test_stream_idle_sessions_equal_batch(spark):
    rows = activity_rows(7, grid=True)
    folder = store_chunks(spark, seed_rows(spark, flushed(rows), schemas.PINGS), 1, "act")
    streamed = drain(engagement.idle_sessions_stream(read_ping_stream(spark, folder), lateness="1 hour"), "idle")
    assert as_stays(streamed.where("user_id <> 99")) == brute_stays(rows, 300)


PINGS = [
    (1, "u", datetime(2024, 3, 10, 2, 59, 59, tzinfo=timezone.utc)),
    (1, "u", datetime(2024, 3, 10, 3, 0, 0, tzinfo=timezone.utc)),
    (1, "u", datetime(2024, 3, 10, 3, 0, 0, tzinfo=timezone.utc)),
    (1, "v", datetime(2024, 3, 10, 4, 0, 0, tzinfo=timezone.utc)),
    (2, "u", datetime(2024, 3, 11, 2, 0, 0, tzinfo=timezone.utc)),
    (1, "LOGIN_PORTAL", datetime(2024, 3, 10, 5, 0, 0, tzinfo=timezone.utc)),
    (1, "LOGIN_PORTAL", datetime(2024, 3, 10, 6, 0, 0, tzinfo=timezone.utc)),
    (None, "u", datetime(2024, 3, 10, 5, 0, 0, tzinfo=timezone.utc)),
    (1, "", datetime(2024, 3, 10, 5, 0, 0, tzinfo=timezone.utc)),
    (1, None, datetime(2024, 3, 10, 5, 0, 0, tzinfo=timezone.utc)),
]


def lengths(frame):
    return {(r["user_id"], r["dashboard_url"], r["session_date"]): r["duration_minutes"] for r in frame.collect()}


EXPECTED = {
    (1, "u", date(2024, 3, 9)): 1,
    (1, "u", date(2024, 3, 10)): 2,
    (1, "v", date(2024, 3, 10)): 1,
    (2, "u", date(2024, 3, 10)): 1,
    (1, "LOGIN_PORTAL", date(2024, 3, 10)): 1,
}


def test_rollup_cuts_at_local_midnight_and_marks_logins_once(spark):
    pings = accepted_pings(seed_rows(spark, PINGS, schemas.PINGS))
    assert lengths(rollup.roll_up(pings, ZONE)) == EXPECTED
    assert lengths(rollup.dashboard_sessions(seed_rows(spark, PINGS, schemas.PINGS), ZONE)) == {
        key: value for key, value in EXPECTED.items() if key[1] != "LOGIN_PORTAL"
    }


def test_local_day_is_independent_of_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        pings = accepted_pings(seed_rows(spark, PINGS, schemas.PINGS))
        zoneless = pings.withColumn("ts", F.convert_timezone(None, F.lit("UTC"), "ts"))
        assert lengths(rollup.roll_up(pings, ZONE)) == EXPECTED
        assert lengths(rollup.roll_up(zoneless, ZONE)) == EXPECTED
        instants = event_time(zoneless).select(F.unix_micros("ts")).collect()
        assert sorted(instants) == sorted(pings.select(F.unix_micros("ts")).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("zone", [ZONE, "Europe/Madrid"])
def test_partial_sessions_equal_batch_in_any_chunking(spark, zone):
    pings = accepted_pings(seed_rows(spark, PINGS + activity_rows(8), schemas.PINGS))
    folder = store_chunks(spark, pings, 5, "pings")
    stream = spark.readStream.schema(schemas.PINGS).option("maxFilesPerTrigger", 1).json(folder)
    assert lengths(drain_partials(stream, "partials", zone)) == lengths(rollup.roll_up(pings, zone))


def test_partial_sessions_are_pruned_by_day(spark):
    pings = accepted_pings(seed_rows(spark, PINGS, schemas.PINGS))
    folder = store_chunks(spark, pings, 2, "pings")
    out = run_dir(spark, "days")
    finish(rollup.write_partials(read_ping_stream(spark, folder), f"{out}/out", ZONE), out)
    day = date(2024, 3, 9)
    found = rollup.read_partials(spark, f"{out}/out", [(day, day)])
    assert lengths(found) == {key: value for key, value in EXPECTED.items() if key[2] == day}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session_date" in plan


def test_repeated_batch_counts_once(spark):
    pings = accepted_pings(seed_rows(spark, PINGS, schemas.PINGS))
    stream = read_ping_stream(spark, store_chunks(spark, pings, 2, "pings"))
    out = run_dir(spark, "twice")
    finish(rollup.write_partials(stream, f"{out}/out", ZONE), f"{out}/log")
    # Without its commit the batch is run again from the same progress log.
    commits = [name for name in os.listdir(f"{out}/log/state/commits") if name.strip(".crc").isdigit() or name.endswith(".crc")]
    for name in commits:
        os.remove(f"{out}/log/state/commits/{name}")
    finish(rollup.write_partials(stream, f"{out}/out", ZONE), f"{out}/log")
    assert lengths(rollup.read_partials(spark, f"{out}/out")) == EXPECTED


def test_fresh_progress_log_keeps_earlier_parts(spark):
    out = run_dir(spark, "fresh")
    for number in (1, 2):
        ping = seed_rows(spark, [(number, "u", START)], schemas.PINGS)
        stream = read_ping_stream(spark, store_chunks(spark, ping, 1, "pings"))
        finish(rollup.write_partials(stream, f"{out}/out", ZONE), f"{out}/log{number}")
    assert sorted(row["user_id"] for row in rollup.read_partials(spark, f"{out}/out").collect()) == [1, 2]


def test_parts_before_the_first_batch_are_empty(spark):
    assert rollup.read_partials(spark, run_dir(spark, "none")).count() == 0


def test_bad_pings_are_refused_on_every_path(spark):
    bad = [(1, None, START), (1, "", START), (None, "u", START), (2, "u", START)]
    pings = seed_rows(spark, bad, schemas.PINGS)
    stream = read_ping_stream(spark, store_chunks(spark, pings, 1, "pings"))
    assert [row["user_id"] for row in drain_partials(stream, "bad", ZONE).collect()] == [2]
    assert [row["user_id"] for row in rollup.dashboard_sessions(pings).collect()] == [2]


@pytest.mark.parametrize("kind", ["ticks", "idle"])
def test_stored_cells_equal_batch_over_days_and_late_files(spark, kind):
    rows = activity_rows(6, grid=True)
    rows += [(user, url, at + timedelta(hours=23, minutes=58)) for user, url, at in rows]
    folder = store_chunks(spark, seed_rows(spark, rows, schemas.PINGS), 4, "act")
    stream = spark.readStream.schema(schemas.PINGS).option("maxFilesPerTrigger", 1).json(folder)
    if kind == "ticks":
        found = drain_parts(
            spark, "t", lambda path: engagement.write_ticks(stream, path), lambda path: engagement.read_ticks(spark, path)
        )
        assert as_ticks(found) == brute_ticks(rows)
    else:
        found = drain_parts(
            spark, "i", lambda path: engagement.write_idle_sessions(stream, path), lambda path: engagement.read_idle_sessions(spark, path)
        )
        assert as_stays(found) == brute_stays(rows, 300)


def test_closed_days_stream_and_late_ping(spark):
    pings = accepted_pings(seed_rows(spark, PINGS, schemas.PINGS))
    folder = run_dir(spark, "late")
    pings.coalesce(1).write.mode("append").json(folder)
    late_and_new = [
        (5, "u", datetime(2024, 3, 20, 12, 0, tzinfo=timezone.utc)),
        (1, "u", datetime(2024, 3, 10, 4, 0, tzinfo=timezone.utc)),
    ]
    state = run_dir(spark, "late-state")

    def run():
        closed = rollup.roll_up_stream(read_ping_stream(spark, folder), "1 hour", "Etc/GMT+3")
        finish(closed.writeStream.format("parquet").option("path", f"{state}/out"), state)
        return closed.schema

    run()
    seed_rows(spark, late_and_new[:1], schemas.PINGS).coalesce(1).write.mode("append").json(folder)
    run()
    # The day closed long ago: a ping for it is dropped, not counted twice.
    seed_rows(spark, late_and_new[1:], schemas.PINGS).coalesce(1).write.mode("append").json(folder)
    schema = run()
    assert lengths(spark.read.schema(schema).parquet(f"{state}/out")) == EXPECTED


def test_shifting_zone_needs_partials(spark):
    with pytest.raises(ValueError):
        rollup.roll_up_stream(seed_rows(spark, PINGS, schemas.PINGS), "1 hour", "Europe/Madrid")


def test_merge_of_stored_and_new_sessions(spark):
    pings = accepted_pings(seed_rows(spark, PINGS, schemas.PINGS))
    first, second = pings.where("dashboard_url <> 'v'"), pings.where("dashboard_url = 'v'")
    parts = rollup.roll_up(first, ZONE).unionByName(rollup.roll_up(second, ZONE))
    assert lengths(rollup.merge_partials(parts)) == EXPECTED


def test_breaches_batch_and_stream(spark):
    rows = [(1, START + timedelta(seconds=n)) for n in range(20)] + [(2, START + timedelta(seconds=n)) for n in range(15)]
    log = seed_rows(spark, rows, schemas.ACCESS_LOG)
    found = ratewatch.rate_breaches(log, ratewatch.MAX_LOGINS).collect()
    assert [(row["key"], row["requests"], row["excess"]) for row in found] == [(1, 20, 5)]
    assert found[0]["window_end"] - found[0]["window_start"] == timedelta(minutes=15)
    folder = run_dir(spark, "access")
    log.unionByName(seed_rows(spark, [(3, START + timedelta(days=1))], schemas.ACCESS_LOG)).coalesce(1).write.json(folder)
    stream = read_ping_stream(spark, folder, schema=schemas.ACCESS_LOG)
    assert drain(ratewatch.rate_breaches(stream, ratewatch.MAX_LOGINS, lateness="1 hour"), "breach").collect() == found


def test_required_fields(spark):
    frame = seed_rows(spark, [("u", "", "user", None), (None, "n", None, "P"), ("u", "n", "user", None)], schemas.SEED_USERS)
    accepted, rejected = split_by_required(frame, ["username", "name", "role"])
    assert accepted.count() == 1
    assert sorted(row["missing_fields"] for row in rejected.collect()) == ["name", "username,role"]


@pytest.mark.parametrize("zone", [ZONE, "Europe/Madrid", "Asia/Kolkata"])
def test_local_day_equals_the_zone_database(spark, zone):
    dice = random.Random(9)
    # Around switches of daylight saving, before 1970, and to the microsecond.
    moments = [datetime(1969, 12, 31, 23, 59, 59, 500_000), datetime(2024, 3, 31, 0, 59, 59, 999_999)]
    moments += [datetime(2024, 3, 30, 22) + timedelta(minutes=13 * n) for n in range(300)]
    moments += [datetime(1995, 1, 1) + timedelta(seconds=dice.randrange(10**9)) for _ in range(300)]
    rows = [(n, "u", moment.replace(tzinfo=timezone.utc)) for n, moment in enumerate(moments)]
    frame = seed_rows(spark, rows, schemas.PINGS)
    zoneless = frame.withColumn("ts", F.convert_timezone(None, F.lit("UTC"), "ts"))
    expected = [row[2].astimezone(ZoneInfo(zone)).date() for row in rows]
    for form in (frame, zoneless):
        found = form.select("user_id", local_day(form, "ts", zone).alias("day")).orderBy("user_id").collect()
        assert [row["day"] for row in found] == expected
