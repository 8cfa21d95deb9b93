"""The commit log and the parts of streams: retries, crashes, compaction, what readers open."""

import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from test_feeds import EXPECTED, PINGS, ZONE, activity_rows, as_stays, as_ticks, brute_stays, brute_ticks, lengths

from boardpulse.session import run_dir
from boardpulse.sources import schemas
from boardpulse.sources.commitlog import KEPT_ENTRIES, CommitLog, Part
from boardpulse.sources.feeds import accepted_pings, seed_rows
from boardpulse.streaming import engagement, parts, ratewatch, rollup

KIND = rollup.partial_sessions()
DAY = date(2024, 3, 9)


def sessions_of(spark, rows):
    return rollup.roll_up(accepted_pings(seed_rows(spark, rows, schemas.PINGS)), ZONE)


def fill(spark, path, batches=5, writer="w"):
    """The pings dealt into batches of one writer."""
    for number in range(batches):
        parts.take_in(spark, path, KIND, sessions_of(spark, PINGS[number::batches]), writer, number)


def test_entries_are_numbered_and_old_ones_cleared(spark):
    log = CommitLog(spark, run_dir(spark, "log"))
    assert log.newest().number == 0
    for number in range(KEPT_ENTRIES + 5):
        log.commit(lambda entry: entry.with_parts((Part(f"p{entry.number}"),)))
    assert log.newest().number == KEPT_ENTRIES + 5
    assert len(log.newest().parts) == KEPT_ENTRIES + 5
    assert len(log._numbers()) == KEPT_ENTRIES


def test_a_taken_number_is_not_overwritten(spark):
    log = CommitLog(spark, run_dir(spark, "race"))
    seen = []

    def change(entry):
        if not seen:  # another writer commits between reading and placing
            CommitLog(spark, log.root).commit(lambda other: other.with_parts((Part("theirs"),)))
        seen.append(entry.number)
        return entry.with_parts((Part("ours"),))

    assert [part.path for part in log.commit(change).parts] == ["theirs", "ours"]
    assert seen == [0, 1]


def test_unchanged_entry_is_not_committed(spark):
    log = CommitLog(spark, run_dir(spark, "none"))
    assert log.commit(lambda entry: None).number == 0
    assert log._numbers() == []


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_parts_add_up_before_and_after_compaction(spark, batches):
    path = run_dir(spark, "parts")
    fill(spark, path, batches)
    assert lengths(rollup.read_partials(spark, path)) == EXPECTED
    rollup.compact_partials(spark, path, closed=date(2024, 12, 31))
    live = parts.live_parts(spark, path)
    assert len({part.low for part in live}) == len(live)
    assert lengths(rollup.read_partials(spark, path)) == EXPECTED
    assert rollup.compact_partials(spark, path, closed=date(2024, 12, 31)) == []


def test_only_full_levels_of_open_days_are_merged(spark):
    path = run_dir(spark, "levels")
    fill(spark, path, 6)
    before = {day: sum(part.low == day for part in parts.live_parts(spark, path)) for day in ("2024-03-09", "2024-03-10")}
    done = parts.compact_parts(spark, path, KIND, fanout=4)
    assert done == sorted(day for day, n in before.items() if n >= 4)
    assert {part.level for part in parts.live_parts(spark, path) if part.low in done} == {1}
    assert lengths(rollup.read_partials(spark, path)) == EXPECTED


def test_repeated_batch_is_refused_even_after_compaction(spark):
    path = run_dir(spark, "again")
    fill(spark, path, 3)
    rollup.compact_partials(spark, path, closed=date(2024, 12, 31))
    assert not parts.take_in(spark, path, KIND, sessions_of(spark, PINGS[2::3]), "w", 2)
    assert lengths(rollup.read_partials(spark, path)) == EXPECTED
    # The same batch number of another stream is another batch.
    assert parts.take_in(spark, path, KIND, sessions_of(spark, PINGS[:1]), "other", 2)
    assert lengths(rollup.read_partials(spark, path)) != EXPECTED


def test_crash_before_the_entry_leaves_readers_alone(spark, monkeypatch):
    path = run_dir(spark, "crash")
    fill(spark, path, 3)
    old = {part.path for part in parts.live_parts(spark, path)}

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(CommitLog, "commit", dies)
        with pytest.raises(KeyboardInterrupt):
            rollup.compact_partials(spark, path, closed=date(2024, 12, 31))
        with pytest.raises(KeyboardInterrupt):
            parts.take_in(spark, path, KIND, sessions_of(spark, PINGS), "x", 0)
    assert {part.path for part in parts.live_parts(spark, path)} == old
    assert lengths(rollup.read_partials(spark, path)) == EXPECTED
    # What the dead writers left goes; what counts stays.
    assert len(parts.vacuum_parts(spark, path)) == 2
    assert lengths(rollup.read_partials(spark, path)) == EXPECTED


def test_crash_after_the_entry_has_finished_the_work(spark, monkeypatch):
    path = run_dir(spark, "crash-after")
    fill(spark, path, 3)
    with monkeypatch.context() as patched:
        patched.setattr(CommitLog, "_clear", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            rollup.compact_partials(spark, path, closed=date(2024, 12, 31))
    assert {part.level for part in parts.live_parts(spark, path)} <= {0, 1}
    assert lengths(rollup.read_partials(spark, path)) == EXPECTED
    # Retired parts are still there for readers of the entry before.
    assert parts.vacuum_parts(spark, path)
    assert lengths(rollup.read_partials(spark, path)) == EXPECTED


def test_slower_compaction_gives_way(spark, monkeypatch):
    path = run_dir(spark, "two")
    fill(spark, path, 3)
    store = parts._store

    def overtaken(*arguments):
        made = store(*arguments)
        monkeypatch.setattr(parts, "_store", store)
        assert rollup.compact_partials(spark, path, closed=date(2024, 12, 31))
        return made

    monkeypatch.setattr(parts, "_store", overtaken)
    assert rollup.compact_partials(spark, path, closed=date(2024, 12, 31)) == []
    assert lengths(rollup.read_partials(spark, path)) == EXPECTED


def test_late_ping_is_a_new_part_and_is_merged_later(spark):
    path = run_dir(spark, "late")
    fill(spark, path, 2)
    rollup.compact_partials(spark, path, closed=DAY)
    late = [(1, "u", datetime(2024, 3, 9, 23, 0, tzinfo=timezone.utc))]
    parts.take_in(spark, path, KIND, sessions_of(spark, late), "late", 0)
    expected = lengths(sessions_of(spark, PINGS + late))
    assert lengths(rollup.read_partials(spark, path)) == expected
    assert "2024-03-09" in rollup.compact_partials(spark, path, closed=DAY)
    assert [part.low for part in parts.live_parts(spark, path)].count("2024-03-09") == 1
    assert lengths(rollup.read_partials(spark, path)) == expected


def test_only_files_of_the_days_are_opened(spark):
    path = run_dir(spark, "days")
    fill(spark, path, 4)
    rollup.compact_partials(spark, path, closed=date(2024, 12, 31))
    files = rollup.read_partials(spark, path, [(DAY, DAY)]).inputFiles()
    assert files and all("session_date=2024-03-09" in name for name in files)


def test_cells_and_counts_are_compacted_too(spark):
    rows = activity_rows(6, grid=True)
    rows += [(user, url, at + timedelta(hours=23, minutes=58)) for user, url, at in rows]
    ticks, gaps, counts = (run_dir(spark, name) for name in ("ticks", "gaps", "counts"))
    for number in range(3):
        batch = seed_rows(spark, rows[number::3], schemas.PINGS)
        parts.take_in(spark, ticks, engagement.TICK_CELLS, engagement.activity_cells(batch), "w", number)
        parts.take_in(spark, gaps, engagement.GAP_CELLS, engagement.gap_cells(batch), "w", number)
        requests = ratewatch.request_counts(batch.select(F.col("user_id").alias("key"), "ts"))
        parts.take_in(spark, counts, ratewatch.COUNTS, requests, "w", number)
    before = sorted(map(tuple, ratewatch.read_breaches(spark, counts, 3).collect()))
    far = date(2030, 1, 1)
    assert engagement.compact_ticks(spark, ticks, far) and engagement.compact_idle_sessions(spark, gaps, far)
    assert ratewatch.compact_counts(spark, counts, far)
    assert as_ticks(engagement.read_ticks(spark, ticks)) == brute_ticks(rows)
    assert as_stays(engagement.read_idle_sessions(spark, gaps)) == brute_stays(rows, 300)
    assert sorted(map(tuple, ratewatch.read_breaches(spark, counts, 3).collect())) == before
    # Some days: the same ticks as cut out of all, from the parts of these days and the one before.
    day = date(2024, 3, 10)
    some = engagement.read_ticks(spark, ticks, ranges=[(day, day)])
    every = engagement.read_ticks(spark, ticks).where(F.to_date("ts") == F.lit(day))
    assert as_ticks(some) == as_ticks(every)
    assert some.count() > 0


@pytest.mark.parametrize("gap", [60, 300, 6 * 3600, 3 * 86_400])
def test_sessions_of_an_endless_user(spark, gap):
    """One user over three years, sessions over many days and far before 1970 included."""
    dice = random.Random(gap)
    at, rows = datetime(1966, 1, 1, tzinfo=timezone.utc), []
    for _ in range(1500):
        at += timedelta(seconds=dice.choice([gap // 2, gap, gap + 1, 5 * gap, 86_400 * dice.choice([1, 40])]))
        rows.append((dice.choice([1, 1, 1, 2]), "u", at))
    found = as_stays(engagement.idle_sessions(seed_rows(spark, rows, schemas.PINGS), gap))
    assert found == brute_stays(rows, gap)


def test_no_window_holds_a_whole_user(spark):
    rows = [(1, "u", datetime(2020, 1, 1, tzinfo=timezone.utc) + timedelta(hours=n)) for n in range(24 * 200)]
    cells = engagement.gap_cells(seed_rows(spark, rows, schemas.PINGS), 300)
    plan = engagement._stays(cells, 300)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("span" in line for line in windows)
