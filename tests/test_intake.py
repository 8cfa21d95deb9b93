"""Every raw line is accepted once or refused once, with its reason, whatever is repeated."""

import json

import pytest
from pyspark.sql import functions as F
from test_feeds import ZONE

from boardpulse.session import run_dir
from boardpulse.streaming import intake
from boardpulse.streaming.parts import live_parts, take_in_all
from boardpulse.streaming.runner import finish

TIME = "2024-03-09T22:00:00Z"
LINES = [
    (json.dumps({"user_id": 1, "dashboard_url": "u", "ts": TIME}), None),
    (json.dumps({"user_id": 1, "dashboard_url": "u", "ts": TIME, "more": [1]}), None),
    (json.dumps({"user_id": 2, "dashboard_url": "LOGIN_PORTAL", "ts": TIME}), None),
    (json.dumps({"user_id": 2, "dashboard_url": "LOGIN_PORTAL", "ts": "2024-03-09T22:05:00Z"}), None),
    (json.dumps({"dashboard_url": "u", "ts": TIME}), "no user"),
    (json.dumps({"user_id": None, "ts": TIME}), "no user"),
    (json.dumps({"user_id": 1, "dashboard_url": "", "ts": TIME}), "no page"),
    (json.dumps({"user_id": 1, "ts": TIME}), "no page"),
    (json.dumps({"user_id": 1, "dashboard_url": "u"}), "no time"),
    (json.dumps({"user_id": "x", "dashboard_url": "u", "ts": TIME}), "malformed"),
    ('{"user_id": 1, "dashboard_url"', "malformed"),
    ("", "malformed"),
    ("[1]", "malformed"),
    ("null", "malformed"),
    (None, "malformed"),
]


def lines_of(spark, rows):
    return spark.createDataFrame([(line,) for line, _ in rows], "value string")


def letters(spark, path):
    return sorted((row["line"] or "", row["reason"]) for row in intake.read_refused(spark, path).collect())


def expected_letters(rows):
    return sorted((line or "", reason) for line, reason in rows if reason)


def accepted(spark, path):
    return {(r["user_id"], r["dashboard_url"]): (r["duration_minutes"], r["pings"]) for r in intake.read_accepted(spark, path).collect()}


def take(spark, path, rows, writer="w", batch=0):
    return take_in_all(spark, path, intake._outputs(lines_of(spark, rows), ZONE), writer, batch)


def test_each_line_has_one_outcome(spark):
    judged = {row["line"]: row["reason"] for row in intake.judge(lines_of(spark, LINES)).collect()}
    assert judged == dict(LINES)


def test_accepted_and_refused_are_all_lines(spark):
    path = run_dir(spark, "intake")
    assert take(spark, path, LINES)
    assert not take(spark, path, LINES)
    assert accepted(spark, path) == {(1, "u"): (2, 2), (2, "LOGIN_PORTAL"): (1, 2)}
    assert letters(spark, path) == expected_letters(LINES)
    take(spark, path, LINES[:5], batch=1)
    intake.compact_intake(spark, path)
    assert accepted(spark, path) == {(1, "u"): (4, 4), (2, "LOGIN_PORTAL"): (1, 4)}
    assert sum(p for _, p in accepted(spark, path).values()) + len(letters(spark, path)) == len(LINES) + 5


def test_stream_repeats_a_batch_after_a_crash(spark, monkeypatch):
    folder, out = run_dir(spark, "lines"), run_dir(spark, "crashing")
    lines_of(spark, LINES[:-1]).repartition(3).write.text(folder)
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(folder)
    real, calls = intake.take_in_all, []

    def dies(*arguments):
        calls.append(real(*arguments))
        if len(calls) == 2:  # entered, but the stream never hears of it
            raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(intake, "take_in_all", dies)
        with pytest.raises(Exception, match="lost"):
            finish(intake.write_intake(stream, f"{out}/out", ZONE), out)
    finish(intake.write_intake(stream, f"{out}/out", ZONE), out)
    assert accepted(spark, f"{out}/out") == {(1, "u"): (2, 2), (2, "LOGIN_PORTAL"): (1, 2)}
    assert letters(spark, f"{out}/out") == expected_letters(LINES[:-1])


def test_replay_takes_each_letter_in_once(spark):
    path = run_dir(spark, "replay")
    take(spark, path, LINES)

    def mend(letters):
        return letters.withColumn("line", F.when(F.col("reason") == "no page", F.lit(LINES[0][0])).otherwise(F.col("line")))

    assert intake.replay_refused(spark, path, mend, "first", ZONE)
    assert accepted(spark, path)[(1, "u")] == (4, 4)
    left = [row for row in LINES if row[1] != "no page"]
    assert letters(spark, path) == expected_letters(left)
    # Again under the same name: nothing. Under another: only what is still refused.
    assert not intake.replay_refused(spark, path, mend, "first", ZONE)
    assert intake.replay_refused(spark, path, mend, "second", ZONE)
    assert accepted(spark, path)[(1, "u")] == (4, 4)
    assert letters(spark, path) == expected_letters(left)


def test_two_replays_at_once(spark, monkeypatch):
    path = run_dir(spark, "both")
    take(spark, path, LINES)
    real = intake.take_in_all

    def overtaken(*arguments):
        monkeypatch.setattr(intake, "take_in_all", real)
        assert intake.replay_refused(spark, path, lambda letters: letters, "fast", ZONE)
        return real(*arguments)

    monkeypatch.setattr(intake, "take_in_all", overtaken)
    assert not intake.replay_refused(spark, path, lambda letters: letters, "slow", ZONE)
    assert letters(spark, path) == expected_letters(LINES)


def test_nothing_to_replay_and_empty_batches(spark):
    path = run_dir(spark, "empty")
    assert not intake.replay_refused(spark, path, lambda letters: letters, "x", ZONE)
    assert take(spark, path, [])
    assert accepted(spark, path) == {} and letters(spark, path) == []
    assert live_parts(spark, path) == []
