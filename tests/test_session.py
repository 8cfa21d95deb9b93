"""Folders of runs and the shared folder."""

import os

from boardpulse import session


def test_runs_are_removed_once_done(spark, monkeypatch):
    monkeypatch.setattr(session, "_runs", {})
    folder = session.run_dir(spark, "short")
    spark.range(3).write.parquet(folder)
    assert os.path.isdir(folder) and session.clear_runs(spark) == 1
    assert not os.path.exists(folder) and session.clear_runs(spark) == 0
