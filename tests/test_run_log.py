from datetime import datetime, timedelta, timezone
from threading import Barrier, Thread

import pytest

from tablewright import ExperimentLogger


@pytest.fixture
def log(spark, tmp_path):
    return ExperimentLogger(str(tmp_path / "runs"), spark)


def values(log):
    return sorted((r["run_id"], r["artifact"], r["path"], r["value"]) for r in log.read().filter("artifact != 'manifest'").collect())


class Killed(Exception):
    pass


def killed(*_):
    raise Killed


def test_empty_log_has_no_rows(log):
    assert log.read().count() == 0 and log.run_ids() == [] and log.summary("effort").count() == 0
    assert log.artifact("none", "policy") is None


def test_a_run_whose_writer_died_is_not_seen_and_can_be_repeated(log, monkeypatch):
    log.append("first", {"a": {"x": 1}}, run_id="run-1")
    before = values(log)
    with monkeypatch.context() as m:
        m.setattr(log, "_commit", killed)
        with pytest.raises(Killed):
            log.append("second", {"a": {"x": 2}}, run_id="run-2")
    assert values(log) == before and log.artifact("run-2", "a") is None
    log.append("second", {"a": {"x": 2}}, run_id="run-2")
    assert values(log) == [*before, ("run-2", "a", "x", 2.0)]
    later = datetime.now(timezone.utc) + timedelta(minutes=1)
    assert log.drop_uncommitted(later - timedelta(days=1)) == 0
    assert log.drop_uncommitted(later) == 1 and log.drop_uncommitted(later) == 0
    assert values(log) == [*before, ("run-2", "a", "x", 2.0)]


def test_half_written_rows_are_never_read(log, tmp_path):
    log.append("whole", {"a": {"x": 1}}, run_id="whole")
    torn = tmp_path / "runs" / "rows" / "torn" / "20200101T000000000000Z-0"
    torn.mkdir(parents=True)
    (torn / "part-0.parquet").write_bytes(b"PAR1 and no more")
    assert values(log) == [("whole", "a", "x", 1.0)]


def test_a_repeated_run_id_writes_nothing(log, tmp_path):
    for x in (1, 2):
        assert log.append("again", {"a": {"x": x}}, run_id="again") == "again"
    assert values(log) == [("again", "a", "x", 1.0)]
    assert len(list((tmp_path / "runs" / "rows" / "again").iterdir())) == 1


def test_two_writers_of_one_run_at_once(log, monkeypatch):
    """Both find the run uncommitted and both commit; its rows are there once, and stay the same."""
    meet, look = Barrier(2, timeout=60), log._committed
    first_look = iter([True, True])

    def committed(spark):
        found = look(spark)
        if next(first_look, False):
            meet.wait()
        return found

    monkeypatch.setattr(log, "_committed", committed)
    writers = [Thread(target=log.append, args=("both", {"a": {"x": 5, "y": 6}}), kwargs={"run_id": "both"}) for _ in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert values(log) == [("both", "a", "x", 5.0), ("both", "a", "y", 6.0)]
    assert log.drop_uncommitted(datetime.now(timezone.utc) + timedelta(minutes=1)) == 1
    assert values(log) == [("both", "a", "x", 5.0), ("both", "a", "y", 6.0)]


def test_writers_of_many_runs_at_once(log):
    writers = [Thread(target=log.append, args=(f"run {i}", {"a": {"x": i}}), kwargs={"run_id": f"r{i}"}) for i in range(6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert values(log) == [(f"r{i}", "a", "x", float(i)) for i in range(6)] and log.run_ids() == [f"r{i}" for i in range(6)]
    assert log.read(only=["r2", "r4", "unknown"]).select("run_id").distinct().count() == 2


def test_run_ids_that_would_leave_the_folder_are_refused(log):
    for bad in ("../up", "a/b", "", "a@b", ".hidden", "ü"):
        with pytest.raises(ValueError):
            log.append("x", {"a": 1}, run_id=bad)
