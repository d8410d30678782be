from datetime import datetime, timedelta

from solvlake.streaming import lifecycle

START = datetime(2024, 1, 1)


def hours(h):
    return START + timedelta(hours=h)


def test_states_survive_restarts_and_end_as_they_should(spark, tmp_path):
    events, out, mark = str(tmp_path / "events"), str(tmp_path / "out"), str(tmp_path / "mark")

    def record(*rows):
        lifecycle.record(spark.createDataFrame([("b", *r) for r in rows], lifecycle.EVENT).coalesce(1), events)
        lifecycle.follow(spark, events, out, mark)
        return {r.custom_id: (r.status, r.text, r.error) for r in lifecycle.standing(spark.read.schema(lifecycle.TRANSITION).parquet(out)).collect()}

    names = ("good", "bad", "late", "never", "polled", "twice")
    got = record(*[(n, "submitted", START, None) for n in names], ("early", "result", hours(1), "before"))
    assert got == {n: ("submitted", None, None) for n in names}
    got = record(("good", "result", hours(2), "text"), ("bad", "error", hours(2), "overloaded"), ("polled", "in_progress", hours(2), None), ("twice", "result", hours(2), "one"), ("early", "submitted", hours(2), None), ("good", "submitted", hours(2), None))
    assert got["good"] == ("ended", "text", None) and got["bad"] == ("errored", None, "overloaded")
    assert got["polled"] == ("in_progress", None, None) and got["early"] == ("ended", "before", None)
    assert got["late"] == got["never"] == ("submitted", None, None)
    got = record(("clock", "in_progress", hours(60), None), ("twice", "result", hours(60), "two"), ("polled", "canceling", hours(60), None))
    got = record(("late", "result", hours(61), "at last"), ("good", "error", hours(61), "no"), ("polled", "in_progress", hours(61), None))
    assert got["good"] == ("ended", "text", None) and got["twice"] == ("ended", "one", None)
    assert got["late"] == ("ended_late", "at last", None)
    got = record(("clock", "in_progress", hours(100), None), (None, "result", hours(61), "lost"), ("good", "unknown kind", hours(61), None))
    got = record(("clock", "in_progress", hours(101), None))
    assert got["never"] == ("timed_out", None, lifecycle.NO_RESULT) and got["polled"][0] == "timed_out"
    assert set(got) == {*names, "early"}
    steps = spark.read.schema(lifecycle.TRANSITION).parquet(out)
    assert [r.status for r in steps.filter("custom_id = 'late'").orderBy("n").collect()] == ["submitted", "timed_out", "ended_late"]
    assert steps.groupBy("custom_id", "n").count().filter("count > 1").count() == 0
    over = {r.custom_id: (r.raw_text, r.error) for r in lifecycle.responses(steps).collect()}
    assert over["good"] == ("text", None) and over["never"] == (None, lifecycle.NO_RESULT) and len(over) == 7


def test_requests_share_groups_of_states(spark, tmp_path, monkeypatch):
    """Many requests with few calls and rows of state: in one group, each moves and times out by itself."""
    monkeypatch.setattr(lifecycle, "GROUPS", 2)
    events, out, mark = (str(tmp_path / n) for n in ("events", "out", "mark"))
    followed = []
    for told in (
        [(f"r{i}", "submitted", START + timedelta(minutes=i), None) for i in range(300)],
        [(f"r{i}", "result", hours(6), f"text {i}") for i in range(0, 300, 3)] + [("r0", "result", hours(6), "text 0"), ("clock", "in_progress", hours(26.2), None)],
        [(f"r{i}", "result", hours(27), f"text {i}") for i in range(1, 300, 3)] + [("clock", "in_progress", hours(60), None)],
    ):
        lifecycle.record(spark.createDataFrame([("b", *r) for r in told], lifecycle.EVENT).coalesce(1), events)
        lifecycle.follow(spark, events, out, mark)
        followed.append({r.custom_id: (r.status, r.at, r.text) for r in lifecycle.standing(spark.read.schema(lifecycle.TRANSITION).parquet(out)).collect()})
    due = [START + timedelta(minutes=i) + lifecycle.DEADLINE for i in range(300)]
    assert {v[0] for v in followed[0].values()} == {"submitted"} and len(followed[0]) == 300
    passed = hours(26.2) - timedelta(minutes=10)
    assert all(followed[1][f"r{i}"][0] == ("ended" if i % 3 == 0 else "timed_out" if due[i] < passed else "submitted") for i in range(300) if due[i] != passed)
    late = {i: ("ended_late", hours(27), f"text {i}") if due[i] < hours(27) else ("ended", hours(27), f"text {i}") for i in range(1, 300, 3)}
    assert followed[2] == {f"r{i}": ("ended", hours(6), f"text {i}") if i % 3 == 0 else late[i] if i % 3 == 1 else ("timed_out", due[i], None) for i in range(300)}
    steps = spark.read.schema(lifecycle.TRANSITION).parquet(out)
    assert steps.groupBy("custom_id", "n").count().filter("count > 1").isEmpty()
    assert steps.groupBy("custom_id").agg({"n": "max", "*": "count"}).filter("`max(n)` <> `count(1)`").isEmpty()
