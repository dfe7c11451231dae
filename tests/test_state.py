"""Stateful streams that stop and start again: late rows, windows and expiries across micro-batches, values that are missing."""

import datetime

from lodestone.streaming import state

T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def test_rate_windows_survive_restarts(spark):
    schema = "bucket long, seq long, ts timestamp_ntz"
    first = [(1, 1, at(0)), (1, 2, at(10)), (1, 3, at(20)), (2, 4, at(5)), (None, 5, at(6)), (1, 6, at(70))]
    # Five minutes back is taken as it comes, into the window that then is open; an hour back is dropped.
    second = [(1, 7, at(65)), (1, 8, at(71)), (2, 9, at(66)), (1, 10, at(2)), (1, 11, at(200))]
    third = [(1, 12, at(201)), (1, 13, at(202)), (2, 14, at(203))]
    parts = [spark.createDataFrame(rows, schema) for rows in (first, second, third)]
    rows = state.run_in_steps(lambda s: state.limit_rate_stream(s, 2, 3600.0), parts, "test-rates").collect()
    assert {r.seq: r.allowed for r in rows} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: True, 8: False, 9: True, 11: True, 12: True, 13: False, 14: True}
    assert len(rows) == 13 and spark.conf.get(state.STORE, "").count("RocksDB") == 0


def test_observations_expire_with_event_time(spark):
    schema = "id string, content string, created_at timestamp_ntz, expires_at timestamp_ntz"
    first = [("a", "x", at(0), at(30)), ("b", None, at(1), None), ("c", "z", at(2), at(1)), ("d", "w", at(3), at(500)), ("e", "v", at(4), at(40))]
    second = [("e", "new", at(35), at(300)), ("f", "u", at(60), at(45)), ("g", "t", at(100), at(400))]
    parts = [spark.createDataFrame(rows, schema) for rows in (first, second, [])]
    rows = state.run_in_steps(state.expire_stream, parts, "test-expiry")
    got = {r.id: (r.scrubbed, r.content) for r in state.latest(rows, "id").collect()}
    # The watermark ends at minute 90; f came before it passed f's expiry.
    assert got == {"a": (True, None), "b": (False, None), "c": (True, None), "d": (False, "w"), "e": (False, "new"), "f": (True, None), "g": (False, "t")}
    assert {(r.id, r.scrubbed) for r in rows.where("id = 'a'").collect()} == {("a", False), ("a", True)}


def test_a_micro_batch_costs_a_step_a_group_not_a_key(spark, monkeypatch):
    monkeypatch.setattr(state, "GROUPS", 3)
    rows = [(k, 10 * k + j, at(j)) for k in range(40) for j in range(3)]
    made = state.run_in_steps(lambda s: state.limit_rate_stream(s, 2, 3600.0), [spark.createDataFrame(rows, "bucket long, seq long, ts timestamp_ntz")], "test-groups")
    assert {r.seq: r.allowed for r in made.collect()} == {seq: seq % 10 < 2 for _, seq, _ in rows}
    assert spark.range(200).select(state._group("id")).distinct().count() == 3
