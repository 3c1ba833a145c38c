"""The bypass state asks for one timer, not one for each event."""

from types import SimpleNamespace

from hunkledger.streaming.bypass import OneToken


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Waiting(dict):
    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__

    def iterator(self):
        return iter(list(self.items()))


def test_one_timer_until_the_next_event_is_due():
    state, timers, waiting = OneToken(), [], Waiting()
    state.init(SimpleNamespace(
        getValueState=lambda *a: Value(), getMapState=lambda *a: waiting, registerTimer=timers.append
    ))
    event = lambda at, side, **more: {"at": at, "side": side, "scan_id": None, "expires": None, "id": None, "reason": None, **more}
    rows = [event(9_000, 1, scan_id=3), event(2_500, 1, scan_id=1), event(1_000, 0, expires=90_000, id="t", reason="r"), event(7_000, 0, expires=8_000, id="u", reason="r")]
    assert list(state.handleInputRows(("repo",), iter(rows), None)) == [] and timers == [1]
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    found = list(state.handleExpiredTimer(("repo",), at(5), None))
    assert [(r.scan_id, r.token_id) for r in found] == [(1, "t")] and timers == [1, 7]
    assert list(state.handleExpiredTimer(("repo",), at(20), None)) == [] and not waiting and timers == [1, 7]
