"""Keyed state: how often it calls the store, and that rows which are not due stay."""

from types import SimpleNamespace

from marginalia.streaming.streams import ChangeState


class Store:
    """One state of any kind in memory; counts its calls."""

    def __init__(self):
        self.items, self.calls = {}, 0

    def __getattr__(self, name):
        self.calls += 1
        return getattr(self, f"_{name}")

    def _exists(self):
        return bool(self.items)

    def _get(self):
        return self.items.get("one") or iter(self.items.get("list", []))

    def _update(self, value):
        self.items["one"] = value

    def _clear(self):
        self.items.clear()

    def _appendList(self, rows):
        self.items.setdefault("list", []).extend(rows)

    def _put(self, rows):
        self.items["list"] = list(rows)

    def _containsKey(self, key):
        return key in self.items

    def _getValue(self, key):
        return self.items[key]

    def _updateValue(self, key, value):
        self.items[key] = value

    def _removeKey(self, key):
        del self.items[key]

    def _keys(self):
        return list(self.items)


def test_a_source_calls_the_store_a_few_times_for_many_rows():
    made, timers = [], []
    state = lambda *_: made.append(Store()) or made[-1]
    judge = ChangeState()
    judge.init(SimpleNamespace(getValueState=state, getMapState=state, getListState=state, registerTimer=timers.append, deleteTimer=timers.remove))
    rows = [SimpleNamespace(us=1_000_000 * (k * 7 % 1000), id=k, value="abc"[k * 7 % 1000 % 3]) for k in range(1000)]
    assert list(judge.handleInputRows((1,), iter(rows), None)) == []
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    got = [r for ms in (600_000, 10_000_000) for r in judge.handleExpiredTimer((1,), at(ms), None)]
    assert [r.id for r in got] == [r.id for r in sorted(rows, key=lambda r: r.us)]
    assert [r.outcome for r in got] == ["baseline", "changed", "changed"] + ["flip_flop"] * 997
    assert timers == [1, 600_001] and sum(s.calls for s in made) < 50
