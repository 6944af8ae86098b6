"""The state store is called per group of rows of a run, not per row."""

from __future__ import annotations

from types import SimpleNamespace

from spoor.streaming.depth import DepthInOrder


class Store:
    """States of one key in memory; counts the calls."""

    def __init__(self):
        self.calls = 0

    def state(self, *_):
        store, held = self, []

        class State:
            def __getattr__(self, name):
                store.calls += 1
                return {
                    "exists": lambda: bool(held), "clear": held.clear, "update": lambda v: held.__setitem__(slice(None), [v]),
                    "appendList": held.extend, "put": lambda v: held.__setitem__(slice(None), v),
                    "get": lambda: iter(list(held)) if self.many else held[0],
                }[name]

        s = State()
        s.many = False
        return s

    def many(self, *_):
        s = self.state()
        s.many = True
        return s

    getValueState, getListState = state, many
    getMapState = None

    def registerTimer(self, at):
        self.at = at

    def deleteTimer(self, at):
        pass


def fold(n):
    store, p = Store(), DepthInOrder()
    p.init(store)
    mark = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    rows = [SimpleNamespace(timestamp_ns=(n - i) * 1_000_000, event_id=str(i), step=1 if i % 3 else -1) for i in range(n)]
    assert not list(p.handleInputRows(("a", "b"), iter([*rows, rows[0]]), mark(0)))  # one step comes twice
    (half,) = p.handleExpiredTimer(("a", "b"), mark(n // 2), None)
    assert half.steps == n // 2 and store.at == n // 2 + 1
    (end,) = p.handleExpiredTimer(("a", "b"), mark(n), None)
    depth = top = 0
    for r in reversed(rows):
        depth = max(0, depth + r.step)
        top = max(top, depth)
    assert (end.depth, end.max_depth, end.steps) == (depth, top, n)
    return store.calls


def test_calls_do_not_grow_with_rows():
    assert fold(1000) == fold(10)
