"""The stateful operator of outcome maturity, event by event, with its timers."""

from __future__ import annotations

import random

import pandas as pd

from asofspark.streaming import feeds

HOUR = feeds.DAY // 24


class Map(dict):
    containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__
    removeKey = dict.pop

    def iterator(self):
        return iter(self.items())


class Handle:
    def __init__(self):
        self.maps, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Map())

    def registerTimer(self, ms):
        self.timers.add(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def play(batches, lateness):
    """(view -> first price told, handle) after micro-batches of (view or None, us, price, close), with timers in between."""
    handle, told, newest = Handle(), [], 0
    p = feeds.Maturing(2)
    p.init(handle)
    for batch in batches:
        rows = pd.DataFrame(batch, columns=["view", "us", "price", "close"])
        told += [r for df in p.handleInputRows(("=1",), iter([rows]), None) for r in df.itertuples(index=False)]
        newest = max([newest, *(us for _, us, _, _ in batch)])
        mark = (newest - lateness) // 1000
        for t in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(t)
            list(p.handleExpiredTimer(("=1",), Clock(mark), None))
    first = {}
    for r in told:
        if not pd.isna(r.priced):
            first[r.view] = min((r.priced, r.close), first.get(r.view, (feeds.NEVER, 0)))
    return first, handle


def test_any_order_gives_the_first_price_and_state_goes_with_the_watermark():
    r = random.Random(8)
    events = [(f"v{k}", r.randrange(240) * HOUR, 10.0, None) for k in range(30)] + [(None, r.randrange(240) * HOUR, None, float(r.randrange(1, 9))) for _ in range(60)]
    prices = sorted((us, close) for v, us, _, close in events if v is None)
    want = {v: min(p for p in prices if p[0] >= us + 2 * feeds.DAY) for v, us, _, _ in events if v and any(p[0] >= us + 2 * feeds.DAY for p in prices)}
    for seed in range(6):  # late by up to everything
        r.seed(seed)
        mixed = r.sample(events, len(events))
        assert play([mixed[k : k + 9] for k in range(0, 90, 9)], 300 * HOUR)[0] == want
    ordered = sorted(events, key=lambda e: e[1])
    first, handle = play([ordered[k : k + 5] for k in range(0, 90, 5)] + [[(None, 2_000 * HOUR, None, 1.0)], [(None, 2_001 * HOUR, None, 1.0)]], 0)
    assert {v: p for v, p in first.items() if v in want} == want
    assert not handle.maps["views"] and not handle.maps["prices"]  # a later view looks two days behind the newest price


def test_a_view_is_told_to_wait_once_and_equal_times_give_the_least_price():
    batch = [("a", 0, 10.0, None), ("a", 0, 10.0, None), (None, 2 * feeds.DAY, None, 5.0), (None, 2 * feeds.DAY, None, 4.0)]
    p, handle = feeds.Maturing(2), Handle()
    p.init(handle)
    rows = [tuple(x) for df in p.handleInputRows(("=1",), iter([pd.DataFrame(batch, columns=["view", "us", "price", "close"])]), None) for x in df.itertuples(index=False)]
    assert [(v, None if pd.isna(t) else t, None if pd.isna(c) else c) for v, _, t, c in rows] == [("a", None, None), ("a", 2 * feeds.DAY, 4.0)]
