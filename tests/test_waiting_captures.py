"""Captures that wait in a stream's state: bounded values and frames, and the right rows whatever the order."""

import random
from types import SimpleNamespace

from catascope.streaming.ingest import ChangedOnly


class Value:
    def __init__(self):
        self.v = None

    exists = lambda self: self.v is not None
    get = lambda self: self.v

    def update(self, v):
        self.v = v


class Map(dict):
    getValue, updateValue, removeKey, iterator = dict.get, dict.__setitem__, dict.__delitem__, lambda self: iter(self.items())


class Handle:
    def __init__(self):
        self.timers, self.largest = set(), 0
        self.getValueState = lambda *a: Value()
        self.getMapState = lambda *a: Map()
        self.registerTimer = self.timers.add


def changed(rows, last=()):
    out, before = [], last
    for r in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        if before == () or r[1] != before:
            out.append(r)
        before = r[1]
    return out


def test_waiting_captures_stay_in_pages():
    import pandas as pd

    rng = random.Random(5)
    rows = [(k * 1000, rng.choice(["a", "b", None]), str(k)) for k in range(1, 5001)]
    rng.shuffle(rows)
    own, handle = ChangedOnly(run_bytes=100_000, page_bytes=10_000), Handle()
    own.init(handle)
    frames = [pd.DataFrame({"micros": [r[0] for r in rows[i : i + 700]], "content_hash": pd.Series([r[1] for r in rows[i : i + 700]], dtype=object), "payload": [r[2] for r in rows[i : i + 700]]}) for i in range(0, len(rows), 700)]
    list(own.handleInputRows(("p", "d", "k", ""), iter(frames), None))
    assert len(own.runs) > 5 and max(len(v[0]) for v in own.pages.values()) < 10_000
    got = []
    for watermark in (2000, 5001):
        for at in sorted(t for t in handle.timers if t <= watermark):
            handle.timers.discard(at)
            for pdf in own.handleExpiredTimer(("p", "d", "k", ""), SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w), SimpleNamespace(getExpiryTimeInMs=lambda t=at: t)):
                assert len(pdf) <= 60
                got += zip(pdf["micros"].tolist(), pdf["content_hash"].tolist(), pdf["payload"].tolist())
        assert got == changed([r for r in rows if r[0] < watermark * 1000])
    assert not own.runs and not own.pages
    late = pd.DataFrame({"micros": [4000_000], "content_hash": ["late"], "payload": ["x"]})
    list(own.handleInputRows(("p", "d", "k", ""), iter([late]), None))
    assert not own.runs
