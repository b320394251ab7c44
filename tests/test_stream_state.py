"""What the stream of search calls writes into its state."""

import json
from types import SimpleNamespace

import pandas as pd

from stagesignal.streaming import decisions


class State(dict):
    """A map, list or value of the state that counts the characters it is given."""

    def __init__(self, told):
        super().__init__()
        self.told, self.rows = told, []

    def updateValue(self, key, value):
        self.told[0] += len(str(value))
        self[key] = value

    getValue, containsKey = dict.get, dict.__contains__

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(self.items())

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def get(self):
        return tuple(self.rows)

    def exists(self):
        return bool(self.rows)

    update = put


def test_waiting_records_are_written_once(monkeypatch):
    """Records of one text, then ends that claim some: what is written grows with the records, not with their square."""
    def written(n):
        told = [0]
        make = lambda *_: State(told)
        calls = decisions._SearchCalls(1000)
        calls.init(SimpleNamespace(getListState=make, getMapState=make, getValueState=make, registerTimer=lambda at: None))
        record = json.dumps({"query": "tea", "attempted": True, "status": "ok"})
        events = [(k, "search_record", None, None, None, record) for k in range(n)] + [(n, "tool_start", "c", "t", '["tea", "tea"]', None), (n + 1, "tool_end", "c", None, None, None)]
        rows = pd.DataFrame([(k, k, e, c, t, q, None, r) for k, e, c, t, q, r in events], columns=["ms", "ord", "event", "call_id", "topic_id", "queries", "output", "record"])
        list(calls.handleInputRows(("run",), iter([rows]), None))
        out = []
        for now in (n - 1, n + 1):
            out += [r for frame in calls.handleExpiredTimer(("run",), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), None) for r in frame.itertuples()]
        assert [r.status for r in out] == ["ok", "ok"] and len(calls.log) == n - 2
        return told[0]

    assert written(400) < 4.5 * written(100)
