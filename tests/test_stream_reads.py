"""What the state of a URL costs."""

import pandas as pd

from lurelens.streaming.stateful import _NewestRun


class _State:
    def __init__(self, value=None):
        self.value, self.reads = value, 0

    def exists(self):
        self.reads += 1
        return self.value is not None

    def get(self):
        self.reads += 1
        return self.value

    def update(self, value):
        self.value = value


class _Handle:
    def __init__(self, state):
        self.state, self.timers = state, []

    def getValueState(self, name, schema):
        return self.state

    def registerTimer(self, at):
        self.timers.append(at)


def test_state_of_a_url_is_read_once(spark):
    columns = ["at", "request_id", "target_id", "usable", "classification"]
    job, state = _NewestRun(100), _State((10, "t1", True, "benign"))
    job.init(_Handle(state))
    rows = pd.DataFrame([
        (60, "r2", None, False, None), (50, None, "t3", True, "phishing"), (50, None, "t2", True, None), (50, "r1", None, False, None),
        (40, "r0", None, False, None), (150, "r3", None, False, None), (5, "r9", None, False, None)], columns=columns)
    (answers,) = job.handleInputRows(("u",), iter([rows.iloc[:3], rows.iloc[3:]]), None)
    got = {r.request_id: (r.cached_target, r.classification) for r in answers.itertuples()}
    assert got == {"r9": (None, None), "r0": ("t1", "benign"), "r1": ("t2", None), "r2": ("t2", None), "r3": (None, None)}
    assert state.value == (50, "t2", True, None) and state.reads == 1 and job.handle.timers == [1]
    assert not list(job.handleInputRows(("u",), iter([rows.iloc[1:2]]), None))
