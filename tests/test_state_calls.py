"""Every call of a state is a round trip: an ordered processor makes few of them for a key."""

import pandas as pd

from callbrook.streaming.calls import _Conversation


class Handle:
    """Counts what is asked of it."""

    def __init__(self):
        self.calls = 0
        self.timers = []

    def getValueState(self, *_):
        return Kept(self)

    getListState = getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class Kept:
    def __init__(self, handle):
        self.handle, self.value = handle, None

    def _asked(self):
        self.handle.calls += 1

    def exists(self):
        self._asked()
        return self.value is not None

    def get(self):
        self._asked()
        return self.value

    def update(self, value):
        self._asked()
        self.value = value

    put = update

    def appendList(self, rows):
        self._asked()
        self.value = [*(self.value or []), *rows]

    def clear(self):
        self._asked()
        self.value = None


class Mark:
    def getCurrentWatermarkInMs(self):
        return 10_000


def test_few_round_trips_and_no_empty_frames():
    handle, processor = Handle(), _Conversation(idle_ms=1000)
    processor.init(handle)
    rows = pd.DataFrame({"session_id": [1, 1], "seq": [1, 0], "to_state": ["NOWHERE", "GREETING"], "event_ms": [2000, 1000]})
    assert list(processor.handleInputRows((1,), iter([rows]), Mark())) == []
    assert handle.calls == 4 and handle.timers == [1000]
    out = pd.concat(processor.handleExpiredTimer((1,), Mark(), None))
    assert out["seq"].tolist() == [0, 1] and out["from_state"].iloc[0] == "GREETING"
    assert handle.calls <= 4 + 7
    assert processor.clock.value is None and processor.state.value is None and processor.waiting.value is None
