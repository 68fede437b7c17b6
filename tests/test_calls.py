"""Bounded calls: window, retries, waits, order and outcomes."""

import sys
import threading
import time

import pytest
from pyspark import cloudpickle

from echoframe.operators import inference as I
from echoframe.operators.calls import Busy, CallProvider, Declined, Patience

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # test classes travel with the task


class Scripted(CallProvider):
    """``prompt`` is a comma-separated script: ``busy``, ``busy:seconds``, ``no``, ``slow`` or an answer."""

    in_flight, patience = 4, Patience(tries=3, first_wait=1.0, longest_wait=5.0)

    def __init__(self):
        self.at, self.waits, self.now, self.most, self.lock = {}, [], 0, 0, threading.Lock()
        self.sleep = self.waits.append

    def call(self, prompt):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
        try:
            steps = prompt.split(",")
            step = steps[min(self.at.get(prompt, 0), len(steps) - 1)]
            self.at[prompt] = self.at.get(prompt, 0) + 1
            if step.startswith("busy"):
                raise Busy(float(step[5:]) if ":" in step else None)
            if step == "no":
                raise Declined
            if step == "fault":
                raise KeyError("bug in the client")
            time.sleep(0.02 if step.startswith("slow") else 0.001)
            return step
        finally:
            with self.lock:
                self.now -= 1

    def __getstate__(self):
        return {}

    def __setstate__(self, state):
        self.__init__()


def test_outcomes_and_waits():
    p = Scripted()
    got = p.outcomes(["a", "busy,b", "busy,busy,c", "busy", "no", " ", "busy:4,d", "busy:99,e"])
    assert got == [("a", I.OK), ("b", I.OK), ("c", I.OK), (None, I.EXHAUSTED), (None, I.REFUSED), (None, I.REFUSED), ("d", I.OK), ("e", I.OK)]
    # doubling waits where no hint is given, none after the last try; hints up to the longest wait
    assert sorted(p.waits) == sorted([1.0] + [1.0, 2.0] + [1.0, 2.0] + [4.0] + [5.0])
    assert p.complete(["x", "no"]) == ["x", None]


def test_order_and_window():
    p = Scripted()
    chunks = [[f"slow{k}" if k % 3 == 0 else f"fast{k}" for k in range(c * 10, c * 10 + 10)] for c in range(6)]
    got = list(p.stream(iter(chunks)))
    assert [[a for a, _ in out] for out in got] == chunks
    assert 2 <= p.most <= 4


def test_the_next_chunk_begins_while_slow_calls_are_out():
    p, pulled, given = Scripted(), [], []

    def chunks():
        for k in range(4):
            pulled.append((k, len(given)))
            yield [f"slow{k}"]

    for out in p.stream(chunks()):
        given.append(out)
    assert pulled == [(0, 0), (1, 0), (2, 1), (3, 2)]


def test_a_fault_of_the_client_stops_the_task():
    with pytest.raises(KeyError):
        Scripted().outcomes(["a", "fault", "b"])
    assert list(Scripted().stream([])) == []
    assert Scripted().outcomes([]) == []


def test_through_a_table(spark):
    rows = [(k, None if k % 7 == 0 else "busy" if k % 5 == 0 else "no" if k % 11 == 0 else f"busy,answer {k}") for k in range(100)]
    frame = spark.createDataFrame(rows, "k long, prompt string").repartition(3)
    got = {r["k"]: (r["raw"], r["status"]) for r in I.complete(frame, QuickScripted(), chunk_rows=6).collect()}
    want = {k: (None, None) if p is None else (None, I.EXHAUSTED) if p == "busy" else (None, I.REFUSED) if p == "no" else (f"answer {k}", I.OK) for k, p in rows}
    assert got == want


class QuickScripted(Scripted):
    def __init__(self):
        super().__init__()
        self.sleep = lambda _: None
