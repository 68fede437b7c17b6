"""Calls to a labelling service: a bounded window per task, repeated calls with growing waits, answers in order.

A service answers one prompt at a time, slowly, and now and then not at all. A
task keeps a fixed number of calls in flight, goes on to the next chunk of
prompts while the slow ones of this chunk are out, and gives answers back in
the order in which the prompts arrived.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from echoframe.operators.inference import EXHAUSTED, OK, REFUSED, Provider

Outcome = tuple[str | None, str]


class Busy(Exception):  # noqa: N818
    """The service has no answer now; ``wait`` are the seconds it asks for, if it does."""

    def __init__(self, wait: float | None = None) -> None:
        super().__init__(wait)
        self.wait = wait


class Declined(Exception):  # noqa: N818
    """The service will not answer this prompt."""


@dataclass(frozen=True)
class Patience:
    """How often a prompt is tried, and the wait after a try: doubling, or what the service asked for."""

    tries: int = 10
    first_wait: float = 1.0
    longest_wait: float = 120.0

    def wait(self, tried: int, asked: float | None) -> float:
        return min(self.longest_wait, self.first_wait * 2 ** (tried - 1) if asked is None else max(0.0, asked))


class CallProvider(Provider):
    """A provider by single calls. Subclasses say how one prompt is answered.

    ``call`` returns the answer, raises ``Busy`` to be tried again or ``Declined``.
    No answer, or one without a visible character, counts as declined. Any
    other exception is a fault of the client and fails the task. ``call`` runs
    in ``in_flight`` threads at most.
    """

    in_flight: int = 32
    patience: Patience = Patience()
    sleep: Callable[[float], None] = staticmethod(time.sleep)
    #: Chunks of prompts that are out at once: the slow calls of one do not hold up the next.
    ahead: int = 2

    def call(self, prompt: str) -> str | None:
        raise NotImplementedError

    def settle(self, prompt: str) -> Outcome:
        """Try a prompt until it has an outcome. The waits keep its place in the window: a busy service gets no more calls."""
        for tried in range(1, self.patience.tries + 1):
            try:
                answer = self.call(prompt)
            except Busy as busy:
                if tried < self.patience.tries:
                    self.sleep(self.patience.wait(tried, busy.wait))
                continue
            except Declined:
                return None, REFUSED
            return (answer, OK) if answer and answer.strip() else (None, REFUSED)
        return None, EXHAUSTED

    def stream(self, chunks: Iterable[Sequence[str]]) -> Iterator[list[Outcome]]:
        out: deque[list[Future[Outcome]]] = deque()
        pool = ThreadPoolExecutor(self.in_flight)
        try:
            for prompts in chunks:
                out.append([pool.submit(self.settle, p) for p in prompts])
                if len(out) >= self.ahead:
                    yield [f.result() for f in out.popleft()]
            while out:
                yield [f.result() for f in out.popleft()]
        finally:  # also when a call failed or nobody asks on: what has not begun is not called
            pool.shutdown(wait=True, cancel_futures=True)

    def outcomes(self, prompts: Sequence[str]) -> list[Outcome]:
        return next(self.stream([prompts]))

    def complete(self, prompts: Sequence[str]) -> list[str | None]:
        return [answer for answer, _ in self.outcomes(prompts)]
