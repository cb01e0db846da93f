"""Polling a service until it is ready, with an injected clock."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

A = TypeVar("A")


def poll_until(ask: Callable[[], A], ready: Callable[[A], bool], timeout: float, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> tuple[str, int]:
    """("ready" or "timeout", number of questions asked). The first question is asked at once."""
    end, n = clock() + timeout, 0
    while True:
        n += 1
        if ready(ask()):
            return "ready", n
        if clock() + interval > end:
            return "timeout", n
        sleep(interval)
