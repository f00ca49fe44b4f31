"""Bounded concurrency for calls that only the driver can make."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

# Results that may wait for an earlier one, per thread.
_AHEAD = 16


def on_pool(call: Callable, items: Iterable, threads: int) -> Iterator:
    """Results of the calls in input order. Items are drawn as threads become free, so an
    endless input needs bounded memory."""
    waiting: deque = deque()
    with ThreadPoolExecutor(threads) as pool:
        for item in items:
            waiting.append(pool.submit(call, item))
            if len(waiting) >= threads * _AHEAD:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()
