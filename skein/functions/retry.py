"""Calls again what failed, waiting longer each time."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

R = TypeVar("R")


def retry(call: Callable[[], R], retries: int = 3, delay: float = 1.0, backoff: float = 2.0, jitter: float = 0.0) -> R:
    """call()'s result, from up to retries + 1 attempts; the last error if all fail. jitter: share of a wait added at random."""
    for i in range(retries):
        try:
            return call()
        except Exception:
            time.sleep(delay * backoff**i * (1 + jitter * random.random()))
    return call()
