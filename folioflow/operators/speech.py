"""Speech functions around a service: retries, and a stand-in voice."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np

#: Replies after which a call may be made again.
RETRY_STATUS = frozenset({408, 425, 429, 500, 502, 503, 504})


class ServiceError(Exception):
    """A reply with a status, or None where there was no reply."""

    def __init__(self, status: int | None, message: str = ""):
        super().__init__(message or f"status {status}")
        self.status = status


def may_pass(error: Exception) -> bool:
    """Whether a call that failed so may succeed later: timeouts, lost connections and the replies in RETRY_STATUS."""
    if isinstance(error, ServiceError):
        return error.status is None or error.status in RETRY_STATUS
    return isinstance(error, (TimeoutError, ConnectionError))


def retrying(call: Callable, tries: int = 3, delay: float = 2.0, retry: Callable[[Exception], bool] = may_pass, wait: Callable[[float], None] = time.sleep) -> Callable:
    """call, made up to tries times, with a pause of delay times the number of the try after each failure that retry allows.

    Around a speech function it repeats one segment's call; a task's own retry
    would repeat, and pay for, the whole partition.
    """
    if tries < 1:
        raise ValueError("tries must be at least 1")

    def patient(*args, **named):
        for k in range(1, tries + 1):
            try:
                return call(*args, **named)
            except Exception as error:
                if k == tries or not retry(error):
                    raise
                wait(delay * k)

    return patient


def tone(text: str, rate: int = 8000) -> np.ndarray:
    """A stand-in for speech: a tone whose length follows the text's and whose pitch follows its characters."""
    pitch = 200 + sum(map(ord, text)) % 400
    return 0.3 * np.sin(2 * np.pi * pitch * np.arange(len(text) * rate // 100) / rate)
