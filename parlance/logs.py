"""Log decorators: how long a call took and what it gave, put together only where a level is asked for."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable

LOG = logging.getLogger("parlance")


class Deferred:
    """A message whose parts are made when it is written, which for a level that is off is never."""

    def __init__(self, message: str, *parts: Callable[[], object]) -> None:
        self.message, self.parts = message, parts

    def __str__(self) -> str:
        return self.message.format(*(p() for p in self.parts))


def timed(what: str, level: int = logging.INFO, log: logging.Logger = LOG) -> Callable:
    """Log how long each call takes."""

    def around(function: Callable) -> Callable:
        @functools.wraps(function)
        def call(*args, **kwargs):
            began = time.perf_counter()
            try:
                return function(*args, **kwargs)
            finally:
                log.log(level, Deferred("{} took {:.3f} s", lambda: what, lambda: time.perf_counter() - began))

        return call

    return around


def result_logged(what: str, level: int = logging.DEBUG, log: logging.Logger = LOG, shown: Callable[[object], object] = repr) -> Callable:
    """Log what each call gives."""

    def around(function: Callable) -> Callable:
        @functools.wraps(function)
        def call(*args, **kwargs):
            out = function(*args, **kwargs)
            log.log(level, Deferred("{}: {}", lambda: what, lambda: shown(out)))
            return out

        return call

    return around
