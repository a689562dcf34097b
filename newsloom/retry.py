"""Retry, timing and logging on the driver and in readers."""

from __future__ import annotations

import functools
import logging
import logging.handlers
import time
from collections.abc import Callable
from pathlib import Path


def retry(attempts: int = 3, backoff: float = 2.0, exceptions: tuple = (Exception,), fatal: Callable[[Exception], bool] = lambda e: False, sleep: Callable[[float], None] = time.sleep):
    """PIP-13: call again after `backoff` ** n seconds, up to `attempts` calls; `fatal` errors end at once."""

    def wrap(f):
        @functools.wraps(f)
        def call(*args, **kwargs):
            for n in range(attempts):
                try:
                    return f(*args, **kwargs)
                except exceptions as e:
                    if n + 1 == attempts or fatal(e):
                        raise
                    sleep(backoff**n)
            return None

        return call

    return wrap


class Timer:
    """PIP-14: wall-clock milliseconds of a block."""

    def __enter__(self) -> Timer:
        self._start = time.perf_counter()
        self.elapsed_ms = 0.0
        return self

    def __exit__(self, *exc) -> None:
        self.elapsed_ms = (time.perf_counter() - self._start) * 1000


def configure_logging(folder: str | Path | None = None, level: str = "INFO", size: int = 10 << 20, keep: int = 5) -> logging.Logger:
    """PIP-16: the package's logger, to the console and to a rotating file."""
    log = logging.getLogger("newsloom")
    log.setLevel(level)
    log.handlers.clear()
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s")
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        handlers.append(logging.handlers.RotatingFileHandler(Path(folder, "newsloom.log"), maxBytes=size, backupCount=keep, encoding="utf-8"))
    for h in handlers:
        h.setFormatter(form)
        log.addHandler(h)
    return log
