"""Driver-side helpers for remote sources: retries, throttling and cached downloads; the rows themselves are read by Spark."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

R = TypeVar("R")


def delays(attempts: int, base: float = 0.5, factor: float = 2.0, most: float = 30.0) -> list[float]:
    """Waits between attempts: exponential, up to ``most``."""
    return [min(base * factor**i, most) for i in range(max(0, attempts - 1))]


def retried(call: Callable[[], R], attempts: int = 3, errors: tuple[type[Exception], ...] = (OSError,), sleep: Callable[[float], None] = time.sleep) -> R:
    """The call's result; the last failure is passed on."""
    for wait in delays(attempts):
        try:
            return call()
        except errors:
            sleep(wait)
    return call()


class Throttle:
    """Slots at least ``interval`` seconds apart; a caller reserves the next one and waits for it."""

    def __init__(self, interval: float, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.interval, self.now, self.sleep, self.next = interval, now, sleep, 0.0

    def wait(self) -> None:
        at = max(self.now(), self.next)
        self.next = at + self.interval
        if at > self.now():
            self.sleep(at - self.now())


def cached(fetch: Callable[[str | None], tuple[bytes | None, str | None]], target: Path) -> Path:
    """Keep what ``fetch(tag)`` gives at ``target``: it returns new bytes with their tag, or no bytes if the known tag still holds. An unreachable
    source leaves what is there; without that the failure is passed on."""
    mark = target.with_suffix(target.suffix + ".json")
    known = json.loads(mark.read_text()) if mark.exists() and target.exists() else {}
    try:
        body, tag = retried(lambda: fetch(known.get("tag")))
    except OSError:
        if known:
            return target
        raise
    if body is not None:
        part = target.with_suffix(target.suffix + ".part")
        part.write_bytes(body)
        part.replace(target)
        mark.write_text(json.dumps({"tag": tag, "sha256": hashlib.sha256(body).hexdigest(), "bytes": len(body)}))
    return target
