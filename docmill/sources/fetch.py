"""A polite fetch of single addresses into a landing folder; driver side and one at a time."""

from __future__ import annotations

import time
from collections.abc import Callable
from urllib.request import Request, urlopen

#: Fixed value: seconds between two requests at least.
PAUSE = 0.11


class PoliteClient:
    """Says who asks and waits between requests."""

    def __init__(self, user_agent: str, pause: float = PAUSE, opener: Callable = urlopen, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        if not {"<", ">"} <= set(user_agent):
            raise ValueError("the user agent must name an organisation and a contact in angle brackets")
        self.user_agent, self.pause, self.opener, self.clock, self.sleep = user_agent, pause, opener, clock, sleep
        self.due = float("-inf")

    def fetch(self, url: str, timeout: float = 30.0) -> bytes:
        if (wait := self.due - self.clock()) > 0:
            self.sleep(wait)
        with self.opener(Request(url, headers={"User-Agent": self.user_agent}), timeout=timeout) as answer:  # noqa: S310
            body = answer.read()
        self.due = self.clock() + self.pause
        return body


def reachable(url: str, filing: bool, user_agent: str, opener: Callable = urlopen, timeout: float = 20.0) -> bool:
    """Whether an address answers: HEAD, or for filings the first byte under our own name."""
    headers = {"User-Agent": user_agent, "Range": "bytes=0-0"} if filing else {}
    try:
        with opener(Request(url, headers=headers, method="GET" if filing else "HEAD"), timeout=timeout) as answer:  # noqa: S310
            return 200 <= answer.status < 400
    except OSError:
        return False
