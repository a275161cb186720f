"""Fetching payloads: retries and other addresses. Pages and payloads are read by ``connector``.

``get`` is any function from an address to (status, headers, body).
"""

from __future__ import annotations

import time
from collections.abc import Callable

#: Seconds of the first and the longest wait, and sends after the first (fixed values).
FIRST_WAIT, LONGEST_WAIT, RETRIES = 0.5, 60.0, 6


class FetchError(RuntimeError):
    pass


def worth_retrying(status: int) -> bool:
    return status == 429 or (500 <= status < 600 and status != 501)


def with_retries(get: Callable, url: str, sleep: Callable[[float], None] = time.sleep):
    """The first good answer; busy and failing servers and broken connections are asked again, ever later."""
    wait, last = FIRST_WAIT, "no answer"
    for attempt in range(RETRIES + 1):
        pause = wait
        try:
            status, headers, body = get(url)
            if status < 400:
                return body
            last = f"status {status} {body[:200].decode('utf-8', 'replace') if isinstance(body, bytes) else ''}".strip()
            if not worth_retrying(status):
                break
            if status == 429 and str(headers.get("Retry-After", "")).isdigit():
                pause = float(headers["Retry-After"])
        except OSError as e:
            last = str(e)
        if attempt < RETRIES:
            sleep(min(pause, LONGEST_WAIT))
            wait = min(2 * wait, LONGEST_WAIT)
    raise FetchError(f"{url}: {last}")


def first_that_answers(fetch: Callable[[str], object], urls: list[str]):
    """The first success of several addresses, else the last error."""
    error: Exception = FetchError("no address")
    for url in urls:
        try:
            return fetch(url)
        except (FetchError, OSError, ValueError) as e:
            error = e
    raise error


def answer(url: str, headers: dict[str, str], timeout: float = 30.0) -> tuple[int, dict[str, str], bytes]:
    """One request over the network."""
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()
