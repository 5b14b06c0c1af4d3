"""Remote files: fetching with retries, and finding the first day that has data."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame


def asked_wait(told: str | None, now: float) -> float | None:
    """Seconds that a Retry-After header asks for, as a number or as a date; None if it asks for none."""
    told = (told or "").strip()
    if told.isdigit():
        return float(told)
    try:
        return max(0.0, parsedate_to_datetime(told).timestamp() - now)
    except (TypeError, ValueError):
        return None


def retrieve(url: str, attempts: int = 5, pause: float = 1.0, longest: float = 300.0, timeout: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body behind ``url``; busy and failing servers (429, 5xx) and broken connections are asked again.

    Before attempt k + 1 it waits pause * 2 ** k seconds, or what the server asks for, but never
    over ``longest``. Any other status, and the last failure, are raised.
    """
    for left in range(attempts - 1, -1, -1):
        wait = None
        try:
            with urllib.request.urlopen(url, timeout=timeout) as reply:
                return reply.read()
        except urllib.error.HTTPError as problem:
            passing = problem.code == 429 or problem.code >= 500
            if not (passing and left):
                raise
            wait = asked_wait(problem.headers.get("Retry-After"), time.time())
        except OSError:
            if not left:
                raise
        sleep(min(longest, pause * 2 ** (attempts - 1 - left) if wait is None else wait))
    raise ValueError("attempts must be positive")


def retrieve_all(urls: DataFrame, most_failures: int = 5, **how) -> DataFrame:  # noqa: ANN003
    """(url, body, error) of each row of (url). A task stops after so many failures one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for batch in batches:
            out = []
            for url in batch["url"]:
                try:
                    out.append((url, retrieve(url, **how), None))
                    failed = 0
                except OSError as e:
                    failed += 1
                    if failed >= most_failures:
                        raise RuntimeError(f"{failed} failures one after another, the last at {url}") from e
                    out.append((url, None, str(e)))
            yield pd.DataFrame(out, columns=["url", "body", "error"])

    return urls.select("url").mapInPandas(run, "url string, body binary, error string")


def first_day(has_data: Callable[[date], bool], low: date, high: date) -> date | None:
    """The first day from ``low`` to ``high`` with data, if from some day on all days have it; None if none has."""
    if not has_data(high):
        return None
    while low < high:
        middle = low + timedelta(days=(high - low).days // 2)
        if has_data(middle):
            high = middle
        else:
            low = middle + timedelta(days=1)
    return low
