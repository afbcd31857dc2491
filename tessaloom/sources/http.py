"""Pages of a JSON service as a Spark data source, and the requests of the known services.

    spark.dataSource.register(PagedJson)
    spark.read.format("paged_json").option("url", ...).option("payload", "{...}").load()

The driver reads the first page to learn the total; the other pages are dealt to partitions, each
read by one task, so a lost executor reads its own pages again. Rows are whole envelopes."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ATTEMPTS, INTERVAL, TIMEOUT, RETRIED = 3, 0.1, 30.0, (429, 500, 502, 503, 504)


class ServiceError(RuntimeError):
    """A service refused, couldn't be reached, or answered with something else than asked for."""


def waited(headers, attempt: int) -> float:
    """Seconds that Retry-After names (as a number or a date, a minute at most), else 2^attempt."""
    given = headers.get("Retry-After", "") if headers else ""
    try:
        seconds = float(given) if given.strip().isdigit() else (parsedate_to_datetime(given) - datetime.now(timezone.utc)).total_seconds()
    except (TypeError, ValueError):
        seconds = 2.0**attempt
    return min(60.0, max(0.0, seconds))


def fetch(url: str, body: bytes | None = None, headers: dict[str, str] | None = None, retried: tuple[int, ...] = RETRIED, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The answer; some statuses and errors of the network are tried again."""
    for attempt in range(ATTEMPTS):
        last = attempt == ATTEMPTS - 1
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers or {}), timeout=TIMEOUT) as answer:
                return answer.read()
        except urllib.error.HTTPError as refused:
            if refused.code not in retried or last:
                raise ServiceError(f"HTTP {refused.code} for {url}") from refused
            sleep(waited(refused.headers, attempt))
        except (urllib.error.URLError, TimeoutError, ConnectionError) as lost:
            if last:
                raise ServiceError(f"no answer from {url}: {lost}") from lost
            sleep(2.0**attempt)
    raise AssertionError("unreachable")


def envelope(answer: bytes, url: str, strict: bool = True) -> dict:
    """The answer as an object of code 0; strict: whose ``data.list`` is an array."""
    try:
        parsed = json.loads(answer)
    except ValueError as bad:
        raise ServiceError(f"no JSON from {url}") from bad
    if not isinstance(parsed, dict) or parsed.get("code", 0) != 0:
        raise ServiceError(f"refused by {url}: {str(parsed)[:200]}")
    data = parsed.get("data")
    if strict and not (isinstance(data, dict) and isinstance(data.get("list"), list)):
        raise ServiceError(f"no list from {url}")
    return parsed


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(None)
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url = options["url"]
        self.payload = json.loads(options.get("payload", "{}"))
        self.size, self.most, self.each = (int(options.get(k, v)) for k, v in (("size", "50"), ("max_pages", "100"), ("pages_per_task", "8")))
        self.headers = {k[len("header.") :]: v for k, v in options.items() if k.startswith("header.")}

    def page(self, number: int) -> dict:
        body = json.dumps({**self.payload, "page": number, "size": self.size}, ensure_ascii=False).encode()
        return envelope(fetch(self.url, body, {"Content-Type": "application/json", **self.headers}), self.url)

    def partitions(self) -> list[Pages]:
        total = self.page(1)["data"].get("total")
        known = -(-int(total) // self.size) if total is not None else self.most
        last = max(1, min(self.most, known))
        if total is None:
            return [Pages(1, last)]  # only reading on tells the end
        return [Pages(a, min(last, a + self.each - 1)) for a in range(1, last + 1, self.each)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for number in range(partition.first, partition.last + 1):
            start = time.monotonic()
            found = self.page(number)
            if not found["data"]["list"]:
                return
            yield number, str(found.get("trace_id") or ""), json.dumps({"endpoint": self.url, **found}, ensure_ascii=False)
            time.sleep(max(0.0, INTERVAL - (time.monotonic() - start)))


class PagedJson(DataSource):
    """Options: url, payload (a JSON object), size, max_pages, pages_per_task, header.NAME."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, trace_id string, raw_text string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


#: Intervals of price histories.
INTERVALS = {"d": "1d", "w": "1wk", "m": "1mo", "q": "3mo", "y": "1y"}


def _seconds(day: str) -> int:
    return (date.fromisoformat(day) - date(1970, 1, 1)).days * 86_400


def price_request(base: str, symbol: str, interval: str = "d", start: str = "", end: str = "", now: int | None = None) -> str:
    """The address of a price history: symbols in capitals, up to the end of a day (else now), and
    from a day on (else 365 days before)."""
    if not symbol.strip() or interval not in INTERVALS:
        raise ValueError(f"symbol {symbol!r}, interval {interval!r}")
    until = _seconds(end) + 86_399 if end else int(time.time() if now is None else now)
    since = _seconds(start) if start else until - int(timedelta(days=365).total_seconds())
    query = urllib.parse.urlencode({"period1": since, "period2": max(since, until), "interval": INTERVALS[interval]})
    return f"{base}/{urllib.parse.quote(symbol.strip().upper(), safe='')}?{query}"


def filing_search(base: str, text: str, forms: str = "", start: str = "", end: str = "", offset: int = 0) -> str:
    """The address of a full-text search of filings; a range of dates needs both its ends."""
    if bool(start) != bool(end):
        raise ValueError("a range needs both dates")
    given = {"q": text, "forms": forms, "dateRange": "custom" if start else "", "startdt": start, "enddt": end, "from": str(offset) if offset else ""}
    return f"{base}?{urllib.parse.urlencode({k: v for k, v in given.items() if v})}"


def page_address(url: str = "", path: str = "") -> tuple[str, str]:
    """(kind, address) of a page: exactly one of an https address and a path of an HTML file."""
    if bool(url) == bool(path):
        raise ValueError("give either an address or a path")
    if url and not url.lower().startswith("https://"):
        raise ValueError("only https addresses are read")
    if path and not path.lower().endswith((".html", ".htm")):
        raise ValueError("only .html and .htm files are read")
    return ("url", url) if url else ("path", path)
