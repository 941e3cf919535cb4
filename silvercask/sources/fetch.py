"""Retrieval of instances: a row for each item comes back with its bytes or with what went wrong, so one bad item costs
a row and not the job. Retries happen within the task; a task that runs again fetches its items again."""

from __future__ import annotations

import email.utils
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Attempts beyond the first, the greatest wait, and the content types that are taken.
RETRIES = 2
WAIT_MS = 30_000
TYPES = {"mp4": "video/mp4", "dcm": "application/dicom"}

#: status, headers (lower case) and body of a URL; raises OSError where the network fails.
Get = Callable[[str, str], tuple[int, dict[str, str], bytes]]


def http_get(url: str, accept: str) -> tuple[int, dict[str, str], bytes]:
    """A request without redirects."""
    import urllib.error
    import urllib.request

    class Still(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *_):
            return None

    request = urllib.request.Request(url, headers={"Accept": accept})
    try:
        with urllib.request.build_opener(Still).open(request, timeout=60) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, b""


def wait_ms(attempt: int, header: str | None, now: float) -> float:
    """How long to wait before the next attempt: what the server asks for, else twice as long each time."""
    if header:
        try:
            return min(max(0.0, float(header) * 1000), WAIT_MS)
        except ValueError:
            pass
        try:
            return min(max(0.0, email.utils.parsedate_to_datetime(header).timestamp() - now) * 1000, WAIT_MS)
        except (ValueError, TypeError):
            pass
    return min(WAIT_MS, 500 * 2 ** (attempt - 1))


def fetch_one(url: str | None, path: str | None, extension: str, get: Get = http_get, retries: int = RETRIES, sleep=time.sleep) -> tuple[bytes | None, str | None, str | None, int | None, int]:
    """(bytes, error, message, status, attempts). The error is SessionExpired (which ends a whole run), HttpError,
    PayloadValidation or Network. HTTP 408, 429, 5xx and a failing network are tried again."""
    if path:
        try:
            with open(path, "rb") as f:
                return f.read(), None, None, None, 1
        except OSError as e:
            return None, "File", str(e), None, 1
    if not url:
        return None, "Source", "no source", None, 0
    kind = TYPES.get(extension, TYPES["dcm"])
    for attempt in range(1, retries + 2):
        header = None
        try:
            status, headers, body = get(url, f"{kind},*/*")
        except OSError as e:
            found = (None, "Network", str(e), None, attempt)
        else:
            header = headers.get("retry-after")
            if 300 <= status < 400 or status in (401, 403):
                return None, "SessionExpired", f"HTTP {status}", status, attempt
            if 200 <= status < 300:
                if headers.get("content-type", "").split(";")[0].strip().lower() == kind:
                    return body, None, None, status, attempt
                return None, "PayloadValidation", f"content is not {kind}", status, attempt
            found = (None, "HttpError", f"HTTP {status}", status, attempt)
            if status not in (408, 429) and status < 500:
                return found
        if attempt <= retries:
            sleep(wait_ms(attempt, header, time.time()) / 1000)
    return found


def fetch(items: DataFrame, get: Get = http_get, retries: int = RETRIES, sleep=time.sleep) -> DataFrame:
    """items (sop, url, path, extension) -> sop, extension, data, error, message, status, attempts."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():  # a row at a time leaves, so a task holds one file
                data, error, message, status, attempts = fetch_one(row["url"], row["path"], row["extension"] or "dcm", get, retries, sleep)
                yield pa.RecordBatch.from_arrays([pa.array([row["sop"]], pa.string()), pa.array([row["extension"] or "dcm"]), pa.array([data], pa.binary()), pa.array([error], pa.string()), pa.array([message], pa.string()), pa.array([status], pa.int32()), pa.array([attempts], pa.int32())], names=["sop", "extension", "data", "error", "message", "status", "attempts"])

    return items.select("sop", "url", "path", "extension").mapInArrow(run, "sop string, extension string, data binary, error string, message string, status int, attempts int")


def ends_run(results: DataFrame) -> DataFrame:
    """Of the results, those that end a run: an expired session is the same for all items."""
    return results.where(F.col("error") == "SessionExpired")
