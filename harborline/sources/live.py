"""Sources that are asked page by page or listened to, as Python data sources.

``register(spark)`` makes the formats ``paged_records`` and ``vessel_lines`` known to a session.
"""

from __future__ import annotations

import json
import os
import re
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Fields of a record of the conflict API, all text.
RECORD_FIELDS = "event_id_cnty event_id event_date event_type sub_event_type actor1 actor2 assoc_actor_1 assoc_actor_2 country region location latitude longitude fatalities notes".split()
FIRST_DAY, LAST_DAY = "0001-01-01", "9999-12-31"


def register(spark: SparkSession) -> SparkSession:
    """Make the formats known, and let filters reach them."""
    spark.dataSource.register(PagedRecords)
    spark.dataSource.register(VesselLines)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PagedRecords(DataSource):
    """Records of an API that answers in pages, as text columns.

    Options: ``url``, a template with {page} (from 1), {start} and {end} (days, inclusive); ``page_size`` (500), the number of
    records of all pages but the last; ``pages_per_task`` (10); ``start`` and ``end``; ``field`` (data), where an answer that is
    an object has its records. Conditions on event_date narrow start and end before anything is fetched. The last page is
    found by doubling and halving, a few requests; then each task fetches its range of pages and stops at a short one. A page
    that is not there (404, or no such file) is empty; any other failure fails the task, which is tried again.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return ", ".join(f"{f} string" for f in RECORD_FIELDS)

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(dict(self.options), [f.name for f in schema.fields])


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, fields: list[str]):
        self.url, self.fields, self.field = options["url"], fields, options.get("field", "data")
        self.size, self.per_task = int(options.get("page_size", 500)), int(options.get("pages_per_task", 10))
        self.start, self.end = options.get("start", FIRST_DAY), options.get("end", LAST_DAY)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            day = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("event_date",) or not re.fullmatch(r"\d{4}-\d\d-\d\d", str(day)) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.start = max(self.start, day)
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.end = min(self.end, day)
            yield f  # the answer is held against the condition again

    def page(self, number: int) -> list[dict]:
        url = self.url.format(page=number, start=self.start, end=self.end)
        try:
            with urllib.request.urlopen(url, timeout=60) as answer:
                found = json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return []
            raise
        except urllib.error.URLError as e:
            if isinstance(e.reason, FileNotFoundError) or "No such file" in str(e.reason):
                return []
            raise
        return found.get(self.field) or [] if isinstance(found, dict) else found

    def partitions(self) -> list[InputPartition]:
        if self.start > self.end:
            return [Pages(1, 0)]
        full, short = 0, 1  # the last page known to be full, and one known not to be
        while len(self.page(short)) >= self.size:
            full, short = short, 2 * short
        while short - full > 1:
            middle = (full + short) // 2
            full, short = (middle, short) if len(self.page(middle)) >= self.size else (full, middle)
        return [Pages(a, min(a + self.per_task - 1, short)) for a in range(1, short + 1, self.per_task)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for number in range(partition.first, partition.last + 1):
            records = self.page(number)
            for r in records:
                day = r.get("event_date")
                if day is None or self.start <= str(day) <= self.end:
                    yield tuple(None if r.get(f) is None else str(r[f]) for f in self.fields)
            if len(records) < self.size:
                return


# ---- lines from a socket


class Lines(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class VesselLines(DataSource):
    """Lines of a receiver's socket as a stream of (line_no, value).

    Options: ``host``, ``port``; ``login``, sent after connecting; ``journal``, a folder that driver and executors share; ``wait``
    (1), seconds to listen for each batch; ``lines_per_task`` (10000). A socket cannot be asked again, so whole lines go to the
    journal before Spark hears of them: an offset is a number of journalled lines, a batch that is run again reads the same
    lines, and a restarted query goes on after the last line it has committed. Committed lines leave the journal.
    """

    @classmethod
    def name(cls) -> str:
        return "vessel_lines"

    def schema(self) -> str:
        return "line_no long, value string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LineReader(dict(self.options))


class LineReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.at, self.login, self.journal = (options["host"], int(options["port"])), options.get("login"), options["journal"]
        self.wait, self.per_task = float(options.get("wait", 1)), int(options.get("lines_per_task", 10000))
        self.socket, self.rest = None, b""
        os.makedirs(self.journal, exist_ok=True)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"socket": None, "rest": b""}

    def _segments(self) -> list[tuple[int, int, str]]:
        """(first line, line after the last, file), in order."""
        found = [(re.fullmatch(r"(\d+)-(\d+)\.lines", f), f) for f in os.listdir(self.journal)]
        return sorted((int(m[1]), int(m[2]), f"{self.journal}/{f}") for m, f in found if m)

    def initialOffset(self) -> dict:
        return {"line": 0}

    def latestOffset(self) -> dict:
        segments = self._segments()
        total = segments[-1][1] if segments else 0
        if lines := self._listen():
            part = f"{self.journal}/writing"
            with open(part, "wb") as f:
                f.write(b"".join(line + b"\n" for line in lines))
                f.flush()
                os.fsync(f.fileno())
            os.replace(part, f"{self.journal}/{total:020d}-{total + len(lines):020d}.lines")
            total += len(lines)
        return {"line": total}

    def _listen(self) -> list[bytes]:
        until, data = time.monotonic() + self.wait, self.rest
        try:
            if self.socket is None:
                self.socket = socket.create_connection(self.at, timeout=self.wait)
                if self.login:
                    self.socket.sendall(f"{self.login}\r\n".encode())
            while (left := until - time.monotonic()) > 0:
                self.socket.settimeout(left)
                got = self.socket.recv(1 << 16)
                if not got:
                    self._close()
                    break
                data += got
        except TimeoutError:
            pass
        except OSError:
            self._close()  # the next batch connects again
        *lines, self.rest = data.split(b"\n")
        return [line for line in (x.rstrip(b"\r") for x in lines) if line]

    def _close(self) -> None:
        if self.socket is not None:
            self.socket.close()
        self.socket = None

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Lines(a, min(a + self.per_task, end["line"])) for a in range(start["line"], end["line"], self.per_task)]

    def read(self, partition: Lines) -> Iterator[tuple]:
        for first, after, path in self._segments():
            if first < partition.last and after > partition.first:
                with open(path, "rb") as f:
                    for number, line in enumerate(f, first):
                        if partition.first <= number < partition.last:
                            yield number, line.rstrip(b"\n").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        segments = self._segments()
        for _, after, path in segments[:-1]:  # the last one tells how many lines there were
            if after <= end["line"]:
                os.remove(path)

    def stop(self) -> None:
        self._close()
