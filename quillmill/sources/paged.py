"""Python data sources for paged REST services.

``works_pages`` follows a cursor: its stream offset is the cursor, so a restart
goes on at the page after the last committed one. In a batch it can follow a
cursor for each month (``split``). ``monthly_records`` reads one
partition per month; as a stream it goes month by month, and its
offset is the month, the start within it and what each month has given so far.
A stream's first batch is one page; later ones take as many pages as the run has
had before, up to ``BATCH_ROWS`` rows or ``BATCH_CHARS`` of lines, so long collections
need few batches. Once batches have stopped growing, the next one's pages are asked
for while a batch is written.
``place`` is a row's position in its collection. A stream takes at most
``maxPages`` pages a run. Both get their pages from a ``fetch`` object named by the
``pages`` option: ``module:attribute``, called with a cursor or a month. The
package has ``saved_pages``, which reads pages saved as JSON files, so that
collections can be replayed and tested without a network.
"""

from __future__ import annotations

import json
import re
from calendar import monthrange
from collections import deque
from collections.abc import Callable, Iterator
from importlib import import_module
from pathlib import Path
from threading import Thread

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from quillmill.streaming.ingest import next_position

SOURCES: dict[str, type[DataSource]] = {}


def register(cls: type[DataSource]) -> type[DataSource]:
    """Adds a source under its name, once."""
    if not issubclass(cls, DataSource):
        raise TypeError(f"{cls.__name__} is not a data source")
    if cls.name() in SOURCES:
        raise ValueError(f"source {cls.name()!r} exists")
    SOURCES[cls.name()] = cls
    return cls


def register_all(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for cls in SOURCES.values():
        spark.dataSource.register(cls)


def saved_pages(options: dict) -> Callable[[str], dict]:
    """Pages from files ``{folder}/{cursor}.json``; an unsaved one is empty."""

    def fetch(cursor: str) -> dict:
        path = Path(options["folder"]) / f"{re.sub(r'[^0-9A-Za-z_-]', '_', cursor)}.json"
        return json.loads(path.read_text(encoding="utf-8")) if path.exists() else {"results": [], "next_cursor": None}

    return fetch


def fetcher(options: dict) -> Callable[[str], dict]:
    module, _, name = options.get("pages", "quillmill.sources.paged:saved_pages").partition(":")
    return getattr(import_module(module), name)(options)


#: Places left for the rows of a page of works.
PAGE_ROWS = 10_000


#: Places left for the pages of a month.
MONTH_PAGES = 1_000_000

#: Rows, and characters of their lines, from which on a stream's batch takes no further page.
BATCH_ROWS, BATCH_CHARS = 500_000, 64 << 20
#: Rows of an Arrow batch. A few large ones are sent quickly, while pages are asked for beside them.
ARROW_ROWS = 100_000

KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}

#: One encoder for all records; ``json.dumps`` makes one for each.
as_line = json.JSONEncoder(ensure_ascii=False).encode


class Month(InputPartition):
    def __init__(self, month: str):
        super().__init__(month)
        self.month = month


def as_text(x: object) -> str | None:
    """As Spark makes strings of Python's values."""
    return x if x is None or isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


class Paged:
    """Asks for all pages through one object, made where it is used, so that the service's pace and budget hold across pages."""

    #: Name and type of columns, if a stream's rows are handed over as Arrow batches, a page each, and not as tuples.
    columns: list[tuple[str, str]] | None = None
    #: Where a row has its line.
    line: int

    def __init__(self, options: dict):
        self.options, self.source = dict(options), None
        self.most_pages, self.taken = int(options.get("maxPages", 0)), 0
        self.push_years = options.get("pushYears") == "true"
        self.failed: Exception | None = None
        self.ahead: deque[tuple] = deque()
        self.asking: Thread | None = None

    def fetch(self, cursor: str) -> dict:
        if self.source is None:
            self.source = fetcher(self.options)
        return self.source(cursor)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"source": None, "ahead": deque(), "asking": None}

    def behind(self, at: dict) -> tuple[list[tuple], dict] | None:
        """The rows of the page at an offset, and the offset behind it; None if nothing is left."""
        raise NotImplementedError

    def page(self, at: dict) -> tuple[dict, list, int, int, dict] | None:
        """(offset, rows as they are handed over, their number, characters of their lines, offset behind) of the page at an offset."""
        found = self.behind(at)
        if found is None:
            return None
        rows, end = found
        chars = sum(len(r[self.line]) for r in rows)
        return at, self.handed_over(rows), len(rows), chars, end

    def handed_over(self, rows: list[tuple]) -> list:
        if self.columns is None or not rows:
            return rows
        values = [map(as_text, v) if kind == "string" else v for v, (_, kind) in zip(zip(*rows, strict=True), self.columns, strict=True)]
        arrays = [pa.array(list(v), KINDS[kind]) for v, (_, kind) in zip(values, self.columns, strict=True)]
        return [pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in self.columns])]

    def following(self, at: dict) -> tuple | None:
        """The page at an offset, asked for before or now."""
        if self.ahead and self.ahead[0][0] != at:
            self.ahead.clear()
        if self.ahead:
            return self.ahead.popleft()
        if self.failed:
            raise self.failed
        return self.page(at)

    def batch(self, at: dict) -> tuple[list, dict]:
        """The rows of the next pages, and the offset behind them.

        A page that fails ends the batch before it, so those that came are
        committed; the next call raises its error without asking again.
        """
        if self.asking:
            self.asking.join()
        rows, before, most, n_rows, chars = [], self.taken, max(1, self.taken), 0, 0
        if self.most_pages:
            most = min(most, self.most_pages - self.taken)
        for n in range(most):
            try:
                found = self.following(at)
            except Exception as error:
                if not n:
                    raise
                self.failed = error
                break
            if found is None:
                break
            _, page, more, longer, at = found
            rows += page
            n_rows, chars, self.taken = n_rows + more, chars + longer, self.taken + 1
            if n_rows >= BATCH_ROWS or chars >= BATCH_CHARS:
                break
        self.ask_ahead(at, before - (self.taken - before))
        if self.columns and rows:
            rows = pa.Table.from_batches(rows).combine_chunks().to_batches(ARROW_ROWS)
        return rows, at

    def ask_ahead(self, at: dict, most: int) -> None:
        """Asks for pages of the next batch while this one is written: so many that no more are uncommitted than committed.

        The batches before this one are committed when it is asked for.
        """
        if self.most_pages:
            most = min(most, self.most_pages - self.taken)
        if most <= 0 or self.failed:
            return

        def ask(at: dict) -> None:
            n_rows, chars = sum(p[2] for p in self.ahead), sum(p[3] for p in self.ahead)
            try:
                while len(self.ahead) < most and n_rows < BATCH_ROWS and chars < BATCH_CHARS:
                    found = self.page(at)
                    if found is None:
                        break
                    self.ahead.append(found)
                    _, _, more, longer, at = found
                    n_rows, chars = n_rows + more, chars + longer
            except Exception as error:  # noqa: BLE001  raised by the batch that comes to this page
                self.failed = error

        self.asking = Thread(target=ask, args=(self.ahead[-1][-1] if self.ahead else at,), daemon=True)
        self.asking.start()


def year_bounds(f: Filter) -> tuple[int, int] | None:
    """The years that a filter on the column ``year`` allows, both included; None for any other filter."""
    if getattr(f, "attribute", None) != ("year",):
        return None
    least, most = 0, 9999
    match f:
        case EqualTo(value=int(v)):
            return v, v
        case GreaterThan(value=int(v)):
            return v + 1, most
        case GreaterThanOrEqual(value=int(v)):
            return v, most
        case LessThan(value=int(v)):
            return least, v - 1
        case LessThanOrEqual(value=int(v)):
            return least, v
        case IsNotNull():
            return least, most
    return None


def year_of(work: dict) -> int | None:
    """Of the date that the service filters by, else the stated year."""
    date, stated = work.get("publication_date"), work.get("publication_year")
    if isinstance(date, str) and date[:4].isdigit():
        return int(date[:4])
    return stated if isinstance(stated, int) else None


class WorksReader(Paged, DataSourceReader, SimpleDataSourceStreamReader):
    """In a batch, filters on ``year`` become the dates that are asked for, so other years' pages are never sent."""

    least = most = None
    line = 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what narrows the years; a range of years is exact, a list of years is only narrowed, so Spark filters it again.

        Only with the option ``pushYears``: Spark keeps what was pushed with the frame, and a later use of the same
        frame without a filter would get it too. ``works_where`` makes a frame for one use.
        """
        if not self.push_years:
            yield from filters
            return
        for f in filters:
            bounds = year_bounds(f)
            exact = bounds is not None
            if isinstance(f, In) and f.attribute == ("year",) and f.value and all(isinstance(v, int) for v in f.value):
                bounds = min(f.value), max(f.value)
            if bounds:
                self.least, self.most = max(bounds[0], self.least or 0), min(bounds[1], 9999 if self.most is None else self.most)
            if not exact:
                yield f
        if self.least is not None and "from" in self.options:
            self.options["from"] = max(self.options["from"], f"{self.least:04d}-01-01")
            self.options["to"] = min(self.options["to"], f"{self.most:04d}-12-31")

    def wanted(self, year: int | None) -> bool:
        return self.least is None or (year is not None and self.least <= year <= self.most)

    def pages(self, cursor: str) -> Iterator[tuple[dict, str | None]]:
        n = 0
        while cursor and (not self.most_pages or n < self.most_pages):
            page = self.fetch(cursor)
            cursor, n = page.get("next_cursor"), n + 1
            yield page, cursor

    def rows(self, page: dict, number: int = 0) -> Iterator[tuple[str, str, int, int | None]]:
        for i, work in enumerate(page.get("results", [])):
            if work.get("id") and self.wanted(year := year_of(work)):
                yield work["id"], as_line(work), number * PAGE_ROWS + i, year

    def behind(self, at: dict) -> tuple[list[tuple], dict] | None:
        if not at.get("cursor"):
            return None
        page = self.fetch(at["cursor"])
        rows = list(self.rows(page, at["pages"]))
        total = at.get("total") if page.get("total") is None else page["total"]
        return rows, {"cursor": page.get("next_cursor") or "", "pages": at["pages"] + 1, "received": at.get("received", 0) + len(rows), "total": total}

    def partitions(self) -> list[Month]:
        """With the option ``split`` = ``month`` each month of the dates asked for is crawled for itself, side by side; a work has one date, so none is lost or repeated."""
        if self.options.get("split") != "month" or self.most_pages or (self.least is not None and self.least > self.most):
            return super().partitions()  # one cursor, one task
        return [Month(m) for m in months(self.options["from"], self.options["to"])]

    def of_month(self, month: str) -> Iterator[tuple]:
        """Places go by month, then by page."""
        first, last = self.options["from"], self.options["to"]
        days = monthrange(int(month[:4]), int(month[5:7]))[1]
        start = months(first, last).index(month) * MONTH_PAGES
        self.options |= {"from": max(first, f"{month}-01"), "to": min(last, f"{month}-{days}")}
        return (row for n, (page, _) in enumerate(self.pages("*"), start) for row in self.rows(page, n))

    def read(self, given):
        if isinstance(given, Month):
            return self.of_month(given.month)
        if not isinstance(given, dict):
            if self.least is not None and self.least > self.most:
                return iter(())
            return (row for n, (page, _) in enumerate(self.pages("*")) for row in self.rows(page, n))
        rows, end = self.batch(given)
        return iter(rows), end

    def initialOffset(self) -> dict:
        return {"cursor": "*", "pages": 0}

    def readBetweenOffsets(self, start: dict, end: dict):
        at = start
        while at["cursor"] and at["pages"] < end["pages"]:
            rows, at = self.behind(at)
            yield from rows

    def commit(self, end: dict) -> None:
        pass


@register
class WorksPages(DataSource):
    """(id, raw, place, year): works of a search, page by page."""

    @classmethod
    def name(cls) -> str:
        return "works_pages"

    def schema(self) -> str:
        return "id string, raw string, place bigint, year int"

    def reader(self, schema) -> WorksReader:
        return WorksReader(self.options)

    def simpleStreamReader(self, schema) -> WorksReader:
        return in_arrow(WorksReader(self.options), schema)


class MonthReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Month]:
        return [Month(m) for m in months(self.options["from"], self.options["to"])]

    def read(self, partition: Month) -> Iterator[tuple[str, str, str, int]]:
        fetch, cursor, n = fetcher(self.options), partition.month, 0
        while cursor:
            page = fetch(cursor)
            yield from month_rows(page, partition.month, n)
            cursor, n = page.get("next_cursor"), n + len(page.get("results", []))


def month_rows(page: dict, month: str, start: int) -> Iterator[tuple[str, str, str, int]]:
    for i, record in enumerate(page.get("results", [])):
        if record.get("pmid"):
            yield record["pmid"], month, as_line(record), start + i


class MonthStream(Paged, SimpleDataSourceStreamReader):
    """Cursors within a month are ``YYYY-MM@start``; a page that fails moves no offset."""

    line = 2

    def __init__(self, options: dict):
        super().__init__(options)
        self.months = months(options["from"], options["to"])

    def initialOffset(self) -> dict:
        return {"pages": 0, "months": {}}

    def behind(self, at: dict) -> tuple[list[tuple], dict] | None:
        month, start = next_position(at, self.months)
        if month is None:
            return None
        page = self.fetch(f"{month}@{start}" if start else month)
        rows = list(month_rows(page, month, start))
        received = (at["months"].get(month) or {}).get("received", 0) if start else 0
        known = at["months"] | {month: {"expected": page.get("total"), "received": received + len(rows), "complete": not page.get("next_cursor")}}
        later = [m for m in self.months if m > month]
        if page.get("next_cursor"):
            place = {"month_cursor": month, "retstart": int(page["next_cursor"].partition("@")[2])}
        elif later:
            place = {"month_cursor": later[0], "retstart": 0}
        else:
            place = {"complete": True, "complete_through_month": month}
        return rows, {"pages": at["pages"] + 1, "months": known} | place

    def read(self, start: dict):
        rows, end = self.batch(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        at = start
        while at["pages"] < end["pages"]:
            rows, at = self.behind(at)
            yield from rows

    def commit(self, end: dict) -> None:
        pass


def in_arrow(reader: Paged, schema: StructType) -> Paged:
    """The reader, made to hand over Arrow batches."""
    reader.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    return reader


def works_where(spark: SparkSession, options: dict, condition: str) -> DataFrame:
    """Works that meet a condition; bounds on ``year`` in it become the dates that the service is asked for."""
    register_all(spark)
    return spark.read.format("works_pages").options(**options, pushYears="true").load().where(condition)


def months(first: str, last: str) -> list[str]:
    """Months from ``YYYY-MM`` to ``YYYY-MM``, both included."""
    number = lambda m: int(m[:4]) * 12 + int(m[5:7]) - 1
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(number(first), number(last) + 1)]


@register
class MonthlyRecords(DataSource):
    """(pmid, month_bucket, raw, place): records by month of publication; in a batch, a partition a month."""

    @classmethod
    def name(cls) -> str:
        return "monthly_records"

    def schema(self) -> str:
        return "pmid string, month_bucket string, raw string, place bigint"

    def reader(self, schema) -> MonthReader:
        return MonthReader(self.options)

    def simpleStreamReader(self, schema) -> MonthStream:
        return in_arrow(MonthStream(self.options), schema)
