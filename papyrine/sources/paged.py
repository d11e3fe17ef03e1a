"""A windowed, paged source behind Spark's data source API, for batches and streams.

A client gives pages: `pages(asked)` cuts what is asked for (a window of time and kinds) into page ranges on the
driver, `rows(asked, page)` reads one where a task runs. Each page range is a partition; of more than MOST_PARTITIONS, neighbours
are joined, so that a row group is not decoded anew for each of many pages. Rows are decoded a slice at a time. The window and the kinds
come as options, or as filters that Spark pushes down (where the session allows that to Python sources), so pages that
cannot hold such rows are never asked for. A window that ends before it starts, and a page that fails, fail the read;
`operators.incremental.attempt` makes that a failed fetch.

As a stream, offsets are times: a batch is the half-open window from one offset to the next, `step_seconds` long at
most, and the newest time of the source bounds it. The first batch starts at `since`, or at the oldest row.

Options: client (module:factory, a TableClient by default), path, time, kind, since, until (ISO), kinds, columns (JSON lists),
page_rows, pushdown, step_seconds.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

NAME, PAGE_ROWS = "papyrine_pages", 5000
#: Partitions from which pages of a row group share one, and rows decoded at a time.
MOST_PARTITIONS, SLICE_ROWS = 64, 1 << 16


def micros(at: datetime) -> int:
    """Microseconds since 1970; a time without a zone is UTC."""
    since = (at if at.tzinfo else at.replace(tzinfo=UTC)) - datetime(1970, 1, 1, tzinfo=UTC)
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds


@dataclass(frozen=True)
class Asked:
    """A closed window in microseconds and the kinds wanted; None is all."""

    since: int | None = None
    until: int | None = None
    kinds: tuple[str, ...] | None = None

    def sound(self) -> Asked:
        if self.since is not None and self.until is not None and self.since > self.until:
            raise ValueError("the window ends before it starts")
        return self


class Client(Protocol):
    def schema(self) -> pa.Schema: ...

    def bounds(self) -> tuple[int, int] | None:
        """Oldest and newest time of the source; None if it is empty."""

    def pages(self, asked: Asked) -> list: ...

    def rows(self, asked: Asked, page) -> Iterator[pa.RecordBatch]: ...


class TableClient:
    """Pages of Parquet files: runs of rows of a row group whose times can be within the window."""

    def __init__(self, options: dict[str, str]):
        self.path, self.time, self.kind = options["path"], options.get("time", "ts"), options.get("kind", "category")
        self.page_rows = int(options.get("page_rows", PAGE_ROWS))
        self.columns = json.loads(options["columns"]) if "columns" in options else None
        if self.page_rows < 1:
            raise ValueError("page_rows must be positive")

    def _files(self) -> ds.Dataset:
        return ds.dataset(self.path, format="parquet")

    def schema(self) -> pa.Schema:
        held = self._files().schema
        return held if self.columns is None else pa.schema([held.field(c) for c in self.columns])

    def _groups(self):
        """File, row group, rows, and the least and largest time, where the file knows them."""
        files = self._files()
        for fragment in files.get_fragments():
            meta = fragment.metadata
            at = meta.schema.to_arrow_schema().get_field_index(self.time)
            for g in range(meta.num_row_groups):
                found = meta.row_group(g).column(at).statistics
                known = found is not None and found.has_min_max
                yield fragment.path, g, meta.row_group(g).num_rows, micros(found.min) if known else None, micros(found.max) if known else None

    def _slices(self, path: str, g: int, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
        """A row group from its first row on, `rows` at a time; pages of columns are read and decoded as they come."""
        with self._files().filesystem.open_input_file(path) as held:
            yield from pq.ParquetFile(held, buffer_size=1 << 20, pre_buffer=False).iter_batches(rows, row_groups=[g], columns=columns)

    def _ends(self) -> Iterator[tuple[int, int]]:
        """Least and largest times of row groups, or of slices of those whose file does not know them."""
        for path, g, _, low, high in self._groups():
            if low is not None and high is not None:
                yield low, high
                continue
            for part in self._slices(path, g, [self.time], SLICE_ROWS):
                ends = pc.min_max(part.column(0).cast(pa.timestamp("us")).cast(pa.int64()))
                if ends["min"].is_valid:
                    yield ends["min"].as_py(), ends["max"].as_py()

    def bounds(self) -> tuple[int, int] | None:
        low = high = None
        for least, most in self._ends():
            low, high = least if low is None else min(low, least), most if high is None else max(high, most)
        return None if low is None else (low, high)

    def pages(self, asked: Asked) -> list[tuple[str, int, int, int]]:
        groups = []
        for path, g, rows, low, high in self._groups():
            if (asked.until is not None and low is not None and low > asked.until) or (asked.since is not None and high is not None and high < asked.since):
                continue
            groups.append((path, g, rows))
        pages = sum(-(-rows // self.page_rows) for _, _, rows in groups)
        run = self.page_rows * max(1, -(-pages // MOST_PARTITIONS))
        return [(path, g, at, min(run, rows - at)) for path, g, rows in groups for at in range(0, rows, run)]

    def rows(self, asked: Asked, page: tuple[str, int, int, int]) -> Iterator[pa.RecordBatch]:
        path, g, start, n = page
        names = self.schema().names
        at = 0
        for part in self._slices(path, g, list(dict.fromkeys([*names, self.time, *([self.kind] if asked.kinds is not None else [])])), min(SLICE_ROWS, start + n)):
            first, last = max(start - at, 0), min(start + n - at, part.num_rows)
            at += part.num_rows
            if first < last:
                yield self._kept(asked, part.slice(first, last - first)).select(names)
            if at >= start + n:
                return

    def _kept(self, asked: Asked, part: pa.RecordBatch) -> pa.RecordBatch:
        keep = pa.repeat(True, part.num_rows)
        time = part.column(self.time).cast(pa.timestamp("us")).cast(pa.int64())
        for bound, test in ((asked.since, pc.greater_equal), (asked.until, pc.less_equal)):
            if bound is not None:
                keep = pc.and_(keep, pc.fill_null(test(time, bound), False))
        if asked.kinds is not None:
            keep = pc.and_(keep, pc.is_in(part.column(self.kind), pa.array(asked.kinds, pa.string())))
        return part.filter(keep)


def client_of(options: dict[str, str]) -> Client:
    module, _, factory = options.get("client", f"{__name__}:TableClient").partition(":")
    return getattr(importlib.import_module(module), factory)(options)


def asked_of(options: dict[str, str]) -> Asked:
    at = lambda k: micros(datetime.fromisoformat(options[k])) if options.get(k) else None
    return Asked(at("since"), at("until"), tuple(dict.fromkeys(json.loads(options["kinds"]))) if "kinds" in options else None)


class Page(InputPartition):
    def __init__(self, asked: Asked, page):
        self.asked, self.page = asked, page


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.names, self.asked = options, schema.fieldNames(), asked_of(options)

    def partitions(self) -> list[Page]:
        asked = self.asked.sound()
        return [Page(asked, p) for p in client_of(self.options).pages(asked)] or [Page(asked, None)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        if partition.page is not None:
            for batch in client_of(self.options).rows(partition.asked, partition.page):
                yield batch.select(self.names)


class PushingReader(Reader):
    """Takes bounds of time and sets of kinds out of the query's filters; Spark evaluates all others, and open bounds, again."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        time, kind = self.options.get("time", "ts"), self.options.get("kind", "category")
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == (time,) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.asked = replace(self.asked, since=max(micros(f.value), self.asked.since if self.asked.since is not None else micros(f.value)))
            elif name == (time,) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.asked = replace(self.asked, until=min(micros(f.value), self.asked.until if self.asked.until is not None else micros(f.value)))
            elif name == (kind,) and isinstance(f, (In, EqualTo)):
                own = tuple(f.value) if isinstance(f, In) else (f.value,)
                self.asked = replace(self.asked, kinds=own if self.asked.kinds is None else tuple(k for k in self.asked.kinds if k in own))
            if not (name in ((time,), (kind,)) and isinstance(f, (GreaterThanOrEqual, LessThanOrEqual, In, EqualTo))) or name == (time,) and isinstance(f, (In, EqualTo)):
                yield f


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.names, self.asked = options, schema.fieldNames(), asked_of(options).sound()
        self.step = int(float(options["step_seconds"]) * 1_000_000) if "step_seconds" in options else None
        self.last: int | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        held = client_of(self.options).bounds()
        return {"at": self.asked.since if self.asked.since is not None else held[0] if held else 0}

    def latestOffset(self) -> dict:  # noqa: N802
        held = client_of(self.options).bounds()
        start = self.last if self.last is not None else self.initialOffset()["at"]
        newest = held[1] + 1 if held else start
        if self.asked.until is not None:
            newest = min(newest, self.asked.until + 1)
        self.last = max(start, newest if self.step is None else min(newest, start + self.step))
        return {"at": self.last}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.last = end["at"]  # after a restart offsets go on from the log
        if start["at"] >= end["at"]:
            return []
        asked = replace(self.asked, since=start["at"], until=end["at"] - 1)
        return [Page(asked, p) for p in client_of(self.options).pages(asked)]

    read = Reader.read

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(client_of(self.options).schema(), prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> Reader:
        return (PushingReader if self.options.get("pushdown") == "true" else Reader)(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
        return StreamReader(dict(self.options), schema)


def _options(spark: SparkSession, path: str, time: str, kind: str, since: datetime | None, until: datetime | None, kinds: list[str] | None, more: dict) -> dict[str, str]:
    spark.dataSource.register(PagedSource)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    given = {"path": path.removeprefix("file:") if path.startswith("file:///") else path, "time": time, "kind": kind, "pushdown": pushes}
    given |= {k: v.isoformat() for k, v in (("since", since), ("until", until)) if v is not None}
    return given | ({"kinds": json.dumps(kinds)} if kinds is not None else {}) | {k: json.dumps(v) if isinstance(v, list) else str(v) for k, v in more.items()}


def fetch(spark: SparkSession, path: str, time: str = "ts", kind: str = "category", since: datetime | None = None, until: datetime | None = None, kinds: list[str] | None = None, **more) -> DataFrame:
    """Rows of a window and of some kinds, a partition a page range; nothing is asked for before an action."""
    return spark.read.format(NAME).options(**_options(spark, path, time, kind, since, until, kinds, more)).load()


def stream(spark: SparkSession, path: str, time: str = "ts", kind: str = "category", since: datetime | None = None, until: datetime | None = None, kinds: list[str] | None = None, **more) -> DataFrame:
    """The same as a stream whose batches are windows of time."""
    return spark.readStream.format(NAME).options(**_options(spark, path, time, kind, since, until, kinds, more)).load()
