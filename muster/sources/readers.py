"""Sources as formats of Spark's own reader, for code that runs no manifest.

    spark.dataSource.register(worker_source())
    spark.read.format("muster_workers").options(tenant_url=..., tenant_id=..., username=..., password=...).load()

    spark.dataSource.register(employee_source())
    spark.readStream.format("muster_employees").options(subdomain=..., api_token=...).load()

``client`` replaces the transport, as for the connectors.  A schema given to the reader chooses columns, and only these are
looked for in the pages.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from ..errors import ConfigurationError
from . import sage, workday
from .clients import RestClient, SoapClient, by_value


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


def _asked(schema: StructType, known: tuple[str, ...]) -> list[str]:
    if odd := [f.name for f in schema if f.name not in known or not isinstance(f.dataType, StringType)]:
        raise ConfigurationError(f"no such text column(s): {', '.join(odd)}")
    return schema.names


def _schema(names) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def worker_rows(body: str, columns: list[str]) -> Iterator[tuple[str, ...]]:
    """Values of these columns for every worker of a response: as ``workday.workers`` has them."""

    def element(xml: str, tag: str) -> str:
        for p in workday.PREFIXES:
            if (m := re.search(f"<{p}{tag}>(.*?)</{p}{tag}>", xml, re.S)) and (text := m[1].partition("<")[0].strip()):
                return text
        return ""

    for p in workday.PREFIXES:
        for xml in re.findall(f"<{p}Worker>(.*?)</{p}Worker>", body, re.S):
            yield tuple(next(filter(None, (element(xml, t) for t in workday.COLUMNS[c])), "") for c in columns)


def worker_source(client: object | None = None) -> type[DataSource]:
    """Format ``muster_workers``: a partition for each page; options are those of the connector, ``include_...`` among them."""
    client = by_value(client or SoapClient())

    class Workers(DataSource):
        @classmethod
        def name(cls) -> str:
            return "muster_workers"

        def schema(self) -> StructType:
            return _schema(workday.COLUMNS)

        def reader(self, schema: StructType) -> DataSourceReader:
            o = dict(self.options)
            missing = [k for k in ("tenant_url", "tenant_id", "username", "password") if k not in o]
            if missing:
                raise ConfigurationError(f"missing option(s): {', '.join(missing)}")
            group = workday.ResponseGroup(**{k: o[k].lower() == "true" for k in vars(workday.ResponseGroup()) if k in o})
            config = workday.WorkdayConfig(o["tenant_url"], o["tenant_id"], o["username"], o["password"], int(o.get("worker_count_limit", 200)), group)
            return _WorkerReader(client, config, _asked(schema, tuple(workday.COLUMNS)))

    return Workers


class _WorkerReader(DataSourceReader):
    def __init__(self, client: object, config: workday.WorkdayConfig, columns: list[str]) -> None:
        self.client, self.config, self.columns, self.secret = client, config, columns, config.secret()

    def page(self, number: int) -> str:
        return workday._body(self.client.post(self.config.endpoint, workday.envelope(self.config, number, self.secret)))

    def partitions(self) -> list[InputPartition]:
        """The first page tells how many there are."""
        return [Page(k + 1) for k in range(max(1, workday.paging(self.page(1))["Total_Pages"]))]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from worker_rows(self.page(partition.number), self.columns)


def employee_rows(body: str, columns: list[str]) -> Iterator[tuple[str, ...]]:
    """Values of these columns for every employee of a response: as ``sage.employees`` has them."""
    for e in json.loads(body, parse_float=str, parse_int=str)["data"]:
        yield tuple(v if isinstance(v := e.get(c), str) else "" for c in columns)


def employee_source(client: object | None = None) -> type[DataSource]:
    """Format ``muster_employees`` of a stream: its offset is a page, so a query that is started again goes on after the pages
    that its checkpoint has.  Rows that a service adds to a page that has been read aren't seen; with ``hold_last`` the last page waits
    until another follows it.  Services that don't tell ``total_pages`` are asked for page after page."""
    client = by_value(client or RestClient())

    class Employees(DataSource):
        @classmethod
        def name(cls) -> str:
            return "muster_employees"

        def schema(self) -> StructType:
            return _schema(sage.COLUMNS)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            o = dict(self.options)
            if missing := [k for k in ("subdomain", "api_token") if k not in o]:
                raise ConfigurationError(f"missing option(s): {', '.join(missing)}")
            config = sage.SageConfig(o["subdomain"], o["api_token"], *[o.get(f"include_{h}", "false").lower() == "true" for h in sage.HISTORIES])
            return _EmployeeReader(client, config, _asked(schema, sage.COLUMNS), o.get("hold_last", "false").lower() == "true")

    return Employees


class _EmployeeReader(DataSourceStreamReader):
    def __init__(self, client: object, config: sage.SageConfig, columns: list[str], hold_last: bool) -> None:
        self.client, self.config, self.columns, self.hold_last, self.seen = client, config, columns, hold_last, 1

    def initialOffset(self) -> dict:
        return {"page": 1}

    def latestOffset(self) -> dict:
        """The page after the last one there is."""
        page = self.seen
        while True:
            meta = sage._fetched(self.client, self.config, page)[1]
            total, following = meta.get("total_pages"), meta.get("next_page")
            if isinstance(total, int) and total >= 1:
                last = total
                break
            if not following or following <= page:
                last = page
                break
            page = following
        self.seen = max(self.seen, last)
        return {"page": max(1, self.seen if self.hold_last else self.seen + 1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Page(k) for k in range(start["page"], end["page"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from employee_rows(sage._fetched(self.client, self.config, partition.number)[0], self.columns)

    def commit(self, end: dict) -> None:
        pass
