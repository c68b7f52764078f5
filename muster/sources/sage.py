"""Employees from a paged REST service."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import RosterContext, numbered
from ..errors import IngestionError
from .clients import RestClient, by_value

# The columns, all of them strings.
COLUMNS = (
    "id", "email", "first_name", "last_name", "picture_url", "employment_start_date", "date_of_birth", "team", "team_id", "position", "position_id", "reports_to_employee_id", "work_phone", "home_phone", "mobile_phone",
    "gender", "street_first", "street_second", "city", "post_code", "country", "employee_number", "employment_status",
)
#: Read as JSON text, as they may be a number or a string.
HISTORIES = ("team_history", "employment_status_history", "position_history")


@dataclass(frozen=True)
class SageConfig:
    subdomain: str
    api_token: str
    include_team_history: bool = False
    include_employment_status_history: bool = False
    include_position_history: bool = False

    @property
    def endpoint(self) -> str:
        return f"https://{self.subdomain.strip().strip('.').strip()}.sage.hr/api/employees"

    def query(self, page: int) -> dict[str, str]:
        wanted = {h: "true" for h in HISTORIES if getattr(self, f"include_{h}")}
        return {"page": str(page)} | wanted


def employees(pages: DataFrame) -> DataFrame:
    """One row for each employee in response bodies (column ``body``); missing values are empty.

    Numbers and strings become text, other JSON values of post_code become empty."""
    v = F.parse_json("body")
    rows = pages.select(F.explode(F.variant_get(v, "$.data", "array<variant>")).alias("e"))

    def text(name: str):
        kind = F.schema_of_variant(F.variant_get("e", f"$.{name}", "variant"))
        value = F.variant_get("e", f"$.{name}", "string")
        return F.coalesce(F.when(~kind.rlike("^(OBJECT|ARRAY|BOOLEAN)"), value), F.lit("")).alias(name)

    return rows.select(*[text(c) for c in COLUMNS])


def _fetched(client: object, config: SageConfig, page: int) -> tuple[str, dict]:
    """A page's body and what it says of the pages."""
    r = client.get(config.endpoint, {"X-Auth-Token": config.api_token, "Accept": "application/json"}, config.query(page))
    if r.status >= 400:
        raise IngestionError(f"request for page {page} failed with {r.status}: {r.body[:500]}")
    try:
        meta = json.loads(r.body)["meta"]
        meta.get("next_page")
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise IngestionError(f"page {page} cannot be read: {e}") from e
    return r.body, meta


def sage(spark: SparkSession, config: SageConfig, client: object | None = None) -> RosterContext:
    """If the first page says how many there are, tasks fetch the others; else they are fetched one after another, as each
    names the next, and only a greater page number is followed."""
    client, page, bodies = by_value(client or RestClient()), 1, []
    while True:
        body, meta = _fetched(client, config, page)
        bodies.append((page, body))
        following, total = meta.get("next_page"), meta.get("total_pages")
        if not following or following <= page or (isinstance(total, int) and total > 1):
            break
        page = following
    pages = spark.createDataFrame(bodies, "page int, body string")
    if following and page == 1 and isinstance(total, int) and total > 1:

        def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for k in (k for b in batches for k in b["id"]):
                yield pd.DataFrame({"page": [k], "body": [_fetched(client, config, int(k))[0]]})

        pages = pages.unionAll(spark.range(2, total + 1, numPartitions=min(total - 1, 64)).mapInPandas(fetch, "page int, body string"))
    ctx = RosterContext(numbered(employees(pages)))
    return ctx.came_from(COLUMNS, "SAGE_HR")
