"""Workers from a SOAP service: pages are fetched by tasks and cut into columns by Spark's functions."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import RosterContext, numbered
from ..errors import ConfigurationError, IngestionError
from .clients import Response, SoapClient, by_value

VERSION = "v45.2"
# Columns and the elements they come from, in the order in which they are tried.
COLUMNS = {
    "worker_id": ("Worker_ID", "WID"), "employee_id": ("Employee_ID",), "first_name": ("First_Name", "Legal_First_Name"), "last_name": ("Last_Name", "Legal_Last_Name"), "email": ("Email_Address",), "phone": ("Phone_Number", "Formatted_Phone"),
    "job_title": ("Job_Title",), "business_title": ("Business_Title",), "department": ("Organization_Name", "Department_Name"), "location": ("Location_Name", "Business_Site_Name"), "hire_date": ("Hire_Date", "Original_Hire_Date"), "worker_type": ("Worker_Type",),
    "worker_status": ("Status", "Active_Status_Description"), "manager_id": ("Manager_ID",), "manager_name": ("Manager_Name",), "position_id": ("Position_ID",), "compensation_grade": ("Compensation_Grade",), "pay_rate_type": ("Pay_Rate_Type",),
}
PREFIXES = ("bsvc:", "wd:", "")


@dataclass(frozen=True)
class ResponseGroup:
    include_personal_information: bool = True
    include_employment_information: bool = True
    include_compensation: bool = False
    include_organizations: bool = False
    include_roles: bool = False


@dataclass(frozen=True)
class WorkdayConfig:
    tenant_url: str
    tenant_id: str
    username: str
    password: str
    worker_count_limit: int = 200
    response_group: ResponseGroup = field(default_factory=ResponseGroup)

    @property
    def endpoint(self) -> str:
        return f"{self.tenant_url.rstrip('/')}/ccx/service/{self.tenant_id}/Human_Resources/{VERSION}"

    def secret(self) -> str:
        """The password, or the environment variable that ``env:NAME`` names."""
        if not self.password.startswith("env:"):
            return self.password
        name = self.password.removeprefix("env:")
        if name not in os.environ:
            raise ConfigurationError(f"environment variable {name} is not set")
        return os.environ[name]


def envelope(config: WorkdayConfig, page: int, secret: str | None = None) -> str:
    """A request's body; tasks are given the secret, as their environment may not have it."""
    secret = config.secret() if secret is None else secret
    group = "".join(f"<bsvc:{'_'.join(w.capitalize() for w in k.split('_'))}>{str(v).lower()}</bsvc:{'_'.join(w.capitalize() for w in k.split('_'))}>" for k, v in vars(config.response_group).items())
    wsse = "http://docs.oasis-open.org/wss/2004/01/oasis-200401-wss"
    return (
        '<?xml version="1.0" encoding="UTF-8"?>'
        f'<env:Envelope xmlns:env="http://schemas.xmlsoap.org/soap/envelope/" xmlns:bsvc="urn:com.workday/bsvc" xmlns:wsse="{wsse}-wssecurity-secext-1.0.xsd">'
        f'<env:Header><wsse:Security env:mustUnderstand="1"><wsse:UsernameToken><wsse:Username>{escape(config.username)}@{escape(config.tenant_id)}</wsse:Username>'
        f'<wsse:Password Type="{wsse}-username-token-profile-1.0#PasswordText">{escape(secret)}</wsse:Password></wsse:UsernameToken></wsse:Security></env:Header>'
        f'<env:Body><bsvc:Get_Workers_Request bsvc:version="{VERSION}"><bsvc:Response_Filter><bsvc:Page>{page}</bsvc:Page><bsvc:Count>{config.worker_count_limit}</bsvc:Count></bsvc:Response_Filter>'
        f"<bsvc:Response_Group>{group}</bsvc:Response_Group></bsvc:Get_Workers_Request></env:Body></env:Envelope>"
    )


def _element(xml: Column, name: str) -> Column:
    """Trimmed text up to the first nested element of <name>, by prefixes in turn; null if none has any."""
    tries = [F.regexp_extract(xml, rf"(?s)<{p}{name}>(.*?)</{p}{name}>", 1) for p in PREFIXES]
    texts = [F.trim(F.regexp_replace(F.substring_index(t, "<", 1), r"(?U)^\s+|\s+$", "")) for t in tries]
    return F.coalesce(*[F.when(t != "", t) for t in texts])


def workers(pages: DataFrame) -> DataFrame:
    """The 18 columns of every worker in response bodies (column ``body``); what is missing is empty."""
    blocks = F.concat(*[F.regexp_extract_all("body", F.lit(rf"(?s)<{p}Worker>(.*?)</{p}Worker>"), 1) for p in PREFIXES])
    rows = pages.select(F.explode(blocks).alias("w"))
    return rows.select(*[F.coalesce(*[_element(F.col("w"), t) for t in tags], F.lit("")).alias(c) for c, tags in COLUMNS.items()])


def paging(body: str) -> dict[str, int]:
    """Total_Results, Total_Pages, Page_Results, Page; 0, 1, 0 and 1 where they are missing."""
    import re

    out = {}
    for name, default in (("Total_Results", 0), ("Total_Pages", 1), ("Page_Results", 0), ("Page", 1)):
        m = re.search(rf"<(?:bsvc:|wd:)?{name}>\s*(\d+)\s*<", body)
        out[name] = int(m[1]) if m else default
    return out


def _body(r: Response) -> str:
    if r.status >= 400:
        import re

        m = re.search(r"<faultstring[^>]*>(.*?)</faultstring>", r.body, re.S)
        raise IngestionError(f"SOAP request failed with {r.status}: {m[1] if m else r.body[:500]}")
    return r.body


def workday(spark: SparkSession, config: WorkdayConfig, client: object | None = None) -> RosterContext:
    """The first page tells how many there are; tasks fetch the others."""
    client = by_value(client or SoapClient())
    secret = config.secret()
    first = _body(client.post(config.endpoint, envelope(config, 1, secret)))
    total = paging(first)["Total_Pages"]
    pages = spark.createDataFrame([(1, first)], "page int, body string")
    if total > 1:

        def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for page in b["id"]:
                    yield pd.DataFrame({"page": [page], "body": [_body(client.post(config.endpoint, envelope(config, int(page), secret)))]})

        pages = pages.unionAll(spark.range(2, total + 1, numPartitions=min(total - 1, 64)).mapInPandas(fetch, "page int, body string"))
    ctx = RosterContext(numbered(workers(pages)))
    return ctx.came_from(ctx.columns, "WORKDAY_HRIS")
