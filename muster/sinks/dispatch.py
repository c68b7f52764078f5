"""Send the table to an HTTP endpoint as JSON."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NullType, NumericType, StringType

from ..context import RosterContext, Warning_, in_order, quoted, scratch, visible
from ..errors import EgressError
from ..sources.clients import Response, Retry
from .auth import Auth, Send, http
from .writer import dispatch

#: Rows of a request, unless a manifest says otherwise.
BATCH_ROWS = 1000
#: Three attempts on these statuses; a failed transport isn't tried again.
RETRY = Retry(attempts=3, pause_ms=1000, statuses=frozenset((429, 502, 503, 504)).__contains__, transport=False)


def _value(c: Column, kind: DataType) -> Column:
    return c if isinstance(kind, NumericType | BooleanType | StringType | NullType) else c.cast("string")


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object for each row (column ``json``); nulls are kept; dates and the like become text."""
    fields = [_value(quoted(f.name), f.dataType).alias(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


@dataclass(frozen=True)
class Dispatcher:
    """One request for every batch_rows rows.

    With in_tasks, each task posts its own batches, in no order among tasks, and the driver only learns the counts.  Else rows
    are sent in order as they come to the driver, which holds a partition and a batch at a time; so is, with batch_rows=None, one
    request with all rows."""

    auth: Auth
    transport: Send = http
    retry: Retry = field(default=RETRY)
    batch_rows: int | None = BATCH_ROWS
    in_tasks: bool = False
    #: Headers that every request has besides those of the authorization.
    headers: tuple[tuple[str, str], ...] = ()

    def post(self, rows: list[str]) -> Response:
        body = ('{"data":[' + ",".join(rows) + "]}").encode()

        def once() -> Response:
            url, headers = self.auth.request(self.transport)
            return self.transport("POST", url, headers | {"Content-Type": "application/json"} | dict(self.headers), body)

        return self.retry.run(once)

    def send(self, df: DataFrame) -> tuple[int, list[Response]]:
        sent, held, got = 0, [], []
        for r in json_rows(df).toLocalIterator():
            held.append(r["json"])
            if self.batch_rows and len(held) == self.batch_rows:
                got.append(self.post(held))
                sent, held = sent + len(held), []
        if held or not got:
            got.append(self.post(held))
            sent += len(held)
        return sent, got


def api_dispatcher(ctx: RosterContext, dispatcher: Dispatcher, dry_run: bool = False) -> RosterContext:
    """A failed request is a warning; the table passes through, and is kept so that its sources are read once."""
    if dry_run:
        return ctx
    if dispatcher.in_tasks and dispatcher.batch_rows:
        return _by_tasks(ctx, dispatcher)
    ctx = ctx.keep()
    try:
        sent, got = dispatcher.send(in_order(ctx.data))
        for r in got:
            if r.status >= 400:
                ctx.warnings.add(Warning_("api_dispatcher", f"dispatch failed with HTTP {r.status}", sent, r.body[:200]))
    except (OSError, EgressError) as e:
        ctx.warnings.add(Warning_("api_dispatcher", "dispatch failed", 0, str(e)))
    return ctx


def _by_tasks(ctx: RosterContext, dispatcher: Dispatcher) -> RosterContext:
    ctx = ctx.keep()
    try:
        got = dispatch(json_rows(visible(ctx.data)), dispatcher, scratch(ctx.data.sparkSession, "dispatched"))
        for status, batches in sorted(got["refused"].items()):
            ctx.warnings.add(Warning_("api_dispatcher", f"dispatch of {batches} batch(es) failed with HTTP {status}", got["rows"], got["answer"]))
    except (OSError, EgressError) as e:
        ctx.warnings.add(Warning_("api_dispatcher", "dispatch failed", 0, str(e)))
    return ctx
