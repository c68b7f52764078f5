"""Write a CSV snapshot, and read one back by pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import RosterContext, in_order, quoted

CSV = {"header": True, "quote": '"', "escape": '"', "emptyValue": ""}


def show_data(ctx: RosterContext, path: str | None, single_file: bool = False, dry_run: bool = False) -> RosterContext:
    """The table as it is now, written to path; it passes through, and is kept so that its sources are read once.

    Arrays and structs are written as JSON, as CSV has no such values.  One file for each partition, or with
    single_file=True one in all, by one task."""
    if dry_run or path is None:
        return ctx
    ctx = ctx.keep()
    out = in_order(ctx.data)
    out = out.select(*[(F.to_json(quoted(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else quoted(f.name)) for f in out.schema])
    (out.coalesce(1) if single_file else out).write.mode("overwrite").options(**CSV).csv(path)
    return ctx


def shown_page(spark: SparkSession, path: str, most: int = 1000) -> dict:
    """A snapshot's columns and its first rows, for display."""
    got = shown(spark, path)
    return {"columns": got.columns, "rows": [r.asDict() for r in got.limit(most).collect()]}


def shown(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot, all columns as trimmed strings."""
    rows = spark.read.options(multiLine=True, **CSV).csv(path)
    return rows.select(*[F.trim(quoted(c)).alias(c) for c in rows.columns])
